"""Document envelopes and their serialisation.

A document is an envelope row beside its conversation, turn and item rows. Its
JSON is written as ordered fragments that concatenate to one JSON object, so a
document of any size is written by many tasks and never held by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.functions import text as X
from turnloom.operators.ordering import shared_keys


def assemble(conversations: DataFrame, items: DataFrame, now: Column, agent: str = "turnloom@1") -> DataFrame:
    """One envelope per document. The id comes from the set of conversation ids through an
    order-free hash sum; the title is inherited when there is exactly one conversation."""
    conv = conversations.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("conversation_count"),
        F.sum(X.id_number(F.col("conv_id"))).alias("__ids"),
        F.max("title").alias("__title"),
    )
    counts = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("item_count"))
    return conv.join(counts, "doc_id", "left").select(
        "doc_id",
        X.stable_id("doc", F.col("conversation_count"), F.col("__ids")).alias("context_id"),
        F.lit(S.FORMAT_VERSION).alias("version"),
        F.when(F.col("conversation_count") == 1, F.col("__title")).alias("title"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(agent).alias("created_by"),
        "conversation_count",
        F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"),
    )


def _typed(kind: str, names: tuple[str, ...]) -> list[Column]:
    return [F.when(F.col("type") == kind, F.col(n)).alias(n) for n in names]


def item_json(kind: Column | None = None) -> Column:
    """One item as JSON; fields of other types are absent because nulls are dropped."""
    span = F.when(
        F.col("start").isNotNull(),
        F.struct(F.col("u16_start").alias("start"), F.col("u16_end").alias("end")),
    )
    provenance = F.struct(
        F.struct("kind", "platform").alias("source"),
        F.col("conv_id").alias("conversation_id"),
        "turn_id",
        span.alias("span"),
        "captured_at",
        F.struct("method", "agent").alias("extracted_by"),
    )
    return F.to_json(
        F.struct(
            F.col("item_id").alias("id"), "type", "content", "confidence", "strength", "status", "language", "filename", "uri",
            "title", provenance.alias("provenance"), "created_at",
        )
    )


def with_wire_spans(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Code point spans converted to UTF-16 units against the turn they point into."""
    keys = shared_keys(items, turns, "turn_id")
    joined = items.join(turns.select(*keys, F.col("content").alias("__turn")), keys, "left")
    return joined.select(
        *items.columns,
        X.u16_offset(F.col("__turn"), F.col("start")).alias("u16_start"),
        X.u16_offset(F.col("__turn"), F.col("end")).alias("u16_end"),
    )


def json_fragments(envelopes: DataFrame, conversations: DataFrame, turns: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, part, p1, p2, p3, p4, text): ordered by the part columns the texts of a document
    concatenate to its JSON. `items` carry wire spans, `created_at` and source columns."""
    zero = F.lit(0).cast("bigint")

    def rows(df, part, text, p1=zero, p2=zero, p3=zero, p4=zero):
        return df.select(
            "doc_id", F.lit(part).alias("part"), p1.cast("bigint").alias("p1"), p2.cast("bigint").alias("p2"),
            p3.cast("bigint").alias("p3"), p4.cast("bigint").alias("p4"), text.alias("text"),
        )

    meta = F.to_json(
        F.struct("title", "created_at", "updated_at", F.struct(F.col("created_by").alias("agent")).alias("created_by"))
    )
    head = F.concat(
        F.lit('{"context_version":"'), F.col("version"), F.lit('","id":"'), F.col("context_id"), F.lit('","metadata":'), meta,
        F.lit(',"conversations":['),
    )
    first_conv = conversations.groupBy("doc_id").agg(F.min("conv_pos").alias("__first"))
    conv = conversations.join(first_conv, "doc_id")
    comma = F.when(F.col("conv_pos") == F.col("__first"), F.lit("")).otherwise(F.lit(","))
    opened = F.regexp_replace(
        F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct("kind", "platform").alias("source"), "title", "url", "captured_at")),
        r"\}\z", ',"turns":[',
    )
    first_turn = turns.groupBy("conv_id").agg(F.min("idx").alias("__first"))
    turn = turns.join(first_turn, "conv_id")
    turn_comma = F.when(F.col("idx") == F.col("__first"), F.lit("")).otherwise(F.lit(","))
    turn_text = F.concat(
        turn_comma, F.to_json(F.struct(F.col("turn_id").alias("id"), F.col("idx").alias("index"), "role", "content"))
    )
    at = F.struct("conv_pos", "idx", "rank", "seq")
    first_item = items.groupBy("doc_id").agg(F.min(at).alias("__first"))
    item = items.join(first_item, "doc_id")
    item_comma = F.when(at == F.col("__first"), F.lit("")).otherwise(F.lit(","))
    parts = (
        rows(envelopes, 0, head),
        rows(conv, 1, F.concat(comma, opened), F.col("conv_pos"), F.lit(-1)),
        rows(turn, 1, turn_text, F.col("conv_pos"), F.col("idx")),
        rows(conv, 1, F.lit("]}"), F.col("conv_pos"), F.lit(2_147_483_647)),
        rows(envelopes, 2, F.lit('],"items":[')),
        rows(item, 3, F.concat(item_comma, item_json()), F.col("conv_pos"), F.col("idx"), F.col("rank"), F.col("seq")),
        rows(envelopes, 4, F.lit("]}")),
    )
    return reduce(DataFrame.unionByName, parts)


def write_json_lines(fragments: DataFrame, path: str, partitions: int | None = None) -> None:
    """Fragments range-partitioned and sorted, so that reading the files in order gives the documents."""
    order = ["doc_id", "part", "p1", "p2", "p3", "p4"]
    ranged = fragments.repartitionByRange(partitions, *order) if partitions else fragments.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)
