"""Operators over the items table: de-duplication, provenance, filters, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.functions import text as X
from turnloom.operators.ordering import first_n, first_wins, shared_keys

ITEM_ORDER = ("conv_pos", "idx", "rank", "seq")


def dedupe_key() -> Column:
    return (
        F.when(F.col("type") == "code_artifact", F.concat_ws("|", F.lit("code"), "language", X.strip(F.col("content"))))
        .when(F.col("type") == "reference", F.concat_ws("|", F.lit("ref"), "uri"))
        .otherwise(F.concat_ws("|", "type", X.dedupe_form(F.col("content"))))
    )


def dedupe_items(items: DataFrame, by_content: bool = True, scope: Sequence[str] = ("doc_id",)) -> DataFrame:
    """First item per key in document order, then first per id. The key travels as a hash."""
    out = items
    if by_content:
        out = first_wins(out.withColumn("__key", F.md5(dedupe_key())), [*scope, "__key"], ITEM_ORDER).drop("__key")
    return first_wins(out, [*scope, "item_id"], ITEM_ORDER)


def resolve_provenance(items: DataFrame, conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Item with its conversation and turn; the excerpt is the exact span of the turn."""
    conv = conversations.select(
        "doc_id", "conv_id", F.col("title").alias("conv_title"), F.col("url").alias("conv_url"), "platform", "kind"
    )
    turn = turns.select(
        "doc_id", "conv_id", "turn_id", F.col("idx").alias("turn_index"), F.col("role").alias("turn_role"), "content"
    ).withColumnRenamed("content", "__turn_text")
    base = items.drop("turn_index", "turn_role", "platform", "kind")
    joined = base.join(conv, ["doc_id", "conv_id"], "left").join(turn, ["doc_id", "conv_id", "turn_id"], "left")
    span = F.col("start").isNotNull()
    excerpt = F.when(span, F.substring("__turn_text", F.col("start") + 1, F.col("end") - F.col("start")))
    return joined.withColumn("excerpt", excerpt).drop("__turn_text")


def describe_provenance(captured_at: Column | None = None) -> Column:
    """`platform · "title" · turn n (role) · method`; absent parts are left out."""
    return F.concat_ws(
        " · ",
        F.col("platform"),
        F.concat(F.lit('"'), F.nullif(F.col("conv_title"), F.lit("")), F.lit('"')),
        F.concat(
            F.lit("turn "),
            F.col("turn_index").cast("string"),
            F.coalesce(F.concat(F.lit(" ("), F.col("turn_role"), F.lit(")")), F.lit("")),
        ),
        *([F.concat(F.lit("captured "), captured_at)] if captured_at is not None else []),
        F.col("method"),
    )


def explain_item(items: DataFrame, conversations: DataFrame, turns: DataFrame, item_ids: DataFrame) -> DataFrame:
    """Where do these items come from? The lookup happens before the joins."""
    wanted = items.join(item_ids, shared_keys(items, item_ids, "item_id"), "left_semi")
    return resolve_provenance(wanted, conversations, turns)


def message_numbers(items: DataFrame, turns: DataFrame) -> DataFrame:
    keys = shared_keys(items, turns, "turn_id")
    return items.join(turns.select(*keys, (F.col("idx") + 1).alias("message_number")), keys, "left")


def with_annotations(items: DataFrame, annotations: DataFrame) -> DataFrame:
    return items.join(annotations, shared_keys(items, annotations, "item_id"), "left")


def with_origin(items: DataFrame, annotations: DataFrame, turns: DataFrame) -> DataFrame:
    """Annotation origin, else role of the source turn, else unknown."""
    by_item, by_turn = shared_keys(items, annotations, "item_id"), shared_keys(items, turns, "turn_id")
    a = annotations.select(*by_item, F.col("origin").alias("__annotated"))
    t = turns.select(*by_turn, F.col("role").alias("__role"))
    joined = items.drop("origin").join(a, by_item, "left").join(t, by_turn, "left")
    return joined.withColumn("origin", F.coalesce("__annotated", "__role", F.lit("unknown"))).drop(
        "__annotated", "__role"
    )


def decode_filter(
    items: DataFrame,
    types: Sequence[str] | None = None,
    min_confidence: float = 0.0,
    conversation_ids: Sequence[str] | None = None,
    origins: Sequence[str] | None = None,
) -> DataFrame:
    keep = F.col("confidence") >= F.lit(min_confidence)
    if types is not None:
        keep = keep & F.col("type").isin(*types)
    if conversation_ids is not None:
        keep = keep & F.coalesce(F.col("conv_id").isin(*conversation_ids), F.lit(False))
    if origins is not None:
        keep = keep & F.col("origin").isin(*origins)
    return items.filter(keep)


def section_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in S.SECTION_ORDER]), kind).cast("int")


def section_label(kind: Column) -> Column:
    label = F.lit(None).cast("string")
    for t, text in S.SECTION_LABELS.items():
        label = F.when(kind == t, F.lit(text)).otherwise(label)
    return label


def sections(selected: DataFrame, available: DataFrame) -> DataFrame:
    """Non-empty sections per document in the fixed order, with shown and available totals."""
    total = available.groupBy("doc_id").agg(F.count(F.lit(1)).alias("available_items"))
    per_type = selected.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("items"))
    shown = per_type.groupBy("doc_id").agg(F.sum("items").alias("total_items"))
    return (
        per_type.join(shown, "doc_id")
        .join(total, "doc_id")
        .select(
            "doc_id",
            section_rank(F.col("type")).alias("section"),
            "type",
            section_label(F.col("type")).alias("label"),
            "items",
            "total_items",
            "available_items",
        )
    )


def methods(selected: DataFrame) -> DataFrame:
    """The distinct extraction methods of each document; at most one row per method."""
    return selected.select("doc_id", "method").distinct()


def type_counts(items: DataFrame) -> DataFrame:
    """Counts by type and by origin, in one pass."""
    return items.groupBy("doc_id", "type", "origin").agg(F.count(F.lit(1)).alias("items"))


def summarize(documents: DataFrame, conversations: DataFrame, items: DataFrame) -> DataFrame:
    """List row of a document. Sources and type counts are closed vocabularies, so the maps stay small."""
    convs = conversations.groupBy("doc_id", F.concat_ws("/", "kind", "platform").alias("source")).agg(
        F.count(F.lit(1)).alias("n")
    )
    conv_part = convs.groupBy("doc_id").agg(
        F.sum("n").alias("conversation_count"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources")
    )
    typed = items.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    item_part = typed.groupBy("doc_id").agg(
        F.sum("n").alias("item_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("item_counts"),
    )
    return (
        documents.join(conv_part, "doc_id", "left")
        .join(item_part, "doc_id", "left")
        .withColumn("conversation_count", F.coalesce("conversation_count", F.lit(0)))
        .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    )


def last_messages(turns: DataFrame, n: int) -> DataFrame:
    return first_n(turns, ["conv_id"], [F.col("idx").desc()], n)


def last_user_message(turns: DataFrame) -> DataFrame:
    return first_wins(turns.filter(F.col("role") == "user"), ["conv_id"], [F.col("idx").desc()])


def superseded(items: DataFrame, relations: DataFrame) -> DataFrame:
    """Flags items that a newer one may replace; no row is removed."""
    newer = relations.filter(F.col("type") == "supersedes").withColumn("item_id", F.col("to"))
    keys = shared_keys(items, newer, "item_id")
    hit = newer.select(*keys).distinct()
    return items.join(hit.withColumn("is_superseded", F.lit(True)), keys, "left").withColumn(
        "is_superseded", F.coalesce("is_superseded", F.lit(False))
    )
