"""Scoring extracted items against gold and forbidden specifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators.items import ITEM_ORDER
from turnloom.operators.matching import match_in_order
from turnloom.operators.ordering import first_wins, number_rows, shared_keys
from turnloom.session import cut

COUNTS = ("gold", "predicted", "matched", "origin_correct", "provenance_correct", "unsupported", "forbidden")


def _norm(c: Column) -> Column:
    return X.collapse(F.replace(F.lower(c), F.lit("’"), F.lit("'")))


def match_text() -> Column:
    """The text a keyword may be found in: the content and what identifies a link or a file."""
    extra = F.when(F.col("type") == "reference", F.concat_ws(" ", "uri", "title")).when(F.col("type") == "code_artifact", F.col("filename"))
    return _norm(F.concat_ws(" ", F.col("content"), F.nullif(extra, F.lit(""))))


def _holds_all(text: Column, words: Column) -> Column:
    return F.forall(words, lambda w: F.contains(text, w))


def _searchable(items: DataFrame) -> DataFrame:
    return items.withColumn("__text", match_text())


def gold_candidates(gold: DataFrame, items: DataFrame) -> DataFrame:
    """Gold rows with the items that carry all their keywords, in item order.

    `gold(doc_id, gpos, type, origin, message, match)`. The g gold rows of one type can
    use at most g items, so only the first g candidates of each are kept: nothing is lost.
    """
    wanted = gold.withColumn("words", F.transform("match", lambda w: _norm(w))).select("doc_id", "gpos", "type", "words")
    sizes = gold.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("g"))
    text = _searchable(items).select(
        "doc_id", "type", "item_id", F.struct("conv_pos", "idx", "rank", "seq", "item_id").alias("a_order"), "__text"
    )
    hits = text.join(wanted, ["doc_id", "type"]).filter(_holds_all(F.col("__text"), F.col("words")))
    placed = hits.select("doc_id", "type", "gpos", "item_id", "a_order")
    # hits of a gold row are numbered in blocks, so a keyword that every item holds is no single task
    numbered = number_rows(placed, ["doc_id", "gpos"], F.floor(F.col("a_order.conv_pos") / F.lit(64)), ["a_order"], "place")
    return numbered.join(sizes, ["doc_id", "type"]).filter("place < g").select("doc_id", "gpos", "item_id", "a_order")


def match_gold(gold: DataFrame, items: DataFrame) -> DataFrame:
    """One-to-one: each gold row, in order, takes its first unused item."""
    pairs = gold_candidates(gold, items).select(
        F.struct("doc_id", "item_id").alias("a"), "a_order", F.struct("doc_id", "gpos").alias("b"), F.struct("doc_id", "gpos").alias("b_order")
    )
    return match_in_order(pairs).select(F.col("b.doc_id").alias("doc_id"), F.col("b.gpos").alias("gpos"), F.col("a.item_id").alias("item_id"))


def forbidden_hits(forbidden: DataFrame, items: DataFrame) -> DataFrame:
    """Items that match a forbidden specification and its origin; the first one gives the reason."""
    wanted = forbidden.withColumn("words", F.transform("match", lambda w: _norm(w))).select(
        "doc_id", "fpos", "type", "origin", "words", "reason"
    )
    hits = _searchable(items).join(wanted, ["doc_id", "type", "origin"]).filter(_holds_all(F.col("__text"), F.col("words")))
    return first_wins(hits.select("doc_id", "item_id", "fpos", "reason"), ["doc_id", "item_id"], ["fpos"])


def evaluation_counts(gold: DataFrame, forbidden: DataFrame, items: DataFrame, turns: DataFrame) -> DataFrame:
    """The seven counts of each fixture (doc_id). Items are read by several joins, so they are stored once."""
    columns = ("doc_id", "item_id", "type", "content", "uri", "title", "filename", "origin", "turn_id", "start", "end", *ITEM_ORDER)
    items = cut(items.select(*columns))
    keys = shared_keys(items, turns, "turn_id")
    located = items.join(turns.select(*keys, F.col("idx").alias("t_idx"), F.length("content").alias("t_size")), keys, "left")
    facts = located.select("doc_id", "item_id", F.col("origin").alias("i_origin"), "t_idx", "t_size", F.col("end").alias("i_end"))
    matched = match_gold(gold, items).join(gold, ["doc_id", "gpos"]).join(facts, ["doc_id", "item_id"]).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if(F.col("i_origin") == F.col("origin")).alias("origin_correct"),
        F.count_if((F.col("t_idx") == F.col("message")) & (F.col("i_end") <= F.col("t_size"))).alias("provenance_correct"),
    )
    predicted = items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("predicted"), F.count_if(F.col("turn_id").isNull() | F.col("start").isNull()).alias("unsupported")
    )
    wanted = gold.groupBy("doc_id").agg(F.count(F.lit(1)).alias("gold"))
    banned = forbidden_hits(forbidden, items).groupBy("doc_id").agg(F.count(F.lit(1)).alias("forbidden"))
    ids = wanted.select("doc_id").unionByName(predicted.select("doc_id")).distinct()
    joined = reduce(lambda a, b: a.join(b, "doc_id", "left"), (wanted, predicted, matched, banned), ids)
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS])


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(1.0)).otherwise(F.try_divide(n, d))


def metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, attribution and provenance; an empty denominator counts as 1."""
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumn("precision", _ratio(F.col("matched"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("matched"), F.col("gold")))
        .withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(F.try_divide(2 * p * r, p + r)))
        .withColumn("attribution_accuracy", _ratio(F.col("origin_correct"), F.col("matched")))
        .withColumn("provenance_accuracy", _ratio(F.col("provenance_correct"), F.col("matched")))
    )


def report(counts: DataFrame) -> DataFrame:
    """Per-fixture rows and the micro-averaged TOTAL row from one grouping."""
    grouped = counts.groupingSets([[F.col("doc_id")], []], F.col("doc_id")).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in COUNTS], F.grouping("doc_id").alias("__all")
    )
    named = grouped.withColumn("fixture", F.when(F.col("__all") == 1, F.lit("TOTAL")).otherwise(F.col("doc_id")))
    return metrics(named.drop("__all", "doc_id"))
