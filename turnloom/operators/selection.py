"""Choosing turns and items: expressions, strict and lenient selection, gates, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators.ordering import first_wins, shared_keys


_BLOCK = 1024
_BEYOND = 10**18  # what longer numbers count as: no chat has that many turns


def _number(digits: Column) -> Column:
    plain = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(F.length(plain) > 18, F.lit(_BEYOND)).otherwise(plain.try_cast("bigint"))


def parse_selection(selections: DataFrame, expr: str = "selection") -> tuple[DataFrame, DataFrame]:
    """`"1,3,5-7"` (1-based) per row -> intervals (key, lo, hi), 0-based with both ends, and the bad parts.

    A selection with any bad part selects nothing: it goes to the errors as a whole.
    """
    keys = [c for c in selections.columns if c != expr]
    parts = selections.select(
        *keys, F.posexplode(F.split(F.col(expr), ",")).alias("part", "__raw")
    ).withColumn("__p", X.strip(F.col("__raw")))
    low = _number(F.regexp_extract("__p", r"^(\d+)(?:-(\d+))?$", 1))
    high = F.coalesce(_number(F.regexp_extract("__p", r"^(\d+)(?:-(\d+))?$", 2)), low)
    blank = F.col("__p") == ""
    ranged = parts.withColumn("__lo", low).withColumn("__hi", high).filter(~blank)
    code = (
        F.when(F.col("__lo").isNull(), F.lit("bad_part"))
        .when(F.col("__lo") < 1, F.lit("below_one"))
        .when(F.col("__hi") < F.col("__lo"), F.lit("reversed"))
    )
    coded = ranged.withColumn("code", code)
    empty = selections.select(*keys).join(coded.select(*keys).distinct(), keys, "left_anti")
    errors = coded.filter(F.col("code").isNotNull()).select(*keys, "part", "code").unionByName(
        empty.select(*keys, F.lit(0).alias("part"), F.lit("empty").alias("code"))
    )
    good = coded.join(errors.select(*keys).distinct(), keys, "left_anti")
    return good.select(*keys, (F.col("__lo") - 1).alias("lo"), (F.col("__hi") - 1).alias("hi")).distinct(), errors


def positions(intervals: DataFrame) -> DataFrame:
    """The distinct positions of intervals (keys, lo, hi); a long one is spread over rows in blocks."""
    keys = [c for c in intervals.columns if c not in ("lo", "hi")]
    block = F.expr(f"explode(sequence(lo div {_BLOCK}, hi div {_BLOCK}))").alias("b")
    blocks = intervals.select(*keys, "lo", "hi", block)
    inside = F.sequence(F.greatest(F.col("lo"), F.col("b") * _BLOCK), F.least(F.col("hi"), F.col("b") * _BLOCK + (_BLOCK - 1)))
    return blocks.select(*keys, F.explode(inside).alias("pos")).distinct()


def _within_chats(turns: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions up to the last turn of each chat, and the intervals beyond it.

    Intervals are cut to the chat before they are spread, so `1-999999999` costs what the chat has.
    """
    last = turns.groupBy("conv_id").agg(F.max(F.col("idx").cast("bigint")).alias("last"))
    known = intervals.join(last, "conv_id", "left").withColumn("last", F.coalesce("last", F.lit(-1).cast("bigint")))
    inner = known.filter("lo <= last").select("conv_id", "lo", F.least("hi", "last").alias("hi"))
    beyond = known.filter("hi > last").select("conv_id", F.greatest(F.col("lo"), F.col("last") + 1).alias("lo"), "hi").distinct()
    return positions(inner), beyond


def select_turns(turns: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strict: kept turns keep their index; conversations with a position out of range keep nothing.

    What is missing comes as intervals (conv_id, lo, hi); they may overlap where the selection's do.
    """
    chosen, beyond = _within_chats(turns, intervals)
    holes = chosen.join(turns.select("conv_id", F.col("idx").cast("bigint").alias("pos")), ["conv_id", "pos"], "left_anti")
    missing = beyond.unionByName(holes.select("conv_id", F.col("pos").alias("lo"), F.col("pos").alias("hi")))
    usable = chosen.join(missing.select("conv_id").distinct(), "conv_id", "left_anti")
    kept = turns.withColumn("pos", F.col("idx").cast("bigint")).join(usable, ["conv_id", "pos"], "left_semi").drop("pos")
    return kept, missing


def select_turns_lenient(turns: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions out of range are ignored; a conversation left with none is reported."""
    chosen, _ = _within_chats(turns, intervals)
    kept = turns.withColumn("pos", F.col("idx").cast("bigint")).join(chosen, ["conv_id", "pos"], "left_semi").drop("pos")
    empty = intervals.select("conv_id").distinct().join(kept.select("conv_id").distinct(), "conv_id", "left_anti")
    return kept, empty


def select_items(
    items: DataFrame, annotations: DataFrame, relations: DataFrame, wanted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Keep chosen items with their annotations and the relations whose both ends stay.

    `wanted` is (doc_id, item_id). A document with an unknown id keeps nothing and is reported.
    """
    unknown = wanted.join(items.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti")
    usable = wanted.join(unknown.select("doc_id").distinct(), "doc_id", "left_anti")
    ids = usable.select("doc_id", "item_id")
    kept = items.join(usable, ["doc_id", "item_id"], "left_semi")
    notes = annotations.join(ids, shared_keys(annotations, ids, "item_id"), "left_semi")
    edges = relations
    for end in ("from", "to"):
        edges = edges.join(ids.withColumnRenamed("item_id", end), shared_keys(relations, ids, end), "left_semi")
    return kept, notes, edges, unknown


def review_mismatch(draft: DataFrame, draft_meta: DataFrame, chosen: DataFrame, totals: DataFrame) -> DataFrame:
    """Problems of a reviewed draft: other positions, other total, or turns outside the selection.

    Position sets are compared through a count and an order-free hash sum.
    """

    def signature(df, name):
        return df.groupBy("conv_id").agg(
            F.concat_ws(
                ":", F.count(F.lit(1)).cast("string"), F.sum(X.id_number(F.col("pos").cast("string"))).cast("string")
            ).alias(name)
        )

    a, b = signature(draft_meta.select("conv_id", "pos").distinct(), "a"), signature(chosen, "b")
    reviewed = draft_meta.groupBy("conv_id").agg(F.max("total").alias("draft_total"))
    both = a.join(b, "conv_id", "full").join(reviewed, "conv_id", "left").join(totals, "conv_id", "left")
    heads = both.select(
        "conv_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~F.col("a").eqNullSafe(F.col("b")), F.lit("selection_changed")),
                    F.when(~F.col("draft_total").eqNullSafe(F.col("total")), F.lit("total_changed")),
                )
            )
        ).alias("code"),
    )
    stray = (
        draft.select("conv_id", F.col("idx").cast("bigint").alias("pos"))
        .join(chosen, ["conv_id", "pos"], "left_anti")
        .select("conv_id", F.lit("stray_turn").alias("code"))
        .distinct()
    )
    return heads.unionByName(stray)


def matches_query(content: Column, query: Column) -> Column:
    """Every white-space separated term is contained, whatever the case; no term matches all."""
    terms = F.filter(F.split(F.lower(X.strip(query)), f"{X.WS}+"), lambda t: t != "")
    low = F.lower(content)
    return F.forall(terms, lambda t: F.contains(low, t))


def _flat(content: Column) -> Column:
    named = F.regexp_replace(content, r"(?s)```([A-Za-z0-9_+#-]+)[^\n]*\n.*?```", " [$1 block] ")
    plain = F.regexp_replace(named, r"(?s)```[^\n]*\n.*?```", " [code block] ")
    return X.strip(X.collapse(plain))


def preview(content: Column) -> Column:
    """One-line preview of a message: fences become `[lang block]`, 220 characters at most."""
    flat = _flat(content)
    cut = F.regexp_replace(F.left(flat, F.lit(220)), f"{X.WS}+$", "")
    return F.when(F.length(flat) > 220, F.concat(cut, F.lit("…"))).otherwise(flat)


def is_long(content: Column) -> Column:
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    return (F.length(_flat(content)) > 220) | (lines > 4) | F.contains(content, F.lit("```"))


def title_or_first_message(turns: DataFrame, titles: DataFrame, size: int = 80) -> DataFrame:
    """Title where there is one, else the start of the first user message, else a fixed text."""
    first = first_wins(turns.filter(F.col("role") == "user"), ["conv_id"], ["idx"]).select(
        "conv_id", F.left(X.strip(F.col("content")), F.lit(size)).alias("__first")
    )
    return titles.join(first, "conv_id", "left").withColumn(
        "title", F.coalesce(F.nullif("title", F.lit("")), F.nullif("__first", F.lit("")), F.lit("Conversation"))
    ).drop("__first")


def secret_gate(turns: DataFrame, findings: DataFrame, remote: bool, allow: bool = False) -> tuple[DataFrame, DataFrame]:
    """Conversations with findings do not go to a remote destination unless allowed.

    Returns what may go, and the 1-based message numbers that hold the rest back.
    """
    held = findings.select("conv_id", (F.col("idx") + 1).alias("message_number")).distinct()
    if not remote or allow:
        return turns, held.limit(0)
    return turns.join(held.select("conv_id").distinct(), "conv_id", "left_anti"), held


def size_gate(turns: DataFrame, max_chars: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """Conversations whose prompt would exceed the limit are refused whole, never cut."""
    prompt_size = F.sum(F.length(F.to_json(F.struct(F.lit("m").alias("ref"), "role", "content"))) + 8)
    sizes = turns.groupBy("conv_id").agg(prompt_size.alias("chars"))
    refused = sizes.filter(F.col("chars") > max_chars)
    return turns.join(refused.select("conv_id"), "conv_id", "left_anti"), refused.select(
        "conv_id", F.lit("input_too_large").alias("code"), "chars"
    )
