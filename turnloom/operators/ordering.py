"""First-wins, last-N and numbering without pulling a group into one task.

`row_number() <= n` with a constant n lets Spark keep n rows per key before the
shuffle (WindowGroupLimit), so a key holding any share of the rows costs n rows
per task. Numbering every row of a group is done in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_keys(a: DataFrame, b: DataFrame, *names: str) -> list[str]:
    """The join keys for rows of documents: a chat may be saved in several, so doc_id is one wherever both sides have it."""
    return [*(["doc_id"] if "doc_id" in a.columns and "doc_id" in b.columns else []), *names]


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column | str]) -> DataFrame:
    return first_n(df, keys, order, 1)


def first_n(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column | str], n: int, position: str | None = None
) -> DataFrame:
    """The first n rows per key; `position` keeps the 1-based place as a column."""
    name = position or "__place"
    placed = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = placed.filter(F.col(name) <= n)
    return kept if position else kept.drop(name)


def number_rows(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column | str], name: str
) -> DataFrame:
    """0-based position of each row in its key, for keys of any size.

    `block` is a coarse value that never decreases along `order` (a time slice,
    a range of positions). Rows are numbered inside (key, block); block totals
    shift them. Only the totals of a key are ordered together.
    """
    marked = df.withColumn("__block", block)
    totals = marked.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inner = W.partitionBy(*keys, "__block").orderBy(*order)
    numbered = marked.withColumn("__in", F.row_number().over(inner))
    return (
        numbered.join(shifts, [*keys, "__block"])
        .withColumn(name, (F.col("__shift") + F.col("__in") - 1).cast("bigint"))
        .drop("__block", "__in", "__shift")
    )


def sums_before(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column | str], **values: Column) -> DataFrame:
    """Each named value summed over the rows before (0 for the first), for keys of any size.

    `block` never decreases along `order`. Rows are summed inside (key, block), and the
    block totals, few, are summed per key and added.
    """
    marked = df.withColumns({f"__v_{n}": v for n, v in values.items()})
    totals = marked.groupBy(*keys, block).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    earlier = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(*keys, block, *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__s_{n}") for n in values])
    inner = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = marked.join(shifts, [*keys, block])
    out = placed.withColumns({n: (F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0)) + F.col(f"__s_{n}")).cast("bigint") for n in values})
    return out.drop(*[f"__{x}_{n}" for x in "vs" for n in values])
