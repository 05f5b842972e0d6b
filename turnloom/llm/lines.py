"""Line dedup by windows of lines: later copies of runs of lines are deleted.

At every line that has a word the shortest run of lines with at least `words`
words starts, and another ends there. All these windows are joined by digest
(with the smallest line hash beside it, as a second hash); no minima are
selected. A run of `words` words or more that occurs twice is covered by the
windows inside it: a line with `words` words from it to the end of the run by
one that starts there, the lines behind by the one that ends with the run. So
each window is held against its first place only and nothing is extended.

Only DataFrame functions are used. Per line a row of hashes is shuffled; the
texts are shuffled once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.llm.tables import any_columns, stored

_KEY = ["__id", "__text"]
_WORD = r"[^\\x20\\x09-\\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """(__id, __text, a): the worded lines of each document as (i, h, w), i counting all lines."""
    all_lines = F.expr(f"transform(split(text, '\\n', -1), (x, i) -> struct(i as i, xxhash64(x) as h, regexp_count(x, '{_WORD}') as w))")
    rows = docs.filter("text is not null").select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), F.col("text").alias("text"))
    return rows.select(*_KEY, F.filter(all_lines, lambda x: x["w"] > 0).alias("a")).filter(F.size("a") > 0)


def _windows(lines: DataFrame, words: int) -> DataFrame:
    """One row per window: place (lines j to e) and fingerprint, of the shortest windows that start and of those that end at each line.

    All windows of a document are made inside one array of (j, e, print, digest) and
    only that is spread over rows: a row carries a window, not the document's lines.
    """
    add = f"(t, x) -> if(t.s < {words}, struct(t.s + x.w as s, t.n + 1 as n), t)"
    ahead = f"aggregate(slice(a, j + 1, {words}), struct(0 as s, 0 as n), {add})"
    behind = f"aggregate(reverse(slice(a, greatest(j - {words - 1}, 0) + 1, least(j + 1, {words}))), struct(0 as s, 0 as n), {add})"
    # a window that ends here is no new one if it is also the shortest that starts at its first line: without this line it is too short
    ends = f"if(q.b.s - a[j].w >= {words}, struct(j - q.b.n + 1 as j, j as e), null)"
    spans = f"filter(array(if(q.t.s >= {words}, struct(j as j, j + q.t.n - 1 as e), null), {ends}), x -> x is not null)"
    both = f"flatten(transform(array(struct({ahead} as t, {behind} as b)), q -> {spans}))"
    own = "transform(slice(a, p.j + 1, p.e - p.j + 1), x -> x.h)"
    marked = f"transform({both}, p -> transform(array({own}), o -> struct(p.j as j, p.e as e, array_min(o) as print, xxhash64(o) as digest))[0])"
    rows = lines.select(*_KEY, F.explode(F.expr(f"flatten(transform(sequence(0, size(a) - 1), j -> {marked}))")).alias("w"))
    return rows.select(*_KEY, "w.j", "w.e", "w.print", "w.digest")


def repeats(docs: DataFrame, words: int = 50) -> tuple[DataFrame, DataFrame]:
    """(lines, runs): the worded lines, and the windows (from, to) of each document that repeat an earlier place."""
    lines = stored(_lines(docs))
    found = stored(_windows(lines, words))
    place = F.struct(F.col("__id").isNull().alias("no"), "__id", "__text", "j", "e")
    firsts = found.groupBy("print", "digest").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = found.join(firsts.select("print", "digest", "f"), ["print", "digest"])
    same = F.col("__id").eqNullSafe(F.col("f.__id")) & (F.col("__text") == F.col("f.__text"))
    later = met.filter(~same | (F.col("j") > F.col("f.e")))
    return lines, later.select(*_KEY, F.col("j").cast("int").alias("from"), F.col("e").cast("int").alias("to"))


def _kept(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(__id, __text, __keep): slices (start, n) of all lines that stay, for documents that lose any."""
    by = W.partitionBy(*_KEY).orderBy("from", "to")
    seen = runs.distinct().withColumn("top", F.max("to").over(by.rowsBetween(W.unboundedPreceding, -1)))
    joined = seen.withColumn("new", F.when(F.col("top").isNull() | (F.col("from") > F.col("top") + 1), 1).otherwise(0))
    merged = joined.withColumn("g", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0))).groupBy(*_KEY, "g").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    per = merged.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("r"))
    here = lines.dropDuplicates(_KEY).select(F.col("__id").alias("id2"), F.col("__text").alias("text2"), "a")
    cuts = per.join(here, F.col("__id").eqNullSafe(F.col("id2")) & (F.col("__text") == F.col("text2"))).select(
        *_KEY, F.expr("transform(r, x -> struct(a[x.from].i as lo, a[x.to].i as hi))").alias("r")
    )
    gaps = "transform(r, (x, i) -> struct(if(i = 0, 0, r[i - 1].hi + 1) as start, x.lo - if(i = 0, 0, r[i - 1].hi + 1) as n))"
    return cuts.select(*_KEY, F.expr(f"concat({gaps}, array(struct(element_at(r, -1).hi + 1 as start, 1000000000 as n)))").alias("__keep"), F.expr("aggregate(r, 0, (t, x) -> t + x.hi - x.lo + 1)").alias("__removed"))


@any_columns("doc_id", "text")
def without_repeats(docs: DataFrame, words: int = 50) -> DataFrame:
    """`docs` with later copies of runs of `words` words or more cut out of `text`, and `__removed` (lines).

    Earlier means a smaller doc_id (null last), then the smaller hash of the text,
    then the earlier line. Lines without a word never start or end a run; inside a
    run they go with it. Within one document only places behind the first one are
    copies. Rows equal in doc_id and text count as one document and stay alike. A
    null or empty text stays as it is. The first place of a line is never deleted.
    A text of 100,000 lines is one row of line hashes and windows. Other columns
    may have any name; one called `__removed` is replaced.
    """
    lines, runs = repeats(docs, words)
    kept = _kept(lines, stored(runs)).select(F.col("__id").alias("__id2"), F.col("__text").alias("__text2"), "__keep", "__removed")
    rows = docs.withColumn("__text", F.xxhash64("text"))
    out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id2")) & (F.col("__text") == F.col("__text2")), "left")
    cut = F.expr("array_join(flatten(transform(__keep, g -> slice(split(text, '\\n', -1), g.start + 1, g.n))), '\\n')")
    return out.select(
        *[F.when(F.col("__keep").isNotNull(), cut).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce("__removed", F.lit(0)).alias("__removed"),
    )
