"""Vector codes: a small codebook per part of the vector, nearest entries by slice and intersect.

The entries of a codebook are sorted once per dimension; each place in that
order carries a 64-bit mask of the entries before it. For a vector and a radius,
two binary searches per dimension give the slice of entries within the radius
there, the two masks differ by exactly those entries, and the AND over the
dimensions leaves the entries in a box around the vector. The radius is the
distance to a guess (the best of the entries next to the vector in the
dimensions of widest spread), so every entry as near as the guess is in the box:
exact distances of the candidates settle the nearest, ties to the lower index.

All arithmetic is on whole numbers. Blocks whose numbers could leave 64 bits are
worked in Python's integers by the same code. Codebooks are `entries` rows of
the vector's length, kept by the driver and sent with the tasks; rows of the
table never leave them: each round adds up sums and counts per entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from turnloom.llm.tables import stored

LARGEST = 2.0**50  # components beyond it have no code: times the scale they leave 64 bits
GUESSES = 3
LIMB = 1 << 31
ROWS = 4096
FEW_LABELS = 100_000  # so many totals are broadcast, more are joined by a salted shuffle
SALTS = 32


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if one is too large."""
    fits = F.forall(vector, lambda x: F.abs(x.cast("double")) < LARGEST)
    return F.when(fits, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


@dataclass(frozen=True)
class Codebooks:
    """`parts[p][entry]` is a list of whole numbers; all parts have the same width."""

    parts: list[list[list[int]]]

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.parts for entry in part for x in entry).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The vector that a code stands for."""
        picks = bytes.fromhex(code)
        return [x for part, pick in zip(self.parts, picks) for x in part[pick]]


class Slices:
    """One part's entries, sorted per dimension, with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.order = order
        self.coords = np.take_along_axis(entries, order, 0)
        masks = np.bitwise_or.accumulate(np.uint64(1) << order.astype(np.uint64), axis=0)
        self.prefix = np.concatenate((np.zeros((1, entries.shape[1]), np.uint64), masks))
        spread = [int(x) for x in self.coords[-1] - self.coords[0]]
        self.widest = sorted(range(len(spread)), key=lambda j: -spread[j])[:GUESSES]

    def distances(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x - self.entries[entry]
        return (gap * gap).sum(axis=1)

    def guess(self, x: np.ndarray) -> np.ndarray:
        """Squared distance to an entry close in some dimension."""
        best = self.distances(x, np.zeros(len(x), np.int64))
        for j in self.widest:
            at = np.minimum(np.searchsorted(self.coords[:, j], x[:, j]), len(self.entries) - 1)
            best = np.minimum(best, self.distances(x, self.order[at, j]))
        return best

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries no farther than `radius` from x in every dimension."""
        mask = np.full(len(x), (1 << len(self.entries)) - 1, np.uint64)
        for j in range(x.shape[1]):
            lo = np.searchsorted(self.coords[:, j], x[:, j] - radius, "left")
            hi = np.searchsorted(self.coords[:, j], x[:, j] + radius, "right")
            mask &= self.prefix[hi, j] & ~self.prefix[lo, j]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row."""
        far = self.guess(x)
        root = np.array([math.isqrt(int(d)) for d in far], object) if far.dtype == object else np.sqrt(far.astype(np.float64)).astype(np.int64) + 1
        mask = self.candidates(x, root)
        pick, best = np.zeros(len(x), np.int64), far + 1
        for i in range(len(self.entries)):
            at = np.flatnonzero(mask >> np.uint64(i) & np.uint64(1))
            d = self.distances(x[at], np.full(len(at), i))
            less = d < best[at]
            pick[at[less]], best[at[less]] = i, d[less]
        return pick, best


class Assigner:
    """Codes of blocks of vectors under one set of codebooks."""

    def __init__(self, books: Codebooks):
        self.books = books
        self.n = len(books.parts)
        self.width = len(books.parts[0][0])
        self.top = max((abs(x) for part in books.parts for e in part for x in e), default=0)
        self.slices: dict[type, list[Slices]] = {}

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes (n, parts), error (n)) of vectors (n, parts * width)."""
        top = max(self.top, int(np.abs(values).max()) if values.size else 0)
        kind = np.int64 if 4 * top * top * self.n * self.width < 1 << 62 else object
        if kind not in self.slices:
            self.slices[kind] = [Slices(np.array(part, kind).reshape(len(part), self.width)) for part in self.books.parts]
        values = values.astype(kind)
        codes, error = np.zeros((len(values), self.n), np.uint8), np.zeros(len(values), kind)
        for p, part in enumerate(self.slices[kind]):
            codes[:, p], d = part.nearest(values[:, p * self.width : (p + 1) * self.width])
            error = error + d
        return codes, error


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, dim)


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """{(part, entry): (count, sums)} of the entries in use."""
    parts, width = len(books.parts), len(books.parts[0][0])
    size = len(books.parts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(books)
        count = np.zeros((parts, size), np.int64)
        sums = np.zeros((2, parts, size, width), np.int64)  # high and low limbs
        for _, values in _blocks(batches, parts * width):
            codes, _ = assign(values)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=size)
                own = values[:, p * width : (p + 1) * width]
                for limb, x in enumerate((own // LIMB, own % LIMB)):
                    np.add.at(sums[limb, p], codes[:, p], x)
        p, e = np.nonzero(count)
        where = np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p))
        yield pa.RecordBatch.from_pydict(
            {"part": where[0], "entry": where[1], "pos": where[2], "n": np.repeat(count[p, e], width), "hi": sums[0][where], "lo": sums[1][where]}
        )

    got = rows.select("v").mapInArrow(run, "part long, entry long, pos long, n long, hi long, lo long")
    totals = got.groupBy("part", "entry", "pos").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "hi", "lo")])
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in totals.collect():  # as many rows as the codebooks have numbers
        out.setdefault((r["part"], r["entry"]), (int(r["n"]), [0] * width))[1][r["pos"]] = int(r["hi"]) * LIMB + int(r["lo"])
    return out


def fit(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks from rows (vec_id, v), all of length `dim`; no rows give parts without entries."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    width = dim // parts
    books = Codebooks([[list(r["v"][p * width : (p + 1) * width]) for r in first] for p in range(parts)])
    for _ in range(rounds if first and width else 0):
        used = _sums(rows, books)
        books = Codebooks([
            [[s // used[p, e][0] for s in used[p, e][1]] if (p, e) in used else entry for e, entry in enumerate(part)]
            for p, part in enumerate(books.parts)
        ])
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The columns of rows(..., v) but v, with `code` and `error` (null beyond 64 bits)."""
    dim = len(books.parts) * len(books.parts[0][0])
    keep = [c for c in rows.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(books)
        for batch, values in _blocks(batches, dim):
            codes, error = assign(values)
            text, n = codes.tobytes().hex(), 2 * codes.shape[1]
            fields = {c: batch.column(c) for c in keep}
            fields["code"] = pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string())
            fields["error"] = pa.array([x if x < 1 << 63 else None for x in error.tolist()], pa.int64())
            yield pa.RecordBatch.from_pydict(fields)

    schema = [f for f in rows.schema.fields if f.name != "v"]
    return rows.mapInArrow(run, StructType([*schema, StructField("code", StringType()), StructField("error", LongType())]))


def with_label_error(rows: DataFrame) -> DataFrame:
    """`rows` with `label_error`: the errors summed over equal labels, nulls together."""
    summed = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = stored(rows.groupBy("label").agg(F.when(summed <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), summed).cast("bigint").alias("label_error")))
    totals = totals.withColumnRenamed("label", "label2")
    same = F.col("label").eqNullSafe(F.col("label2"))
    if totals.count() <= FEW_LABELS:
        return rows.join(F.broadcast(totals), same).drop("label2")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    many = totals.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(many, same & (F.col("salt") == F.col("salt2"))).drop("label2", "salt", "salt2")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors(vec_id, embedding, label).

    Rows whose vector is null or holds a null, NaN or infinite component are left
    out. Components are taken as floor(scale * x). The length that counts is that of
    the smallest vec_id whose length `parts` divides; rows of another length, or
    with a component of 2^50 or more in size, take no part and have a null code and
    error. Codebooks start from the `entries` (64 at most) smallest vec_ids, null
    last, equal ids by vector; fewer rows give fewer entries. Repeated rows count as
    often as they occur. An error beyond 64 bits is null and adds nothing to its
    label's sum; a sum beyond 64 bits is null. Vectors without components have code
    00... and error 0. Other columns are not read.
    """
    if not 0 < entries <= 64:
        raise ValueError("masks hold 1 to 64 entries")
    kept = vectors.filter(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "label", whole_numbers(F.col("embedding"), scale).alias("v")
    )
    kept = stored(kept)
    first = kept.filter(F.size("v") % parts == 0).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    fits = F.coalesce(F.size("v") == (len(first[0]["v"]) if first else -2), F.lit(False))
    books = fit(kept.filter(fits), len(first[0]["v"]) if first else 0, parts, entries, rounds)
    rest = kept.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    coded = encode(kept.filter(fits), books) if first else kept.filter(fits).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    rows = with_label_error(stored(coded.unionByName(rest)))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))


def rounds_sql(rounds: int = 6, parts: int = 8, entries: int = 16, scale: int = 4096) -> str:
    """The same by comparing every part with every entry, for DuckDB."""
    steps = [
        f"""k as materialized (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor({scale}.0 * x::double)::bigint) as v
          from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""p as materialized (select r, vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] as x from k, range({parts}) t(part))""",
        f"b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as e from p qualify entry < {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} as materialized (select r, part, x, min(struct_pack(d := d, i := entry)) as m from
              (select r, p.part, x, entry, list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - e[j]) * (x[j] - e[j])))::bigint as d
               from p join b{i} using (part)) group by r, part, x)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} as (select part, entry, list(((s - ((s % c) + c) % c) // c)::bigint order by j) as e from
                  (select part, m.i as entry, j, sum(x[j])::hugeint as s, count(*) as c from a{i}, range(1, (select max(len(x)) + 1 from p)) t(j) group by all) group by part, entry)"""
            )
            steps.append(f"b{i + 1} as materialized (select part, entry, coalesce(s{i}.e, b{i}.e) as e from b{i} left join s{i} using (part, entry))")
    steps.append(f"f as (select r, string_agg(printf('%02x', m.i), '' order by part) as code, sum(m.d)::bigint as error from a{rounds} group by r)")
    steps.append(
        f"h as (select sha256(string_agg(x::varchar, ',' order by part, entry, j)) as codebooks_sha256 from (select part, entry, unnest(e) as x, generate_subscripts(e, 1) as j from b{rounds}))"
    )
    return f"with {', '.join(steps)} select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from k join f using (r), h"
