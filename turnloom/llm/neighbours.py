"""Nearest neighbours with randomly rotated one-bit codes and exact reranking.

A vector, less its block's mean and scaled to length 1, is rotated at random and
kept as one sign bit per dimension. The inner product with a query follows from
the bits up to a factor kept per vector, with an error known in size; so each
vector has a lower bound of its distance. Only vectors whose bound is not above
the k-th exact distance so far are compared in full.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.ordering import first_n

SPREAD = 4.0  # the bound allows for this many standard errors
PLANES = 6  # bits of a rotated query's components


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


class Codes:
    """One-bit codes of a block of vectors with their correction scalars."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.dim = vectors.shape[1]
        self.turn = rotation(self.dim)
        self.mean = vectors.mean(axis=0)
        moved = vectors - self.mean
        self.radius = np.sqrt((moved * moved).sum(axis=1))
        turned = (moved / np.where(self.radius > 0, self.radius, 1.0)[:, None]) @ self.turn
        bits = turned > 0
        self.words, self.ones = _packed(bits), bits.sum(axis=1)
        factor = np.abs(turned).sum(axis=1) / math.sqrt(self.dim)  # inner product of a vector with its own code
        self.factor = np.where(factor > 0, factor, 1.0)
        self.error = np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor / math.sqrt(max(self.dim - 1, 1))

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances, and lower bounds of them."""
        moved = query - self.mean
        length = math.sqrt(float((moved * moved).sum()))
        turned = moved @ self.turn
        low, high = float(turned.min()), float(turned.max())
        step = (high - low) / ((1 << PLANES) - 1) or 1.0
        steps = np.rint((turned - low) / step).astype(np.int64)
        planes = _packed((steps[None, :] >> np.arange(PLANES)[:, None]) & 1 == 1)
        dots = np.zeros(len(self.words), np.int64)
        for j in range(PLANES):
            dots += np.bitwise_count(self.words & planes[j]).sum(axis=1, dtype=np.int64) << j
        inner = (2 * (low * self.ones + step * dots) - (low * self.dim + step * float(steps.sum()))) / math.sqrt(self.dim)
        error = SPREAD * (length * self.error + step / math.sqrt(12) / self.factor) + 1e-9 * (1 + length)
        base = self.radius**2 + length**2
        guess = base - 2 * self.radius * inner / self.factor
        return guess, guess - 2 * self.radius * error - 1e-9 * (1 + base)

    def nearest(self, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact distances of the k nearest, ties to the smaller id."""
        guess, least = self.bounds(query)
        other = ids != own
        guess, least = np.where(other, guess, np.inf), np.where(other, least, np.inf)
        n = int(min(k, other.sum()))
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        first = np.argpartition(guess, n - 1)[:n]
        limit = self.distance(first, query).max()
        at = np.flatnonzero(least <= limit * limit * (1 + 1e-12))
        at = np.union1d(at, first)
        exact = self.distance(at, query)
        order = np.lexsort((ids[at], exact))[:n]
        return at[order], exact[order]

    def distance(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        gap = self.vectors[at] - query
        return np.sqrt((gap * gap).sum(axis=1))


def search(vectors: DataFrame, is_query: Column, k: int = 10, block_rows: int = 8192, query_rows: int = 16384) -> DataFrame:
    """The k nearest other vectors of each query: query_id, rank, vec_id, score.

    vectors(vec_id, embedding). Every usable vector is coded; vectors that are null,
    zero or hold null or non-finite components, and rows without a vec_id, take no
    part. Vectors of different length are never compared. The query set meets all
    vectors block by block; each block returns its k nearest, and of these the
    nearest stay. Every row is a candidate, repeated or not. Rows that repeat a query's
    vec_id are its own and are left out; with another vector they ask too, in one
    ranking per vec_id, and equal ones ask once.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    total, asked = rows.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("bigint"))).first()
    shards = max(1, math.ceil(total / block_rows))
    parts = max(1, math.ceil((asked or 0) / query_rows))
    coded = rows.select(
        "dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "v"
    )
    asking = rows.filter("q").select(
        "dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), "vec_id", "v"
    ).dropDuplicates(["dim", "shard", "vec_id", "v"])

    def block(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        if len(own) and len(queries):
            ids = own["vec_id"].to_numpy()
            codes = Codes(np.stack(own["v"].to_numpy()).astype(np.float64))
            for i, v in zip(queries["vec_id"].to_numpy(), queries["v"]):
                at, exact = codes.nearest(ids, np.asarray(v, np.float64), int(i), k)
                out.append((np.full(len(at), i), ids[at], exact))
        q, c, s = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": q, "vec_id": c, "score": s})

    keys = ["dim", "shard", "part"]
    found = coded.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(block, "query_id bigint, vec_id bigint, score double")
    best = first_n(found, ["query_id"], ["score", "vec_id"], k, "rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
