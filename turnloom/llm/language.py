"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is the product
of its letters' vectors, each shifted by its place; a document is the sum of
its n-grams, a language the sum of its documents. A document is compared with
all languages by cosine. Runs of other characters are one boundary sign.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.arrays import Block, blocks, columns
from turnloom.llm.tables import any_columns

DIM = 512
N = 3
BOUNDARY = 0x20
ROWS = 48  # documents per matrix product
KINDS = 16384  # different n-grams whose vectors are held at a time
BLOCK = 1 << 18  # bytes of text whose n-grams are made at once: their arrays take about 200 times as much
NOISE = 3 / DIM**0.5  # cosines of unlike texts have a standard deviation of about 1 / sqrt(DIM)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


@lru_cache(maxsize=1 << 16)
def letter_vector(code: int, dim: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([code, dim])).integers(0, 2, dim, dtype=np.int8)
    return 2 * bits - 1


def _signs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code) of lower-case letters with single boundaries, and letters per document."""
    texts = [f" {t.lower()} " for t in block.texts()]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(block.n), np.array([len(t) for t in texts], np.int64))
    letter = _letters()[codes]
    codes = np.where(letter, codes, BOUNDARY)
    keep = letter | np.concatenate(([True], letter[:-1])) | np.concatenate(([True], own[1:] != own[:-1]))
    return own[keep], codes[keep], np.bincount(own[letter], minlength=block.n)


def bundles(block: Block, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n-gram vectors per document (float32, exact: whole numbers), and letters per document."""
    own, codes, letters = _signs(block)
    out = np.zeros((block.n, dim), np.float32)
    m = len(codes) - n + 1
    if m <= 0:
        return out, letters
    known, local = np.unique(codes, return_inverse=True)
    at = np.flatnonzero(own[:m] == own[n - 1 :])
    gram = np.zeros(len(at), np.int64)
    for j in range(n):
        gram = gram * len(known) + local[at + j]
    kinds, kind = np.unique(gram, return_inverse=True)
    table = np.stack([letter_vector(int(c), dim) for c in known])
    doc = own[at]
    for start in range(0, len(kinds), KINDS):  # the vectors of a few kinds at a time, whatever the text holds
        vectors = np.ones((len(kinds[start : start + KINDS]), dim), np.int8)
        rest = kinds[start : start + KINDS]
        for j in range(n):  # from the last letter to the first
            vectors *= np.roll(table, j, axis=1)[rest % len(known)]
            rest = rest // len(known)
        here = slice(None) if len(kinds) <= KINDS else (kind >= start) & (kind < start + KINDS)
        of, which = doc[here], kind[here] - start
        for low in range(0, block.n, ROWS):
            a, b = np.searchsorted(of, [low, low + ROWS])
            if a < b:
                rows = min(ROWS, block.n - low)
                table_of = np.bincount((of[a:b] - low) * len(vectors) + which[a:b], minlength=rows * len(vectors)).reshape(rows, -1)
                used = np.flatnonzero(table_of.any(axis=0))
                out[low : low + rows] += table_of[:, used].astype(np.float32) @ vectors[used].astype(np.float32)
    return out, letters


def prototypes(docs: DataFrame, dim: int = DIM, n: int = N) -> tuple[list[str], np.ndarray]:
    """Languages and their vectors from docs(text, lang); rows without a language are not used.

    Each task adds up its documents; the sums of whole numbers do not depend on the
    order. The result has one vector per value of `lang`.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in blocks(batches, limit=BLOCK):
            own, _ = bundles(block, dim, n)
            for row, lang in enumerate(block.batch.column("lang").to_pylist()):
                sums[lang] = sums.get(lang, 0) + own[row].astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * dim, pa.string()), "i": np.arange(dim), "v": pa.array(v)})

    rows = docs.filter("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(add, "lang string, i bigint, v bigint").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).selectExpr("lang", "s.v as v").collect()
    names = sorted(r["lang"] for r in found)
    by = {r["lang"]: np.array(r["v"], np.float64) for r in found}
    return names, np.array([by[k] for k in names]).reshape(len(names), dim)


@any_columns("text")
def identify(docs: DataFrame, names: list[str], vectors: np.ndarray, keep: list[str]) -> DataFrame:
    """The named columns with `__lang` and `__score`, the cosine moved to 0..1.

    A null text, one without a letter, or a model without languages gives `und` and
    score 0. Of equal cosines the first language by name wins. Repeated rows each give
    their row. A text of any length is one block; the vectors of its n-grams are made
    `KINDS` at a time.
    """
    chosen = docs.select(*keep, *([] if "text" in keep else ["text"]))
    fields = [f for f in chosen.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["__lang string", "__score double"])
    dim = vectors.shape[1] if len(names) else DIM
    unit = (vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-300)).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            own, letters = bundles(block, dim, N)
            own = own.astype(np.float64)
            lengths = np.sqrt((own**2).sum(axis=1))
            if names:
                cosine = np.clip(own @ unit.T / np.maximum(lengths, 1e-300)[:, None], -1, 1)
                best = cosine.argmax(axis=1)
                score = (1 + cosine[np.arange(block.n), best]) / 2
            none = (letters == 0) | block.is_null | (not names)
            lang = [("und" if none[i] else names[best[i]]) for i in range(block.n)]
            yield columns(block, keep, __lang=pa.array(lang, pa.string()), __score=np.where(none, 0.0, score if names else 0.0))

    return chosen.mapInArrow(run, schema)


def remainder(key: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % by
