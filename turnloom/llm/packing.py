"""Training sequences of one length from documents: cut, then packed by column generation.

A document's ids are cut into full sequences and a rest; a rest longer than half
a sequence is cut at the half, so that every part has partners. The parts'
lengths, counted over the corpus, are a cutting-stock problem of bounded size
(`cutting.whole`). Each pattern takes so many parts of each length; parts are
ranked within their length over all tasks, and the rank names the sequence.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.llm.arrays import blocks
from turnloom.llm.byteids import byte_ids
from turnloom.llm.cutting import whole
from turnloom.llm.tables import stored

END = 0
BLOCK = 1 << 19  # bytes of text that are cut into chunks at once: the chunks and their ids take about 100 times as much


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    full, rest = divmod(n, capacity)
    half = capacity // 2
    return [capacity] * full + ([half, rest - half] if rest > half else [rest] if rest else [])


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Pieces with the digest of their ids, each numbered within its task and length."""
    schema = (
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, __task int, __at bigint"
        + (", ids array<int>" if keep_ids else "")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[int, int] = defaultdict(int)
        task = TaskContext.get().partitionId()
        end = np.array([END], np.uint32).tobytes()
        for block in blocks(batches, limit=BLOCK):
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "__at", "ids")}
            for row, raw in enumerate(byte_ids(tokenizer).encode(block.texts())):
                raw += end
                n, at = len(raw) // 4, 0
                for length in cuts(n, capacity):
                    own = raw[4 * at : 4 * (at + length)]
                    values = (row, at, length, zlib.crc32(own), n, seen[length])
                    for k, v in zip(out, values):
                        out[k].append(v)
                    if keep_ids:
                        out["ids"].append(np.frombuffer(own, np.uint32).astype(np.int32))
                    seen[length] += 1
                    at += length
            fields = {"doc_id": block.batch.column("doc_id").take(pa.array(out["row"], pa.int64()))}
            fields |= {k: pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens")}
            fields |= {"__task": pa.array(np.full(len(out["row"]), task, np.int32)), "__at": pa.array(out["__at"], pa.int64())}
            if keep_ids:
                fields["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(fields)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: from which rank a pattern takes parts, how many each time, and where."""
    rows, first = [], 0
    taken: defaultdict[int, int] = defaultdict(int)
    for pattern, times in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, taken[length], n, first, offset))
            taken[length] += n * times
            offset += length * n
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "first", "offset"), table.T))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    docs(doc_id, text). Ids are those of the tokenizer file and then id 0; a null
    text is the empty one, a single id. Rows that repeat, or share or lack a
    doc_id, are documents of their own. An empty table gives no rows.
    """
    parts = stored(pieces_of(docs, tokenizer, capacity, keep_ids))
    counts = parts.groupBy("length").count().collect()  # at most `capacity` rows
    demand = {int(r["length"]): int(r["count"]) for r in counts}
    full = demand.pop(capacity, 0)
    patterns = whole(demand, capacity)
    table = places(([({capacity: 1}, full)] if full else []) + patterns)

    tallies = parts.groupBy("__task", "length").agg((F.max("__at") + 1).alias("__n"))
    before = W.partitionBy("length").orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    shifts = tallies.select("__task", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = parts.join(shifts, ["__task", "length"]).withColumn("__rank", F.col("__before") + F.col("__at"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = table["length"] << 44 | table["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(start, length << 44 | rank, "right") - 1
            within = rank - table["rank"][i]
            fields = {c: batch.column(c) for c in names}
            fields["sequence_id"] = pa.array(table["first"][i] + within // table["each"][i])
            fields["offset"] = pa.array(table["offset"][i] + within % table["each"][i] * length)
            yield pa.RecordBatch.from_pydict(fields)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if keep_ids else [])
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if keep_ids else "") + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "__rank").mapInArrow(place, schema)
