"""SimHash near-duplicates through an embedding into segment bit counts.

A fingerprint's segments are mapped to their numbers of set bits. One differing
bit moves that point by one step on the integer grid, so the Manhattan distance
of two points is never above the Hamming distance of the fingerprints. Every
fingerprint is listed in its own cell of the grid and in the cells one step
away: two points at Manhattan distance 2 or less share a cell, and cells with a
single fingerprint fall away.

In the cells left, the members are held against each other exactly. Two
fingerprints differ in at most two bits if, and only if, some fingerprint z is
at most one bit away from both; z's cell is one that they share. So the members
of a cell meet by the z of that cell, each with the least one there, and the
pairs are checked with a bit count. A cell of m members costs at most
`64 / segments` * m rows instead of m^2 pairs, and no link is lost, for a
component only needs each member's link to the least.

All tables here grow with the input, so no join sends one to the driver (`unsent`).
Equal fingerprints are one node. Work: 33 rows of two numbers per distinct
fingerprint at 16 segments, then at most 65 for those that share cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnloom.llm.arrays import IS_SPACE, LOWER, Block, blocks, columns
from turnloom.llm.tables import stored
from turnloom.operators.components import components
from turnloom.operators.ordering import first_wins
from turnloom.session import unsent

SEED = 42
LINK = 2  # differing bits; the meeting at a common neighbour is exact for two
CHUNK = 1 << 16  # shingles whose bits are counted at a time


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words A-Z folded with one space between, and each word's (start, end) there."""
    part = data[starts[0] : ends[-1]]
    inside = ~IS_SPACE[part]
    opens = np.zeros(len(part), np.int64)
    opens[starts - starts[0]] = 1
    stops = np.cumsum(ends - starts + 1) - 1
    out = np.full(int(stops[-1]) + 1, 0x20, np.uint8)
    out[np.cumsum(inside)[inside] - 1 + np.cumsum(opens)[inside] - 1] = LOWER[part[inside]]
    return out.tobytes(), stops - (ends - starts), stops


def fingerprints(block: Block, k: int) -> np.ndarray:
    """SimHash of each text: bit i is 1 if it is set in more than half of the shingle hashes."""
    texts, starts, ends = block.words()
    words = np.bincount(texts, minlength=block.n)
    ones = np.zeros((block.n, 64), np.int64)
    for a in range(0, len(texts), CHUNK):
        b = min(a + CHUNK + k - 1, len(texts))
        own = texts[a:b]
        joined, lo, hi = _joined(block.data, starts[a:b], ends[a:b])
        n = min(CHUNK, b - a)
        last = np.minimum(np.arange(n) + k - 1, len(own) - 1)
        short = words[own[:n]] < k
        first = np.concatenate(([a == 0 or texts[a - 1] != texts[a]], own[1:n] != own[: n - 1]))
        last = np.where(short, np.minimum(np.arange(n) + words[own[:n]] - 1, len(own) - 1), last)
        at = np.flatnonzero(np.where(short, first, (own[last] == own[:n]) & (np.arange(n) + k <= len(own))))
        if not len(at):
            continue
        view = memoryview(joined)
        h = np.array([xxhash.xxh64_intdigest(view[s:e], SEED) for s, e in zip(lo[at].tolist(), hi[last[at]].tolist())], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who = own[at]
        cuts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        ones[who[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    total = np.where(words < k, np.minimum(words, 1), words - k + 1)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def signed(docs: DataFrame, keep: list[str], k: int) -> DataFrame:
    """`row` (the named columns as one struct) and `fp` of every row; the text is cast to string."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield columns(block, ["row"], fp=fingerprints(block, k).view(np.int64))

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("fp", LongType())]))


def cells(nodes: DataFrame, segments: int) -> DataFrame:
    """(cell, seg, step, fp): the fingerprint's own cell (step 0) and those one step away."""
    width = 64 // segments
    room = width.bit_length()  # bits of a count from 0 to `width`
    if width * segments != 64 or room * segments > 63:
        raise ValueError("segments must be 1, 2, 4, 8 or 16")
    mask = (1 << width) - 1 if width < 64 else -1
    counts = F.expr(f"transform(sequence(0, {segments - 1}), i -> cast(bit_count(shiftrightunsigned(fp, {width} * i) & {mask}L) as bigint))")
    own = F.expr(f"aggregate(transform(c, (x, i) -> shiftleft(x, {room} * i)), 0L, (t, x) -> t + x)")
    near = F.expr(
        f"""flatten(transform(c, (x, i) -> array(
            if(x < {width}, named_struct('cell', own + shiftleft(1L, {room} * i), 'seg', i, 'step', 1), null),
            if(x > 0, named_struct('cell', own - shiftleft(1L, {room} * i), 'seg', i, 'step', -1), null))))"""
    )
    here = F.expr("array(named_struct('cell', own, 'seg', 0, 'step', 0))")
    placed = nodes.select("fp", counts.alias("c")).select("fp", "c", own.alias("own"))
    listed = placed.select("fp", F.explode(F.concat(here, near)).alias("e")).filter("e is not null")
    return listed.select("e.cell", "e.seg", "e.step", "fp")


def links(nodes: DataFrame, segments: int = 16) -> DataFrame:
    """(a, b): for every component of the distinct `nodes(fp)` enough links of at most two bits to join it."""
    width = 64 // segments
    grid = cells(nodes, segments)
    shared = grid.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("cell")
    meeting = F.expr(
        f"""if(step = 0, array(fp), transform(
            filter(sequence(0, {width - 1}), b -> (shiftright(fp, {width} * seg + b) & 1) = if(step = 1, 0, 1)),
            b -> fp ^ shiftleft(1L, {width} * seg + b)))"""
    )
    met = stored(grid.join(unsent(shared), "cell").select(F.explode(meeting).alias("z"), "fp"))
    least = met.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")).filter("a < hi").select("z", "a")
    pairs = met.join(unsent(least), "z").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK).distinct()


def _named(signs: DataFrame, segments: int) -> DataFrame:
    """(fp, component_id) from rows (fp, doc_id)."""
    nodes = stored(signs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(stored(links(nodes.select("fp"), segments))).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(unsent(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(unsent(names), "root").select("fp", "component_id")


def join(docs: DataFrame, k: int = 3, segments: int = 16) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs(doc_id, text).

    Words are runs of other characters than blank and tab to carriage return, A-Z
    folded; shingles of `k` words count as often as they occur; fewer words are one
    shingle. Null, empty and blank texts have fingerprint zero and link like any
    other. The component is the smallest doc_id reachable over links of two bits or
    fewer. Rows without a doc_id take part but name nothing: a group of them alone
    has a null one. Repeated rows and ids each give their row. A long text is
    hashed in slices of 65,536 shingles. Other columns of `docs` are not read, so
    their names don't matter.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signs = stored(signed(ids, ["doc_id"], k).select("row.doc_id", "fp"))
    out = signs.join(unsent(_named(signs, segments)), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, k: int = 3, segments: int = 16) -> DataFrame:
    """The rows of `docs`, columns of any name kept, without the others of each group.

    The smallest doc_id stays, of equal ones the smallest text; nulls come last.
    Texts without a word all stay: their equal fingerprints say nothing.
    """
    signs = stored(signed(docs, docs.columns, k))
    names = _named(signs.select("fp", F.col("row.doc_id").cast("bigint").alias("doc_id")), segments)
    text = F.col("row.text").cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    placed = signs.filter(worded).join(unsent(names), "fp")
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("f"), F.col("fp")))
    first = first_wins(placed.withColumn("group", group), ["group"], [F.col("row.doc_id").cast("bigint").asc_nulls_last(), text])
    return first.select("row.*").unionByName(signs.filter(~worded).select("row.*"))
