"""Shards by a weighted hash tree of regions, racks and shards.

At each level the children of a node draw an exponential time each, from a hash
of the key and the child's name, divided by the weight of what lies below; the
earliest wins. Raising one child's weight only makes it win more often, so a
change moves rows into or out of the changed subtree and leaves every choice
inside other subtrees as it was. A shard that is added as a region of its own
takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.tables import stored
from turnloom.operators.ordering import number_rows

Leaf = tuple[str, str, int, float]  # region, rack, shard, weight


def topology(shards: int, per_rack: int = 2, racks: int = 2, base: int = 8) -> list[Leaf]:
    """`base` shards in regions of equal racks; every further shard is a region of its own."""
    per_region = per_rack * racks
    leaves: list[Leaf] = []
    for s in range(shards):
        if s < base:
            leaves.append((f"r{s // per_region}", f"k{s % per_region // per_rack}", s, 1.0))
        else:
            leaves.append((f"x{s}", "k0", s, 1.0))
    return leaves


def _time(key: Column, node: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{node}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(weight)


def _descend(key: Column, leaves: Sequence[Leaf], level: int, path: str) -> Column:
    """Shard below the node `path`, as one expression; only the branch that wins is evaluated."""
    if level == 2 and len(leaves) == 1:
        return F.lit(leaves[0][2])
    children: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        children.setdefault(str(leaf[level]), []).append(leaf)
    names = sorted(children)
    below = [
        F.lit(children[c][0][2]) if level == 2 else _descend(key, children[c], level + 1, f"{path}/{c}") for c in names
    ]
    if len(names) == 1:
        return below[0]
    times = [_time(key, f"{path}/{c}", sum(x[3] for x in children[c])) for c in names]
    first = F.array_min(F.array(*[F.struct(t.alias("t"), F.lit(i).alias("i")) for i, t in enumerate(times)]))["i"]
    return _pick(first, below)


def _pick(index: Column, values: list[Column]) -> Column:
    return reduce(lambda rest, iv: F.when(index == iv[0], iv[1]).otherwise(rest), list(enumerate(values))[:-1], values[-1])


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """Shard of a key; a null key is a key like any other."""
    live = [x for x in leaves if x[3] > 0]
    if not live:
        raise ValueError("no shard has a weight")
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), live, 0, "").cast("int")


def place(docs: DataFrame, shards: int) -> DataFrame:
    """Each document with its shard, its slot there, and its shard if there were one more.

    docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard. A
    null text has no bytes; its crc is that of the empty text. Slots count from 0
    in order of (doc_id, crc, size) within a shard; equal rows are interchangeable.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    ranged = rows.repartitionByRange("doc_id", "text_crc32", "size").withColumn("__part", F.spark_partition_id())
    placed = stored(
        ranged.withColumn("law", F.lit("key"))
        .withColumn("shard", shard_of(F.col("doc_id"), topology(shards)))
        .withColumn("grown_shard", shard_of(F.col("doc_id"), topology(shards + 1)))
    )
    numbered = number_rows(placed, ["shard"], F.col("__part"), ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
