"""Message trees (branching chats) as flat conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators.ordering import number_rows
from turnloom.session import cut


def ancestors(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv_id, node_id, depth): the path from each head up to its root.

    Pointer doubling: after k rounds a row knows the ancestor 2^k steps up, and the set of
    known path nodes doubles, so a chat of n messages takes log2(n) joins instead of n.
    `nodes(conv_id, node_id, parent_id)`, `heads(conv_id, node_id)`.
    """
    jumps = cut(
        nodes.filter(F.col("parent_id").isNotNull()).select("conv_id", "node_id", F.col("parent_id").alias("up"))
    )
    on_path = cut(heads.select("conv_id", "node_id", F.lit(0).cast("bigint").alias("depth")))
    stride = 1
    while True:
        further = on_path.join(jumps, ["conv_id", "node_id"]).select(
            "conv_id", F.col("up").alias("node_id"), (F.col("depth") + stride).alias("depth")
        )
        # a parent that points back into the path (broken input) adds nothing
        fresh = cut(further.join(on_path.select("conv_id", "node_id"), ["conv_id", "node_id"], "left_anti").dropDuplicates(["conv_id", "node_id"]))
        if fresh.isEmpty():
            return on_path
        on_path = cut(on_path.unionByName(fresh))
        over = jumps.select("conv_id", F.col("node_id").alias("up"), F.col("up").alias("up2"))
        jumps = cut(jumps.join(over, ["conv_id", "up"]).select("conv_id", "node_id", F.col("up2").alias("up")))
        stride *= 2


def part_text(parts: Column, content_type: Column) -> Column:
    """Text parts joined by blank lines; code content is fenced."""
    joined = F.array_join(F.filter(parts, lambda p: X.strip(p) != ""), "\n\n")
    return F.when((content_type == "code") & (joined != ""), F.concat(F.lit("```\n"), joined, F.lit("\n```"))).otherwise(joined)


def flatten(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """User and assistant messages with text on the path of each head, oldest first."""
    path = ancestors(nodes, heads)
    kept = path.join(nodes, ["conv_id", "node_id"]).filter(F.col("role").isin("user", "assistant") & (X.strip(F.col("content")) != ""))
    ordered = kept.withColumn("up_order", -F.col("depth"))
    numbered = number_rows(ordered, ["conv_id"], F.floor(F.col("up_order") / F.lit(1024)), ["up_order"], "idx")
    return numbered.select("conv_id", "node_id", F.col("idx").cast("int").alias("idx"), "role", "content")
