"""Ways to shorten conversations to a text, by name: `compressor(conversations, turns) -> (conv_id, summary)`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.ordering import first_n
from turnloom.operators.render import compress

Compressor = Callable[[DataFrame, DataFrame], DataFrame]
_KNOWN: dict[str, Compressor] = {}


def register(name: str, compressor: Compressor) -> Compressor:
    """Makes a compressor known; a later one of the same name replaces it."""
    _KNOWN[name] = compressor
    return compressor


def last_turns(n: int = 6, size: int = 400) -> Compressor:
    """The last turns of each conversation, each cut to `size` characters."""

    def run(conversations: DataFrame, turns: DataFrame) -> DataFrame:
        kept = first_n(turns, ["conv_id"], [F.col("idx").desc()], n)
        line = F.struct("idx", F.concat(F.col("role"), F.lit(": "), F.left("content", F.lit(size))).alias("t"))
        texts = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("s"))  # n rows at most
        joined = texts.select("conv_id", F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("summary"))
        return conversations.select("conv_id").join(joined, "conv_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))

    return run


register("rules", compress)
register("last_turns", last_turns())


def summarise(conversations: DataFrame, turns: DataFrame, compressor: str | Compressor = "rules", max_chars: int | None = None) -> DataFrame:
    """(conv_id, summary, compressor, cut): one row per conversation, cut to `max_chars` and saying so."""
    run = _KNOWN[compressor] if isinstance(compressor, str) else compressor
    name = compressor if isinstance(compressor, str) else getattr(compressor, "__name__", "own")
    out = run(conversations, turns).select("conv_id", "summary")
    if max_chars is None:
        return out.select("conv_id", "summary", F.lit(name).alias("compressor"), F.lit(False).alias("cut"))
    return out.select("conv_id", F.left("summary", F.lit(max_chars)).alias("summary"), F.lit(name).alias("compressor"), (F.length("summary") > max_chars).alias("cut"))
