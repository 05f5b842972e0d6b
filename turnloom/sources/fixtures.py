"""Evaluation fixtures and recorded model outputs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import schema as S


def read_fixtures(spark: SparkSession, path: str, names: str = "*.eval.json") -> DataFrame:
    """The files of these names below `path`, one row per fixture; a file holds one or an array of them."""
    return spark.read.schema(S.EVAL_FIXTURE).option("multiLine", True).option("pathGlobFilter", names).option(
        "recursiveFileLookup", True
    ).json(path)


def fixture_turns(fixtures: DataFrame) -> DataFrame:
    """Selected turns of each fixture with their original index; the fixture is the document."""
    rows = fixtures.select(
        F.col("id").alias("doc_id"), F.col("id").alias("conv_id"), "selection", F.posexplode("conversation.messages").alias("idx", "m")
    ).filter(F.col("selection").isNull() | F.array_contains("selection", F.col("idx")))
    return rows.select(
        "doc_id", "conv_id", F.lit(0).cast("bigint").alias("conv_pos"), "idx",
        F.concat("conv_id", F.lit("_t"), F.col("idx").cast("string")).alias("turn_id"), F.col("m.role").alias("role"), F.col("m.content").alias("content"),
    )


def fixture_gold(fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    gold = fixtures.select(F.col("id").alias("doc_id"), F.posexplode("expected").alias("gpos", "g")).select("doc_id", "gpos", "g.*")
    bad = fixtures.select(F.col("id").alias("doc_id"), F.posexplode("forbidden").alias("fpos", "f")).select("doc_id", "fpos", "f.*")
    return gold, bad


def read_recorded(spark: SparkSession, path: str) -> DataFrame:
    """Recorded outputs: the file name without `.json` is the conversation id."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(
        F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("conv_id"), F.col("value").alias("output")
    )
