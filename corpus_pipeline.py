"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import jaccard, language, lines, packing, quality
from turnloom.llm.queries import tokenizer_path
from turnloom.llm.tables import stored


def _numbered(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` on docs whose further columns are numbered, so that their names meet no other; the result is named as before."""
    inside = [c if c in ("doc_id", "text", "lang", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*inside)).select(*inside).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a cutoff certified on the labels go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _numbered(docs, lambda rows: quality.judge(rows, labels, rows.columns).filter("__kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or less like their nearest language than any good document that it names, go.

    The cosine must reach the lowest of the documents labelled good that have the same
    nearest language, and `language.NOISE` in any case.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")

    def kept(rows: DataFrame) -> DataFrame:
        names, vectors = language.prototypes(rows)
        known = stored(language.identify(rows, names, vectors, rows.columns))
        lowest = known.join(good, "doc_id", "left_semi").groupBy("__lang").agg(F.min("__score").alias("__least"))
        least = F.greatest(F.lit((1 + language.NOISE) / 2), F.coalesce("__least", F.lit(0.0)))
        placed = known.join(F.broadcast(lowest), "__lang", "left")  # a row per language
        return placed.filter((F.col("__lang") != "und") & (F.col("__score") >= least))

    return _numbered(docs, kept)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words or more are cut out; a document that had lines and lost all of them goes."""

    def cut(rows: DataFrame) -> DataFrame:
        left = lines.without_repeats(rows)
        left = left.filter(~((F.col("__removed") > 0) & (F.trim(F.regexp_replace("text", "[\\x09-\\x0D]", " ")) == "")))
        if "n_chars" not in rows.columns:
            return left
        return left.withColumn("n_chars", F.when(F.col("__removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")))

    return _numbered(docs, cut)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids with their sequence and place."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

ORACLE_SQL = None  # the language profiles and the packing are not SQL; tests hold the operators and language_id against plain versions, run() as a whole not yet


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
