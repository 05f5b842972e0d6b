"""The registered queries of this folder, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import fingerprints, jaccard, language, lines, neighbours, packing, pieces, quality, repair, scoring, sharding, toxicity, vectorcodes


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(by: int, value: int) -> Column:
    """Is the document in the part that is not learnt from? A null id is not, and is not learnt from either."""
    return F.coalesce(language.remainder("doc_id", by) == value, F.lit(False))


def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf)
    model = toxicity.fit(docs.filter(language.remainder("doc_id", 5) != 0), table(spark, sf, "labels"))
    rows = toxicity.score(docs, model, ["doc_id"], spans=True)
    return rows.select("doc_id", held_out(5, 0).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"), F.col("__spans").alias("spans"))


def op2(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.score(table(spark, sf), language.remainder("doc_id", 5) != 1, tokenizer_path("byte_bpe_50k.json"))
    return rows.withColumn("held_out", held_out(5, 1))


def op3(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf), 8)


def op4(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf), tokenizer_path("byte_bpe_50k.json"))


def op5(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf), k=4, percent=85)


def op6(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines.without_repeats(table(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", "text", F.col("__removed").alias("n_removed"))


def op7(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf), tokenizer_path("piece_bpe_32k.model"))


def op8(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.judge(table(spark, sf), table(spark, sf, "labels"), ["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select("doc_id", *[F.col(f"__{c}").alias(c) for c in names])


def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf)
    names, vectors = language.prototypes(docs.filter(language.remainder("doc_id", 3) != 1))
    rows = language.identify(docs, names, vectors, ["doc_id"])
    return rows.select("doc_id", held_out(3, 1).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op10(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op11(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.join(table(spark, sf), k=3, segments=16)


def op12(spark: SparkSession, sf: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op13(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return repair.repair(repair.damage(rows), rows)


NEAREST = """with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select q.vec_id as query_id, c.vec_id, list_distance(q.e, c.e) as score from (select distinct * from v) q join v c on q.vec_id <> c.vec_id and q.vec_id % 100 = 0)
select query_id, rank::int as rank, vec_id, score from
  (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d) where rank <= 10"""

QUERIES = {
    "op1_toxicity": (op1, None),
    "op2_scores": (op2, None),
    "op3_shards": (op3, None),
    "op4_packing": (op4, None),
    "op5_jaccard": (op5, None),
    "op6_lines": (op6, None),
    "op7_pieces": (op7, None),
    "op8_quality": (op8, None),
    "op9_language": (op9, None),
    "op10_neighbours": (op10, NEAREST),
    "op11_simhash": (op11, None),
    "op12_codes": (op12, vectorcodes.rounds_sql(rounds=6, parts=8, entries=16, scale=4096)),
    "op13_repair": (op13, None),
}
