"""Full-text search with forward (prefix) matching over conversations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.ordering import first_n
from turnloom.session import cut

NOT_WORD = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def build_index(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Postings (field, token, conv_id). Each turn is tokenised where it lies; a conversation's
    text is never joined up."""
    title = conversations.select(F.lit("title").alias("field"), "conv_id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("token"))
    body = turns.select(F.lit("content").alias("field"), "conv_id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("token"))
    return title.unionByName(body).distinct()


def write_index(index: DataFrame, table: str, buckets: int = 256) -> None:
    """Postings bucketed by token, so that queries meet them without a shuffle of the index."""
    index.write.mode("overwrite").bucketBy(buckets, "token").sortBy("token").saveAsTable(table)


def write_search_tables(index: DataFrame, path: str) -> None:
    """Postings sorted by token over the files, so that a range of tokens is a part of them."""
    index.repartitionByRange("token").sortWithinPartitions("token", "field", "conv_id").write.mode("overwrite").parquet(f"{path}/postings")


def stored_matches(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(field, conv_id, hits) of one query over written postings.

    Each term is a condition on the start of the token that the Parquet scan takes: only
    the row groups whose range of tokens meets a term are read, whatever the index holds.
    """
    terms = [t for t in dict.fromkeys(re.split(r"[\W]+", query.lower())) if t]
    postings = spark.read.parquet(f"{path}/postings")
    if not terms:
        return postings.select("field", "conv_id", F.lit(0).cast("bigint").alias("hits")).limit(0)
    starts = [F.startswith("token", F.lit(t)) for t in terms]
    met = postings.filter(reduce(Column.__or__, starts))
    held = [F.max(s.cast("int")).alias(f"t{i}") for i, s in enumerate(starts)]
    hits = reduce(Column.__add__, [s.cast("bigint") for s in starts])
    per = met.groupBy("field", "conv_id").agg(F.sum(hits).alias("hits"), *held)
    return per.filter(reduce(Column.__add__, [F.col(f"t{i}") for i in range(len(terms))]) == len(terms)).select("field", "conv_id", "hits")


def prefix_matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, field, conv_id, hits): every term of the query is a prefix of some token of the field.

    Terms meet the vocabulary (distinct tokens), not the postings: each token is spread into
    its prefixes of the lengths that terms have and joined by equality, then the matching
    tokens fetch their postings, once per distinct term however many queries have it. A
    query takes the postings of its rarest term and looks its other terms up there.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = terms.groupBy("query_id").agg(F.sum("times").alias("n_terms"))
    distinct = terms.select("term").distinct()
    vocabulary = index.select("token").distinct()
    lengths = [r[0] for r in distinct.select(F.length("term")).distinct().collect()]  # as many as the longest term has letters
    cuts = [F.when(F.length("token") >= n, F.left("token", F.lit(n))) for n in lengths]
    prefixes = vocabulary.select("token", F.explode(F.array_compact(F.array(*cuts)) if cuts else F.array().cast("array<string>")).alias("term"))
    expanded = distinct.join(prefixes, "term").select("term", "token")
    met = cut(index.join(expanded, "token").groupBy("term", "field", "conv_id").agg(F.count(F.lit(1)).alias("tokens")))
    # a query can only match where its rarest term does
    sizes = met.groupBy("term", "field").agg(F.count(F.lit(1)).alias("places"))
    able = terms.join(sizes, "term").groupBy("query_id", "field").agg(F.count(F.lit(1)).alias("terms"), F.min_by("term", F.struct("places", "term")).alias("least"))
    able = able.join(wanted, "query_id").filter(F.col("terms") == F.col("n_terms")).select("query_id", "n_terms", "least", F.col("field").alias("f"))
    places = able.join(met, (F.col("least") == F.col("term")) & F.col("f").eqNullSafe(F.col("field"))).select("query_id", "n_terms", "f", F.col("conv_id").alias("c"))
    asked = places.join(terms.withColumnRenamed("term", "wanted"), "query_id")
    found = asked.join(met, (F.col("wanted") == F.col("term")) & F.col("f").eqNullSafe(F.col("field")) & F.col("c").eqNullSafe(F.col("conv_id")))
    per = found.groupBy("query_id", "n_terms", "field", "conv_id").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.col("tokens") * F.col("times")).alias("hits"))
    return per.filter(F.col("terms") == F.col("n_terms")).select("query_id", "field", "conv_id", "hits")


def search(index: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """Conversations of each query: the best per field, united over the fields."""
    best = first_n(prefix_matches(index, queries), ["query_id", "field"], [F.col("hits").desc(), "conv_id"], limit)
    return best.select("query_id", "conv_id").distinct()


def add_to_index(index: DataFrame, conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The index after (re-)indexing the given conversations."""
    return remove_from_index(index, conversations.select("conv_id")).unionByName(build_index(conversations, turns))


def remove_from_index(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("conv_id").distinct(), "conv_id", "left_anti").select("field", "conv_id", "token")


def union_fields(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()
