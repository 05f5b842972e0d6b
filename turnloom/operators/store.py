"""The context table: upsert, lookup, retention, version history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators.ordering import first_n, first_wins, number_rows


def upsert(store: DataFrame, incoming: DataFrame, key: str = "doc_id", order: str = "updated_at") -> DataFrame:
    """The store after saving `incoming`: latest row per id, with the earliest creation time kept.

    Both parts are minima and maxima with map-side partials, so an id that is saved
    over and over does not gather in one task.
    """
    both = store.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    content = F.xxhash64(*[c for c in both.columns if c not in (key, order, "__new")])  # equal times: the same row on every run
    latest = first_wins(both, [key], [F.col("__new").desc(), F.col(order).desc(), content])
    born = both.groupBy(key).agg(F.min("created_at").alias("__born"))
    return latest.drop("__new").join(born, key).withColumn("created_at", F.col("__born")).drop("__born")


def get(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per asked id; unknown ids come back with nulls."""
    return ids.select(key).distinct().join(store, key, "left")


def delete(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The store without the ids, and for each id whether it was there."""
    gone = ids.select(key).distinct()
    known = store.select(key).distinct().withColumn("deleted", F.lit(True))
    return store.join(gone, key, "left_anti"), gone.join(known, key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def latest(store: DataFrame, n: int = 1) -> DataFrame:
    """Most recently updated first, id as tie-break: a distributed top-k."""
    return store.orderBy(F.col("updated_at").desc(), "doc_id").limit(n)


def listing(store: DataFrame) -> DataFrame:
    return store.orderBy(F.col("updated_at").desc(), "doc_id")


def first_ids(store: DataFrame, n: int = 20) -> DataFrame:
    """The ids offered when a lookup finds nothing."""
    return listing(store).select("doc_id").limit(n)


def keep_newest(df: DataFrame, n: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Retention by count, of the whole table or per key."""
    if keys:
        return first_n(df, keys, order, n)
    return df.orderBy(*order).limit(n)


def keep_latest_conversations(records: DataFrame, n: int) -> DataFrame:
    """Latest save per conversation, then the n newest of them."""
    last = first_wins(records, ["conv_id"], [F.col("saved_at").desc()])
    return last.orderBy(F.col("saved_at").desc(), "conv_id").limit(n)


def keep_young(df: DataFrame, ts: str, now: Column, days: int = 7) -> DataFrame:
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


# -- versions ----------------------------------------------------------------------


def commit(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append contents as the next versions of their conversation, in time order.

    `history(conv_id, version, message, ts, content)`, `incoming(conv_id, message, ts, content)`.
    """
    top = history.groupBy("conv_id").agg(F.max("version").alias("__top"))
    numbered = number_rows(incoming, ["conv_id"], F.date_trunc("hour", F.col("ts")), ["ts", "message"], "__n")
    added = numbered.join(top, "conv_id", "left").select(
        "conv_id",
        (F.coalesce("__top", F.lit(0)) + F.col("__n") + 1).cast("bigint").alias("version"),
        "message",
        "ts",
        "content",
    )
    return history.unionByName(added)


def is_checkpoint(version: Column) -> Column:
    return (version == 1) | (version % 10 == 0)


def as_of(history: DataFrame, version: int) -> DataFrame:
    """Content of each conversation at a version."""
    return first_wins(history.filter(F.col("version") <= version), ["conv_id"], [F.col("version").desc()])


def rollback(history: DataFrame, version: int, now: Column) -> DataFrame:
    """History with the content of `version` appended as the newest version."""
    top = history.groupBy("conv_id").agg(F.max("version").alias("__top"))
    back = history.filter(F.col("version") == version).join(top, "conv_id").select(
        "conv_id", (F.col("__top") + 1).cast("bigint").alias("version"),
        F.concat(F.lit("Rollback to version "), F.lit(str(version))).alias("message"), now.alias("ts"), "content",
    )
    return history.unionByName(back)


def version_changes(history: DataFrame) -> DataFrame:
    """Lines added and removed against the version before: a join on version - 1, which stays
    splittable for a conversation with any number of versions."""
    before = history.select("conv_id", (F.col("version") + 1).alias("version"), F.col("content").alias("__before"))
    joined = history.join(before, ["conv_id", "version"], "left")
    now, old = F.split("content", "\n"), F.split(F.coalesce("__before", F.lit("")), "\n")
    return joined.select(
        "conv_id", "version", is_checkpoint(F.col("version")).alias("is_checkpoint"),
        F.size(F.array_except(now, old)).cast("bigint").alias("lines_added"),
        F.size(F.array_except(old, now)).cast("bigint").alias("lines_removed"),
    )


def fingerprint(turns: DataFrame) -> DataFrame:
    """Order-aware fingerprint of each transcript from a sum: no transcript is gathered."""
    line = F.concat_ws(X.SEP, F.col("idx").cast("string"), "role", "content")
    return turns.groupBy("conv_id").agg(
        F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(X.id_number(line)).cast("string"))).alias("fingerprint")
    )


def changed(now: DataFrame, last: DataFrame) -> DataFrame:
    old = last.select("conv_id", F.col("fingerprint").alias("__last"))
    return now.join(old, "conv_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("__last"))).select("conv_id")
