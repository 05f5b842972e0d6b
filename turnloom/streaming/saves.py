"""Saves of captured documents: checked, stored by document, acknowledged.

A capture is (save_id, raw, saved_at): one JSON document as it came in. Each batch
is staged once; the checks of `operators.validate` decide per save. What passes is
appended to a log of its batch, what does not goes to the rejects with its issues,
and every save gets an acknowledgement. The store is the latest valid save of each
document over the newest compacted base and the batches behind it, so a document
that is captured again (same address, same id) replaces its old copy. A batch that
runs again overwrites its own folders and nothing else.
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnloom.operators import validate as V
from turnloom.operators.ordering import first_wins

KINDS = ("log", "rejects", "acks")
_SAVE = "save_id string, doc_id string, saved_at timestamp, raw string, created_at string, updated_at string"


def judged(captures: DataFrame) -> dict[str, DataFrame]:
    """log(save_id, doc_id, saved_at, raw, created_at, updated_at), rejects(save_id, severity, code, path) and
    acks(save_id, doc_id, status, errors, warnings) of captures(save_id, raw, saved_at). The doc_id is the document's own."""
    tables = V.stored(V.parse_documents(captures.select(F.col("save_id").alias("doc_id"), "raw")))
    issues = V.validate(tables).withColumnRenamed("doc_id", "save_id")
    counts = issues.groupBy("save_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    heads = tables.docs.select(F.col("doc_id").alias("save_id"), F.col("id").alias("doc_id"), "created_at", "updated_at")
    zero = F.lit(0).cast("bigint")
    known = heads.join(counts, "save_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("errors", "warnings")})
    known = known.withColumn("status", F.when(F.col("errors") > 0, "rejected").otherwise("saved"))
    good = captures.select("save_id", "raw", "saved_at").join(known.filter("status = 'saved'"), "save_id")
    bad = issues.join(known.filter("status = 'rejected'").select("save_id"), "save_id", "left_semi")
    return {
        "log": good.select("save_id", "doc_id", "saved_at", "raw", "created_at", "updated_at"),
        "rejects": bad.select("save_id", "severity", "code", "path"),
        "acks": known.select("save_id", "doc_id", "status", "errors", "warnings"),
    }


def latest_saves(log: DataFrame) -> DataFrame:
    """The latest save of each document (ties by save_id) with the earliest creation time of all its saves."""
    last = first_wins(log, ["doc_id"], [F.col("saved_at").desc(), F.col("save_id").desc()])
    born = log.groupBy("doc_id").agg(F.min("created_at").alias("__born"))
    return last.join(born, "doc_id").withColumn("created_at", F.col("__born")).drop("__born")


def save_documents(captures: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """The streaming job: `path/{log,rejects,acks}/batch_id=n`."""
    spark = captures.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        staged = f"{path}/staged/batch_id={batch_id}"
        batch.select("save_id", "raw", "saved_at").write.mode("overwrite").parquet(staged)
        for kind, rows in judged(spark.read.parquet(staged)).items():
            rows.write.mode("overwrite").parquet(f"{path}/{kind}/batch_id={batch_id}")

    return captures.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _parts(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing written yet
        return None


def _state(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """The rows that the store follows from, the batch up to which the base holds them, and the last batch."""
    base, log = _parts(spark, f"{path}/base"), _parts(spark, f"{path}/log")
    done = base.agg(F.max("upto")).first()[0] if base is not None else -1
    done = -1 if done is None else int(done)
    last = log.agg(F.max("batch_id")).first()[0] if log is not None else done
    rows = spark.createDataFrame([], _SAVE)
    names = rows.columns
    if base is not None:
        rows = rows.unionByName(base.filter(F.col("upto") == done).select(*names))
    if log is not None:
        rows = rows.unionByName(log.filter(F.col("batch_id") > done).select(*names))
    return rows, done, done if last is None else int(last)


def document_store(spark: SparkSession, path: str) -> DataFrame:
    """The store as it is now."""
    return latest_saves(_state(spark, path)[0])


def compact_saves(spark: SparkSession, path: str) -> int:
    """The store written as a new base; later reads take it and the batches behind it. Returns its last batch.

    Older bases and the batches they hold are read no more and may be deleted by the owner of the folder.
    """
    rows, done, last = _state(spark, path)
    if last > done:
        latest_saves(rows).write.mode("overwrite").parquet(f"{path}/base/upto={last}")
    return last
