"""Secret findings as a table, and the report of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import secrets


def scan_table(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per finding; the text itself stays behind."""
    return df.select(*keys, F.explode(secrets.scan(F.col(text))).alias("f")).select(*keys, "f.*")


def scan_document(turns: DataFrame, items: DataFrame) -> DataFrame:
    """Turns are scanned, and only those items that have no turn, so nothing is reported twice."""
    a = scan_table(turns, ["doc_id", "conv_id", "turn_id", "idx"], "content").withColumn("location", F.lit("turn"))
    loose = items.filter(F.col("turn_id").isNull())
    b = scan_table(loose, ["doc_id", "item_id"], "content").withColumn("location", F.lit("item"))
    return a.unionByName(b, allowMissingColumns=True)


def safety_report(findings: DataFrame) -> DataFrame:
    """Counts per document and type with the warning to show."""
    per = findings.groupBy("doc_id", "type", "confidence").agg(F.count(F.lit(1)).alias("findings"))
    return per.withColumn(
        "warning",
        F.concat(F.col("findings").cast("string"), F.lit(" possible "), F.col("type"), F.lit(" ("), F.col("confidence"), F.lit(" confidence)")),
    )
