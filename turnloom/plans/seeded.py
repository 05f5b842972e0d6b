"""The conversations table as turns, with one statement appended per turn.

The driver's turns are invented prose that triggers no rule, so every turn gets
a phrase picked by arithmetic on its key. The view grows with the table; no row
is left out. `SEEDED` is the same view for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.session import spread

PHRASES = (
    "Should we store seedlings in Porto?",
    "The jar must be labelled.",
    "Do not use vinegar.",
    "We should not stack crates.",
    "The oven should rest.",
    "I don't know if it must dry.",
    "I prefer rye flour.",
    "We decided to use sourdough.",
    "Please design a tasting menu.",
    "Next step: order more salt.",
    "We're planning a harvest feast.",
    "Our stack is written in pencil.",
    "See [Guide](https://a.example/g) and https://b.example/x.",
    "```ts src/r.ts\nexport const r = 1;\n```",
    "![img](https://c.example/i.png)",
    "",
)
CAPTURED = "2025-01-01T00:00:00Z"


def raw_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The table as it is, in the engine's turn layout."""
    return spread(_turns(spark, sf), "turn_id")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    return t.select(
        F.concat(F.lit("d"), F.floor(F.col("conv_id") / 10).cast("string")).alias("doc_id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conv_id"),
        F.col("conv_id").cast("bigint").alias("conv_pos"),
        F.col("turn").cast("int").alias("idx"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_t"), F.col("turn").cast("string")).alias(
            "turn_id"
        ),
        "role",
        F.col("text").alias("content"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")


def phrase_of(conv: str = "conv_pos", turn: str = "idx"):
    table = F.array(*[F.lit(p) for p in PHRASES])
    return F.get(table, ((F.col(conv) * 7 + F.col(turn)) % 16).cast("int"))


def seeded_turns(spark: SparkSession, sf: str) -> DataFrame:
    seeded = _turns(spark, sf).withColumn("content", F.concat(F.col("content"), F.lit("\n"), phrase_of()))
    return spread(seeded, "turn_id")


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation with the attributes a capture carries."""
    return turns.groupBy("doc_id", "conv_id", "conv_pos").agg(F.count(F.lit(1)).alias("turn_count")).select(
        "doc_id",
        "conv_id",
        "conv_pos",
        "turn_count",
        F.lit("browser").alias("kind"),
        F.when(F.col("conv_pos") % 2 == 0, "chatgpt").otherwise("claude").alias("platform"),
        F.concat(F.lit("Chat "), F.col("conv_pos").cast("string")).alias("title"),
        F.concat(F.lit("https://chat.example/c/"), F.col("conv_pos").cast("string")).alias("url"),
        F.lit(CAPTURED).alias("captured_at"),
    )


# -- the same for the checking engine -----------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


_PHRASE_LIST = "[" + ", ".join(_q(p) for p in PHRASES) + "]"

RAW = """raw_turns as (
  select 'd' || (conv_id // 10)::varchar as doc_id, 'c' || conv_id::varchar as conv_id, conv_id::bigint as conv_pos,
    turn::int as idx, 'c' || conv_id::varchar || '_t' || turn::varchar as turn_id, role, text as content
  from conversations)"""

SEEDED = (
    RAW
    + f""",
seeded as (
  select * exclude (content), content || chr(10) || {_PHRASE_LIST}[((conv_pos * 7 + idx) % 16)::int + 1] as content,
    {_PHRASE_LIST}[((conv_pos * 7 + idx) % 16)::int + 1] as phrase
  from raw_turns)"""
)

CONVS = """convs as (
  select doc_id, conv_id, conv_pos, count(*) as turn_count, 'browser' as kind,
    case when conv_pos % 2 = 0 then 'chatgpt' else 'claude' end as platform, 'Chat ' || conv_pos as title,
    'https://chat.example/c/' || conv_pos as url, '2025-01-01T00:00:00Z' as captured_at
  from seeded group by doc_id, conv_id, conv_pos)"""
