"""Streaming queries (R family): each reads a given table as a stream, runs to its end and is checked as a batch."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from turnloom.operators import search as SE
from turnloom.operators import validate as V
from turnloom.operators.ordering import first_wins
from turnloom.plans.outputs import _W9
from turnloom.session import checkpoint_dir
from turnloom.streaming import jobs as J
from turnloom.streaming import saves as SV


def _run_dir(spark) -> str:
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def _table(spark, sf, name):
    """A given table, one file or a folder of files, as a stream of files."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return J.read_stream(spark, f"{sf}/{name}.[p]arquet", schema)  # a pattern may name a file; a plain path of a stream must be a folder


def _events(spark, sf):
    e = _table(spark, sf, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _user(e):
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("doc_id"), "event_id", "ts", "value", "event_type")


def r1_ingest(spark, sf):
    base = _run_dir(spark)
    e = _user(_events(spark, sf)).select("doc_id", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "event_id", "value")
    check = F.when(F.col("value") < 5, F.lit("value_too_small"))
    J.ingest(e, check, f"{base}/log", f"{base}/rejects", f"{base}/cp").awaitTermination()
    return J.store_view(spark, f"{base}/log").select("doc_id", "created_at", "updated_at", "event_id")


def r1_rejects(spark, sf):
    base = _run_dir(spark)
    e = _user(_events(spark, sf)).select("doc_id", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "value")
    J.ingest(e, F.when(F.col("value") < 5, F.lit("value_too_small")), f"{base}/log", f"{base}/rejects", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/rejects").groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"))


def captures(t):
    """Every turn of a (streamed) conversations table saves its chat again, as a document with that turn.

    By the turn's place: 1 in 6 has a role that the format doesn't know, 1 in 6 is cut short, 1 in 6 is of a newer minor version.
    """
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    chat = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    save = F.concat(chat, F.lit("_t"), F.col("turn").cast("string"))
    kind = (F.col("conv_id") + F.col("turn")) % 6
    role = F.when(kind == 1, "robot").otherwise(F.col("role"))
    turn = F.struct(save.alias("id"), F.col("turn").cast("int").alias("index"), role.alias("role"), F.col("text").alias("content"))
    source = F.struct(F.lit("browser").alias("kind"), F.lit("chatgpt").alias("platform"))
    conv = F.struct(chat.alias("id"), source.alias("source"), at.alias("captured_at"), F.array(turn).alias("turns"))
    doc = F.to_json(F.struct(
        F.when(kind == 3, "0.2").otherwise("0.1").alias(V.VERSION_FIELD), F.concat(F.lit("doc-"), chat).alias("id"),
        F.struct(at.alias("created_at"), at.alias("updated_at")).alias("metadata"), F.array(conv).alias("conversations"), F.array().cast("array<string>").alias("items"),
    ))
    return t.select(save.alias("save_id"), F.when(kind == 2, F.left(doc, F.lit(40))).otherwise(doc).alias("raw"), F.timestamp_seconds("turn").alias("saved_at"))


@lru_cache(maxsize=16)
def _saved(spark, sf):
    base = _run_dir(spark)
    SV.save_documents(captures(_table(spark, sf, "conversations")), f"{base}/s", f"{base}/cp").awaitTermination()
    return f"{base}/s"


def r1_store(spark, sf):
    return SV.document_store(spark, _saved(spark, sf)).select("doc_id", "save_id", "created_at", "updated_at", F.md5("raw").alias("h"))


def r1_save_rejects(spark, sf):
    return spark.read.parquet(f"{_saved(spark, sf)}/rejects").select("save_id", "severity", "code", "path")


def r1_acks(spark, sf):
    return spark.read.parquet(f"{_saved(spark, sf)}/acks").select("save_id", "doc_id", "status", "errors", "warnings")


_SAVES = f"""saves as (select 'c' || conv_id as chat, 'c' || conv_id || '_t' || turn as save_id, turn, (conv_id + turn) % 6 as kind, role, text,
  strftime(to_timestamp(1700000000 + turn) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as stamp from conversations),
good as (select *, row_number() over (partition by chat order by turn desc) as rn, min(stamp) over (partition by chat) as born from saves where kind not in (1, 2))"""
_R1_STORE = f"""with {_SAVES} select 'doc-' || chat as doc_id, save_id, born as created_at, stamp as updated_at,
  md5('{{"{V.VERSION_FIELD}":"' || case kind when 3 then '0.2' else '0.1' end || '","id":"doc-' || chat || '","metadata":{{"created_at":"' || stamp || '","updated_at":"' || stamp
  || '"}},"conversations":[{{"id":"' || chat || '","source":{{"kind":"browser","platform":"chatgpt"}},"captured_at":"' || stamp || '","turns":[{{"id":"' || save_id || '","index":' || turn
  || ',"role":"' || role || '","content":' || to_json(text)::varchar || '}}]}}],"items":[]}}') as h from good where rn = 1"""
_R1_BAD = f"""with {_SAVES} select save_id, 'error' as severity, 'schema' as code, '$.conversations[0].turns[0].role' as path from saves where kind = 1
union all select save_id, 'error', 'not_an_object', '$' from saves where kind = 2"""
_R1_ACKS = f"""with {_SAVES} select save_id, case when kind <> 2 then 'doc-' || chat end as doc_id, case when kind in (1, 2) then 'rejected' else 'saved' end as status,
  (kind in (1, 2))::bigint as errors, (kind = 3)::bigint as warnings from saves"""


def r2_without_repeats(spark, sf):
    base = _run_dir(spark)
    e = _user(_events(spark, sf)).withColumn("key", F.concat_ws("-", "doc_id", "event_type"))
    return J.run_to_table(J.without_repeats(e, "key", "ts", "40 days").select("key"), f"{base}/out", f"{base}/cp")


def r3_snapshots(spark, sf):
    base = _run_dir(spark)
    e = _user(_events(spark, sf)).select("doc_id", "ts", "event_id")
    changes = J.run_to_table(J.latest_snapshots(e, "doc_id", "ts"), f"{base}/out", f"{base}/cp", "update")
    return first_wins(changes, ["doc_id"], [F.col("batch_id").desc()]).select("doc_id", "event_id")


def r4_append(spark, sf):
    base = _run_dir(spark)
    t = _table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conv_id"), F.col("turn").alias("position"), "role", F.col("text").alias("content"),
        F.timestamp_seconds(F.col("turn") + F.lit(1_600_000_000)).alias("ts"),  # a second per turn; chats are not in order of time between each other
    )
    with_rocksdb(spark)
    turns = J.run_in_order(t, "ts", lambda rows: J.append_messages(rows, "ts", "30 days"), f"{base}/out", f"{base}/cp", f"{base}/marks")
    return turns.select("conv_id", "idx", "role", F.md5("content").alias("h"))


def with_rocksdb(spark) -> None:
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)


def r5_alerts(spark, sf):
    base = _run_dir(spark)
    with_rocksdb(spark)
    e = _events(spark, sf).select("user_id", "ts", "event_id")
    out = J.run_in_order(e, "ts", lambda rows: J.debounced_alerts(rows, "user_id", "ts", "event_id", 12 * 3600, "40 days"), f"{base}/out", f"{base}/cp", f"{base}/marks")
    return out.select("event_id", F.col("key").cast("bigint").alias("user_id"))


def r6_counters(spark, sf):
    base = _run_dir(spark)
    e = _events(spark, sf).select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "ts")
    return J.run_to_table(J.running_counters(e, "event_type", "k", "ts"), f"{base}/out", f"{base}/cp", "complete")


def r7_daily(spark, sf):
    base = _run_dir(spark)
    return J.run_in_order(_events(spark, sf).select("ts"), "ts", lambda rows: J.daily(rows, "ts", "40 days"), f"{base}/out", f"{base}/cp", f"{base}/marks")


def r8_index(spark, sf):
    base = _run_dir(spark)
    t = _table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("text").alias("content"))

    def build(batch):
        return batch.select("conv_id", F.explode(F.array_distinct(SE.tokens(F.col("content")))).alias("token")).distinct()

    J.flush_index(t, f"{base}/log", f"{base}/cp", build, once=True).awaitTermination()
    return spark.read.parquet(f"{base}/log").select("conv_id", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def r9_sessions(spark, sf):
    base = _run_dir(spark)
    e = _events(spark, sf).select("user_id", "ts")
    out = J.run_in_order(e, "ts", lambda rows: J.sessions(rows, "user_id", "ts", "6 hours", "40 days"), f"{base}/out", f"{base}/cp", f"{base}/marks")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


_R1 = """with ok as (select 'u' || user_id as doc_id, ts, event_id from events where value >= 5)
select doc_id, min(ts) as created_at, max(ts) as updated_at, arg_max(event_id, ts) as event_id from ok group by doc_id"""

QUERIES = {
    "r1_capture_ingest": (r1_ingest, _R1),
    "r1_rejects": (r1_rejects, "select 'u' || user_id as doc_id, 'value_too_small' as code, count(*) as n from events where value < 5 group by 1"),
    "r1_r2_document_store": (r1_store, _R1_STORE),
    "r1_save_rejects": (r1_save_rejects, _R1_BAD),
    "r1_save_acks": (r1_acks, _R1_ACKS),
    "r2_without_repeats": (r2_without_repeats, "select distinct 'u' || user_id || '-' || event_type as key from events"),
    "r3_latest_snapshot": (r3_snapshots, "select 'u' || user_id as doc_id, arg_max(event_id, ts) as event_id from events group by user_id"),
    "r4_live_messages": (
        r4_append, "select 'c' || conv_id as conv_id, row_number() over (partition by conv_id order by turn) - 1 as idx, role, md5(text) as h from conversations"
    ),
    "r5_debounced_alerts": (r5_alerts, _W9),
    "r6_running_counters": (
        r6_counters, "select event_type, count(*) as total, sum(json_extract_string(props, '$.k')::bigint)::bigint as amount, max(ts) as last_at from events group by 1"
    ),
    "r7_daily_counts": (r7_daily, "select ts::date as day, count(*) as n from events group by 1"),
    "r8_index_flush": (
        r8_index,
        "select token, count(distinct conv_id) as n from (select conv_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) as token from conversations) where token <> '' group by 1",
    ),
    "r9_sessions": (
        r9_sessions,
        """with g as (select user_id, ts, (ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hours)::int as gap from events),
s as (select user_id, sum(coalesce(gap, 1)) over (partition by user_id order by ts) as sid from g),
n as (select user_id, sid, count(*) as n from s group by all) select user_id, count(*) as sessions, max(n) as longest from n group by 1""",
    ),
}
