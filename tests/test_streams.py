"""Streams against the batch form of the same operator."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import analytics as AN
from turnloom.plans import streams as P
from turnloom.plans.streams import captures
from turnloom.streaming import jobs as J
from turnloom.streaming import saves as SV

SCHEMA = "event_id long, key string, ms long, text string"


def in_files(spark, rows, path, files):
    """The rows in the given order, a file each for equal shares, read one file per batch."""
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        part = spark.createDataFrame(rows[i : i + size], SCHEMA).withColumn("ts", F.timestamp_millis(F.col("ms") + 10**12)).coalesce(1)
        part.write.mode("append").parquet(path)
    whole = spark.read.parquet(path)
    return whole, J.read_stream(spark, path, whole.schema, files=1)


def run(stream, build, tmp_path, name):
    folder = tmp_path / name
    return J.run_in_order(stream, "ts", build, f"{folder}/out", f"{folder}/cp", f"{folder}/marks")


def test_sixty_thousand_shuffled_events_of_one_key(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "hot", rng.randrange(120_000) * 1000, "x") for i in range(60_000)]  # some times fall together
    whole, stream = in_files(spark, rows, str(tmp_path / "in"), 4)
    alerts = run(stream, lambda s: J.debounced_alerts(s, "key", "ts", "event_id", 10, "3 days"), tmp_path, "a")
    want = {r.event_id for r in AN.debounce(whole, "key", "ts", "event_id", 10).collect()}
    got = [r.event_id for r in alerts.collect()]
    assert set(got) == want and len(got) == len(want) > 9000
    chat = lambda s: s.select(F.col("key").alias("conv_id"), F.col("event_id").alias("position"), F.lit("user").alias("role"), "text", "ts").withColumnRenamed("text", "content")
    named = stream.withColumn("text", F.col("event_id").cast("string"))
    turns = run(named, lambda s: J.append_messages(chat(s), "ts", "3 days"), tmp_path, "m").collect()
    order = [str(i) for i, _, ms, _ in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert [r.content for r in sorted(turns, key=lambda r: r.idx)] == order and [r.idx for r in sorted(turns, key=lambda r: r.idx)] == list(range(60_000))


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_are_released_on_the_way_and_state_is_forgotten(spark, tmp_path, seed):
    """Disorder within the delay only: most is emitted before the end mark, and little waits."""
    rng = random.Random(seed)
    rows = sorted(((i, f"k{rng.randrange(6)}", rng.randrange(86_400) * 1000, "x") for i in range(3000)), key=lambda r: r[2] + rng.randrange(600_000))
    whole, stream = in_files(spark, rows, str(tmp_path / "in"), 6)
    build = lambda s: J.debounced_alerts(s, "key", "ts", "event_id", 45, "20 minutes")
    first = J.run_to_table(build(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    want = {r.event_id for r in AN.debounce(whole, "key", "ts", "event_id", 45).collect()}
    early = {r.event_id for r in first.collect()}
    assert early < want and len(early) > 0.9 * len(want)
    got = run(stream, build, tmp_path, "all")
    assert {r.event_id for r in got.collect()} == want
    # once the window behind the last alert has passed, a key leaves no state
    state = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "all" / "cp"))
    assert state.count() == 0


def test_idle_chats_leave_the_state(spark, tmp_path):
    rows = [(1, "a", 0, "x"), (2, "b", 1000, "x"), (3, "a", 5000, "x"), (4, "z", 200_000_000, "x"), (5, "z", 200_001_000, "x"), (6, "a", 200_002_000, "x")]
    _, stream = in_files(spark, rows, str(tmp_path / "in"), 6)
    chat = lambda s: s.select(F.col("key").alias("conv_id"), F.col("event_id").alias("position"), F.lit("user").alias("role"), F.col("text").alias("content"), "ts")
    got = run(stream, lambda s: J.append_messages(chat(s), "ts", "10 seconds", idle_seconds=3600), tmp_path, "m").collect()
    assert sorted((r.conv_id, r.idx) for r in got) == [("a", 0), ("a", 0), ("a", 1), ("b", 0), ("z", 0), ("z", 1)]
    kept = run(stream, lambda s: J.append_messages(chat(s), "ts", "10 seconds"), tmp_path, "k").collect()
    assert sorted((r.conv_id, r.idx) for r in kept) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("z", 0), ("z", 1)]


def shown(df):
    return sorted(map(repr, df.collect()))


def test_saves_equal_the_batch_through_compaction_and_repeats(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"text {c} {t}") for c in range(8) for t in range(rng.randrange(1, 12))]
    rng.shuffle(rows)
    src, out = str(tmp_path / "in"), str(tmp_path / "s")
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows[:0], schema).write.parquet(src)
    stream = J.read_stream(spark, src, spark.createDataFrame([], schema).schema, files=1)
    for lo, hi in ((0, 20), (20, 30), (30, len(rows))):
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.mode("append").parquet(src)
        SV.save_documents(captures(stream), out, str(tmp_path / "cp")).awaitTermination()
        want = SV.judged(captures(spark.createDataFrame(rows[:hi], schema)))
        assert shown(SV.document_store(spark, out)) == shown(SV.latest_saves(want["log"]).select(*SV.document_store(spark, out).columns))
        for kind in ("rejects", "acks"):
            assert shown(spark.read.parquet(f"{out}/{kind}").drop("batch_id")) == shown(want[kind])
        if hi == 20:
            assert SV.compact_saves(spark, out) == SV.compact_saves(spark, out)
    before = shown(SV.document_store(spark, out))
    SV.compact_saves(spark, out)
    assert shown(SV.document_store(spark, out)) == before and "robot" not in str(before)


def test_an_empty_store_has_no_documents(spark, tmp_path):
    assert SV.document_store(spark, str(tmp_path / "none")).count() == 0 and SV.compact_saves(spark, str(tmp_path / "none")) == -1


def test_a_table_of_several_files_is_read_as_a_stream(spark, tmp_path):
    """conversations as a folder of files: no turn may be lost, whatever the files are called."""
    rows = [(c, t, "user", f"word{c} turn{t}") for c in range(4) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.repartition(3).write.parquet(f"{tmp_path}/many/conversations.parquet")
    acks, bad = P.r1_acks(spark, f"{tmp_path}/many"), P.r1_save_rejects(spark, f"{tmp_path}/many")
    assert {r.save_id: r.status for r in acks.collect()} == {f"c{c}_t{t}": "rejected" if (c + t) % 6 in (1, 2) else "saved" for c, t, *_ in rows}
    assert {r.save_id for r in bad.collect()} == {f"c{c}_t{t}" for c, t, *_ in rows if (c + t) % 6 in (1, 2)}
    counts = {r.token: r.n for r in P.r8_index(spark, f"{tmp_path}/many").collect()}
    assert counts == {f"word{c}": 1 for c in range(4)} | {f"turn{t}": 4 for t in range(6)}
    assert P.r4_append(spark, f"{tmp_path}/many").count() == len(rows)
