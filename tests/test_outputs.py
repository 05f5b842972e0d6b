import json
import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import media, secrets
from turnloom.operators import analytics as AN
from turnloom.operators import documents as D
from turnloom.operators import render as RN
from turnloom.operators import safety
from turnloom.operators import search as SE
from turnloom.operators import store as ST
from turnloom.operators.items import resolve_provenance
from turnloom.operators.context import encode
from turnloom.session import cut
from turnloom.streaming import jobs as J


def parts_text(df, *order):
    rows = sorted(df.collect(), key=lambda r: tuple(r[c] for c in order))
    return "".join(r.text for r in rows)


def conversations(turns):
    return turns.groupBy("doc_id", "conv_id", "conv_pos").agg(F.count("*").alias("turn_count")).select(
        "*", F.lit("browser").alias("kind"), F.lit("chatgpt").alias("platform"), F.lit("A \"title\"").alias("title"), F.lit("https://x.example/1").alias("url"), F.lit("2025-01-01T00:00:00Z").alias("captured_at"))


def test_fragments_are_one_json_document_and_markdown_parts_read_as_a_page(turns):
    t = turns({"c1": [("user", "😀 hm.\nThe API must be versioned.\nI prefer Vue.")] + [("assistant", f"```ts\nlet a{i};\n```") for i in range(130)], "c2": [("system", "Always answer in English. Next step: ship it.")]})
    conv = conversations(t)
    items = cut(encode(t))
    env = D.assemble(conv, items, F.lit("2025-02-01T00:00:00Z"))
    full = items.join(conv.select("conv_id", "kind", "platform", "captured_at"), "conv_id").withColumn("created_at", F.lit("2025-02-01T00:00:00Z"))
    doc = json.loads(parts_text(D.json_fragments(env, conv, t, D.with_wire_spans(full, t)), "part", "p1", "p2", "p3", "p4"))
    assert [len(c["turns"]) for c in doc["conversations"]] == [131, 1] and len(doc["items"]) == items.count() == 133
    first = doc["items"][0]
    span, text = first["provenance"]["span"], doc["conversations"][0]["turns"][0]["content"].encode("utf-16-be")
    assert text[span["start"] * 2:span["end"] * 2].decode("utf-16-be") == first["content"] == "The API must be versioned."
    available = items.groupBy("doc_id").agg(F.count("*").alias("available_items"))
    page = parts_text(RN.render_markdown(env, conv, resolve_provenance(items, conv, t), available), "section", "conv_pos", "block")
    assert "- **MUST:** The API must be versioned. _(chatgpt · \"A \"title\"\" · turn 0 (user) · heuristic 0.70)_" in page
    assert "\n\n\n" not in page and page.endswith("```\n") and page.count("```ts") == 130 and page.index("## Constraints") < page.index("## Code")
    md = parts_text(RN.transcript(conv.filter("conv_id = 'c1'"), t.filter("conv_id = 'c1'"), "md"), "block")
    assert md.index("let a0;") < md.index("let a64;") < md.index("let a129;") and md.count("### Assistant") == 130
    assert len(json.loads(parts_text(RN.transcript(conv.filter("conv_id = 'c1'"), t.filter("conv_id = 'c1'"), "json"), "block"))["messages"]) == 131


def test_upsert_keeps_the_earlier_birth_and_delete_reports(spark):
    old = spark.createDataFrame([("a", 1, 1, "v1"), ("b", 2, 2, "v1")], "doc_id string, created_at int, updated_at int, v string")
    new = spark.createDataFrame([("a", 5, 5, "v2"), ("c", 6, 6, "v1")], old.schema)
    now = ST.upsert(old, new)
    assert {(r.doc_id, r.created_at, r.updated_at, r.v) for r in now.collect()} == {("a", 1, 5, "v2"), ("b", 2, 2, "v1"), ("c", 6, 6, "v1")}
    assert [r.doc_id for r in ST.listing(now).collect()] == ["c", "a", "b"]
    rest, told = ST.delete(now, spark.createDataFrame([("a",), ("zz",)], "doc_id string"))
    assert rest.count() == 2 and {(r.doc_id, r.deleted) for r in told.collect()} == {("a", True), ("zz", False)}


def test_secrets_are_found_and_never_shown(spark):
    made = {"GitHub Token": "ghp_" + "aB3" * 12, "OpenAI API Key": "sk-" + "proj-" + "x9Y" * 10, "AWS Access Key": "AKIA" + "ABCD1234EFGH5678", "Generic Secret": "4f9a8b7c6d5e4f3a2b1c0d9e"}
    rows = [(k, f'password = "{v}" end' if k == "Generic Secret" else f"here {v}") for k, v in made.items()] + [("clean", "no password here; token is a word"), ("weak", 'password = "aaaaaaaaaaaaaaaa"')]
    df = spark.createDataFrame(rows, "k string, text string")
    found = {(r.k, r.type) for r in safety.scan_table(df, ["k"], "text").collect()}
    assert found == {(k, k) for k in made}
    for r in df.select("k", secrets.redact_text(F.col("text")).alias("t")).collect():
        assert r.k not in made or made[r.k] not in r.t and f"[REDACTED:{r.k}]" in r.t


def walk(times, window):
    last, out = None, []
    for t in sorted(times):
        if last is None or t - last >= window:
            out.append(t)
            last = t
    return out


def test_debounce_equals_the_walk(spark):
    rnd = random.Random(5)
    rows, n = [], 0
    for key, count, span in (("hot", 4000, 6000), ("thin", 60, 100_000), ("tie", 300, 40)):
        for _ in range(count):
            rows.append((n, key, rnd.randrange(span)))
            n += 1
    df = spark.createDataFrame(rows, "id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for window, blocks in ((7, 3), (50, 2), (1, 64)):
        got = {}
        for r in AN.debounce(df, "key", "ts", "id", window, windows_per_block=blocks).collect():
            got.setdefault(r.key, []).append(r.s)
        for key in ("hot", "thin", "tie"):
            assert sorted(got[key]) == walk([s for _, k, s in rows if k == key], window), (key, window)


def test_prefix_search_and_incremental_index(spark, turns):
    t = turns({"a": [("user", "Redis sessions"), ("user", "sync service")], "b": [("user", "service only")]})
    index = SE.build_index(conversations(t), t)
    q = spark.createDataFrame([(1, "serv SY"), (2, "titl"), (3, "zzz")], "query_id int, query string")
    assert {(r.query_id, r.conv_id) for r in SE.search(index, q).collect()} == {(1, "a"), (2, "a"), (2, "b")}
    assert SE.remove_from_index(index, t.select("conv_id").filter("conv_id = 'a'")).select("conv_id").distinct().count() == 1


def test_templates_do_not_expand_values(spark):
    body = "Hi {{name}} {{topic: a b }}{{x:}}|{{gone}} {{name}}"
    r = spark.range(1).select(media.render_template(F.lit(body), F.create_map(F.lit("name"), F.lit("{{topic}}"))).alias("t"), media.template_variables(F.lit(body)).alias("v")).first()
    assert r.t == "Hi {{topic}} a b|{{gone}} {{topic}}" and [(v.name, v.default) for v in r.v] == [("name", None), ("topic", "a b"), ("x", None), ("gone", None)]


def test_streams_over_several_batches_equal_one_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, f"k{i % 3}", i * 4, i % 7) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, key string, s long, n long").withColumn("ts", F.timestamp_seconds("s"))
    for lo in (0, 30, 60):
        df.filter(F.col("event_id").between(lo, lo + 29)).coalesce(1).write.mode("append").parquet(src)
    stream = J.read_stream(spark, src, df.schema, files=1)
    saves = J.read_stream(spark, src, df.schema, files=1).select(F.col("key").alias("doc_id"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "event_id", "n")
    log, bad = str(tmp_path / "log"), str(tmp_path / "bad")
    J.ingest(saves, F.when(F.col("n") == 0, F.lit("empty")), log, bad, str(tmp_path / "c3")).awaitTermination()
    view = {r.doc_id: r for r in J.store_view(spark, log).collect()}
    good = [r for r in rows if r[3] != 0]
    for k in view:
        mine = [r for r in good if r[1] == k]
        assert view[k].event_id == max(mine)[0] and view[k].created_at.timestamp() == min(r[2] for r in mine)
    assert spark.read.parquet(bad).count() == len(rows) - len(good)


@pytest.mark.parametrize("fan", [1, 2, 5, 256])
def test_debounce_through_groups_of_blocks_equals_the_walk(spark, fan):
    """Few windows to a block and few blocks to a group; bursts, gaps over whole groups, ties and a key with most events."""
    rnd = random.Random(fan)
    rows, at = [], 0
    for i in range(4000):
        at += rnd.choice([0, 1, 1, 2, 3, 9, 10, 11, 25]) if rnd.random() > 0.01 else rnd.randrange(400, 3000)
        rows.append((i, "hot" if rnd.random() < 0.9 else rnd.choice("ab"), at))
    want, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t - last[k] >= 10:
            want.add(i)
            last[k] = t
    df = spark.createDataFrame(rows, "event_id long, key string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") - 20_000)).repartition(5)
    got = AN.debounce(df, "key", "ts", "event_id", 10, windows_per_block=4, fan=fan)
    assert {r.event_id for r in got.collect()} == want
