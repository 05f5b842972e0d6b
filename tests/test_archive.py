"""Documents written and read back."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from turnloom.functions import text as X
from turnloom.operators import archive as AR
from turnloom.operators import validate as V
from turnloom.plans import modelled as M

CONV = "doc_id string, conv_id string, conv_pos long, kind string, platform string, title string, url string, captured_at string"
ENV = "doc_id string, context_id string, version string, title string, created_at string, updated_at string, created_by string"
ITEM = (
    "doc_id string, item_id string, i long, conv_id string, turn_id string, type string, content string, confidence double, strength string, status string, language string, "
    "filename string, uri string, title string, method string, agent string, start int, end int, origin string, assertion string, extractors array<string>, "
    "evidence array<struct<turn_id:string,start:int,end:int>>, mood string"
)
AT = "2025-01-01T00:00:00Z"


def tables(spark, turns, names):
    t = turns({"c1": [("user", '😀 say "hi"\n\\ we decided 🎉 to row.'), ("assistant", "x" * 300 + "￿ end")], "c2": [("user", "plain words here")]})
    rows = lambda df, names: df.join(spark.createDataFrame([(n,) for n in names], "new string")).withColumn("doc_id", F.col("new")).drop("new")
    t = rows(t, names)
    item = lambda d, n, i, turn, s, e, ev: (
        d, n, i, turn[:2], turn, "fact", f'it "is" {n}\n', 0.25, None, None, None, None, None, "t", "model", "m@1", s, e, "user", "explicit", ["rules", "model"], ev, "calm"
    )
    items = [x for d in names for x in (
        item(d, "i1", 0, "c1_t0", 2, 10, [("c1_t0", 2, 10), ("c1_t1", 290, 302), ("c2_t0", None, None)]), item(d, 'odd "id"', 7, "c1_t1", None, None, []), item(d, "i3", 9, "c1_t0", 13, 25, [("c1_t0", 13, 25)]),
    )]
    convs = [(d, c, p, "browser", "chatgpt", "T", "https://x.example", AT) for d in names for c, p in (("c1", 0), ("c2", 1))]
    merged = [(d, "i1", "model", "fact", "older", 0.5) for d in names]
    edges = [(d, "supersedes", "i1", "i3", "m") for d in names] + [(d, "same_evidence", "i3", "i1", "m") for d in names]
    return {
        "envelopes": spark.createDataFrame([(d, f"doc_{d}", "0.1", None, AT, AT, "a@1") for d in names], ENV),
        "conversations": spark.createDataFrame(convs, CONV), "turns": t, "items": spark.createDataFrame(items, ITEM),
        "merged": spark.createDataFrame(merged, "doc_id string, canonical_id string, extractor string, type string, content string, confidence double"),
        "relations": spark.createDataFrame(edges, "doc_id string, type string, from string, to string, source string"),
    }


def made(t):
    own = {"items": F.to_variant_object(F.struct("mood", F.struct(F.col("i").alias("x")).alias("deep"))), "docs": F.parse_json(F.lit('{"z":[1,null,{"y":"ü"}]}')),
           "conversations": F.parse_json(F.lit('{"model":"m"}'))}
    return AR.from_tables(**t, captured_at=F.lit(AT), created_at=F.lit(AT), open_fields=own)


def shown(df):
    return sorted(map(repr, df.select(*[F.to_json(F.col(c)).alias(c) if c in ("record", "open") else F.col(c) for c in df.columns]).collect()))


def dense(df, table):
    """Places as they come back: counted from 0."""
    from pyspark.sql import Window as W

    for n, k in enumerate(AR.KEYS[table]):
        if k != "item_id":
            df = df.withColumn(k, F.dense_rank().over(W.partitionBy("doc_id", *AR.KEYS[table][:n]).orderBy(k)))
    return df


@pytest.mark.parametrize("whole", [0, 1 << 20])
def test_every_record_comes_back(spark, turns, tmp_path, whole):
    a = made(tables(spark, turns, ["d1", "d2"]))
    AR.write(a, str(tmp_path / "w"), whole)
    b = AR.read(spark, str(tmp_path / "w"))
    assert bool(spark.read.text(str(tmp_path / "w" / "documents")).count()) == bool(whole)
    for name in AR.KEYS:
        assert shown(dense(getattr(a, name), name)) == shown(dense(getattr(b, name), name)), name


def test_tables_come_back_with_code_point_spans(spark, turns, tmp_path):
    t = tables(spark, turns, ["d1"])
    AR.write(made(t), str(tmp_path / "w"))
    got = AR.to_tables(AR.read(spark, str(tmp_path / "w")))
    names = ["doc_id", "item_id", "type", "content", "confidence", "title", "conv_id", "turn_id", "start", "end", "method", "agent", "origin", "assertion", "extractors"]
    want = t["items"].select(*names, F.when(F.size("evidence") > 0, F.col("evidence")).alias("evidence"))
    assert shown(got["items"].select(*names, "evidence")) == shown(want)
    assert shown(got["turns"].drop("open")) == shown(t["turns"].select("doc_id", "conv_id", "conv_pos", "idx", "turn_id", "role", "content"))
    assert shown(got["relations"]) == shown(t["relations"])


def test_written_documents_are_valid_json_for_any_reader(spark, turns, tmp_path):
    t = tables(spark, turns, ["d1"])
    AR.write(made(t), str(tmp_path / "w"))
    line = json.loads(spark.read.text(str(tmp_path / "w" / "documents")).first()[0])["document"]
    text = line["conversations"][0]["turns"][0]["content"].encode("utf-16-le")
    spans = [i["provenance"].get("span") for i in line["items"]]
    assert text[2 * spans[0]["start"] : 2 * spans[0]["end"]].decode("utf-16-le") == 'say "hi"' and spans[1] is None
    assert line["items"][0]["mood"] == "calm" and line["z"] == [1, None, {"y": "ü"}] and line["conversations"][1]["model"] == "m"
    assert set(line["extensions"][AR.EXTENSION]["items"]) == {"i1", 'odd "id"', "i3"}
    raw = AR.documents(AR.fragments(made(t)))
    # the format knows no such id; nothing else is wrong
    assert [(r.code, r.path) for r in V.validate(V.parse_documents(raw)).collect()] == [("schema", "$.items[1].id")]


def test_texts_that_are_no_documents_give_no_rows(spark):
    raw = spark.createDataFrame([("a", "[]"), ("b", "nope"), ("c", None), ("d", '{"id":"x"}'), ("e", '{"items":3,"conversations":{}}')], "doc_id string, raw string")
    a = AR.parse(raw)
    assert sorted(r.doc_id for r in a.docs.collect()) == ["d", "e"] and not a.items.count() + a.turns.count() + a.annotations.count() + a.relations.count()


def test_what_the_archive_reads_twice_is_stored(spark, tmp_path, monkeypatch):
    rows = [(c, t, "user", "Ünïted 😀 words.") for c in range(4) for t in range(16)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/t/conversations.parquet")
    sf = f"{tmp_path}/t"
    items, relations, _ = M.normalised(spark, sf)
    assert "regexp" not in relations._jdf.queryExecution().optimizedPlan().toString().lower()  # quotes are not looked for again
    kept, stored = AR.cut, []
    monkeypatch.setattr(AR, "cut", lambda df: stored.append(df.columns) or kept(df))
    back = M.read_back(spark, sf)
    assert [c[1] for c in stored] == ["i", "item_id", "r"]
    want = {(r.item_id, r.start, r.end) for r in M.reconciled(spark, sf)["items"].collect()}
    assert {(r.item_id, r.start, r.end) for r in back["items"].collect()} == want and len(want) > 10
    assert back["turns"].count() == 64


def written(spark, path, turns):
    rows = [(c, t, "user" if t % 2 else "assistant", "Plain words.") for c, n in turns.items() for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_each_model_item_supersedes_the_one_before(spark, tmp_path):
    """Every pair of neighbours is a link, over blocks of positions too."""
    sf, said = written(spark, tmp_path / "t", {1: 30, 2: 1, 12: 2500}), {}
    for r in sorted(M.script_rows(spark, sf).select("conv_id", "mpos", "ref").collect()):
        said.setdefault(r.conv_id, []).append(r.ref)
    want = [(c, i + 1, b, a) for c, refs in said.items() for i, (a, b) in enumerate(zip(refs, refs[1:]))]
    got = M.script_relations(spark, sf).select("conv_id", "rpos", "from", "to").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1500


def test_the_whole_chain_comes_back_from_the_archive(spark, tmp_path):
    sf = written(spark, tmp_path / "t", {1: 60, 2: 1, 12: 40})
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet/*.parquet')")
    fn, sql = M.QUERIES["k2_s4_round_trip_relations"]
    back = fn(spark, sf)
    assert compare(back, con, sql) is None and back.filter("type = 'supersedes'").count() > 20


def test_length_in_utf16_units(spark):
    texts = ["", "plain", "naïve café", "😀", "a😀é𝄞z" * 40, "\uffff\ue000", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.u16_length(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [(t, None if t is None else len(t.encode("utf-16-be")) // 2) for t in texts]
