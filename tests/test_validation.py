import copy
import json
import re

from pyspark.sql import functions as F

from turnloom.operators import validate as V
from turnloom.plans import modelled as M
from turnloom.plans.registry import all_queries


def document():
    source = {"kind": "browser", "platform": "chatgpt"}
    turn = lambda i, role, c: {"id": f"c1_t{i}", "index": i, "role": role, "content": c}
    at = "2025-01-01T00:00:00Z"
    prov = {"source": source, "conversation_id": "c1", "turn_id": "c1_t0", "span": {"start": 0, "end": 20}, "captured_at": at, "extracted_by": {"method": "heuristic", "agent": "x@1"}}
    return {
        "context_version": "0.1", "id": "doc1", "metadata": {"created_at": at, "updated_at": at},
        "conversations": [{"id": "c1", "source": source, "captured_at": at, "turns": [turn(0, "user", "Do not use Firebase. 😀"), turn(1, "assistant", "OK")]}],
        "items": [{"id": "i1", "type": "constraint", "content": "Do not use Firebase.", "strength": "must_not", "confidence": 0.7, "created_at": at, "provenance": prov, "mood": {"a": 1}}],
    }


CASES = {
    "valid": (lambda d: None, set()),
    "missing": (lambda d: d["items"][0].pop("content"), {("schema", "$.items[0].content")}),
    "method": (lambda d: d["items"][0]["provenance"]["extracted_by"].update(method="magic"), {("schema", "$.items[0].provenance.extracted_by.method")}),
    "confidence": (lambda d: d["items"][0].update(confidence=1.5), {("schema", "$.items[0].confidence")}),
    "strength": (lambda d: d["items"][0].pop("strength"), {("schema", "$.items[0].strength")}),
    "type": (lambda d: d["items"][0].update(type="mood"), {("unknown_item_type", "$.items[0].type")}),
    "newer": (lambda d: (d.update(context_version="0.9"), d["items"][0].update(type="mood")), {("newer_minor_version", "$.context_version"), ("unknown_item_type", "$.items[0].type")}),
    "no version": (lambda d: d.pop("context_version"), {("missing_version", "$.context_version")}),
    "odd version": (lambda d: d.update(context_version="one"), {("invalid_version", "$.context_version")}),
    "major": (lambda d: d.update(context_version="2.0"), {("unsupported_major_version", "$.context_version")}),
    "older": (lambda d: d.update(context_version="0.0"), {("requires_upgrade", "$.context_version")}),
    "same id": (lambda d: d["items"][0].update(id="c1_t1"), {("duplicate_id", "$.items[0].id")}),
    "doc id": (lambda d: d["items"][0].update(id="doc1"), {("duplicate_id", "$.items[0].id")}),
    "conversation": (lambda d: d["items"][0]["provenance"].update(conversation_id="c9"), {("unknown_conversation", "$.items[0].provenance.conversation_id")}),
    "turn": (lambda d: d["items"][0]["provenance"].update(turn_id="c1_t9"), {("unknown_turn", "$.items[0].provenance.turn_id")}),
    "alone": (lambda d: d["items"][0]["provenance"].pop("conversation_id"), {("turn_without_conversation", "$.items[0].provenance.turn_id")}),
    "reversed": (lambda d: d["items"][0]["provenance"].update(span={"start": 5, "end": 5}), {("invalid_span", "$.items[0].provenance.span")}),
    "utf16 end": (lambda d: d["items"][0]["provenance"].update(span={"start": 0, "end": 23}), set()),
    "beyond": (lambda d: d["items"][0]["provenance"].update(span={"start": 0, "end": 24}), {("invalid_span", "$.items[0].provenance.span")}),
    "no turn": (lambda d: d["items"][0]["provenance"].pop("turn_id"), {("span_without_turn", "$.items[0].provenance.span")}),
    "calendar": (lambda d: d["metadata"].update(updated_at="2025-02-30T00:00:00Z"), {("invalid_timestamp", "$.metadata.updated_at")}),
    "offset": (lambda d: d["metadata"].update(updated_at="2025-02-03T00:00:00"), {("invalid_timestamp", "$.metadata.updated_at")}),
    "index": (lambda d: d["conversations"][0]["turns"][1].update(index=0), {("duplicate_turn_index", "$.conversations[0].turns[1].index")}),
    "order": (lambda d: d["metadata"].update(updated_at="2024-01-01T00:00:00Z"), {("timestamp_order", "$.metadata.updated_at")}),
    "source": (lambda d: d["items"][0]["provenance"].update(source={"kind": "cli", "platform": "x"}), {("source_mismatch", "$.items[0].provenance.source")}),
}


def test_each_fault_gives_its_issue(spark):
    rows = [("broken", "{nope"), ("list", "[1]")]
    for name, (tamper, _) in CASES.items():
        d = copy.deepcopy(document())
        tamper(d)
        rows.append((name, json.dumps(d)))
    rows.append(("tail", json.dumps(document()) + " and more"))
    t = V.stored(V.parse_documents(spark.createDataFrame(rows, "doc_id string, raw string")))
    got = {}
    for r in V.validate(t).collect():
        got.setdefault(r.doc_id, set()).add((r.code, r.path))
    for name, (_, want) in CASES.items():
        assert got.get(name, set()) == want, name
    assert got["broken"] == got["list"] == got["tail"] == {("not_an_object", "$")}
    extras = t.items.filter("doc_id = 'valid'").select(F.expr("variant_get(extras, '$.mood.a', 'int')")).first()[0]
    assert extras == 1


def test_turn_of_another_conversation(spark):
    d = document()
    other = copy.deepcopy(d["conversations"][0])
    other["id"] = "c2"
    for t in other["turns"]:
        t["id"] = t["id"].replace("c1", "c2")
    d["conversations"].append(other)
    d["items"][0]["provenance"]["turn_id"] = "c2_t0"
    issues = V.validate(V.parse_documents(spark.createDataFrame([("x", json.dumps(d))], "doc_id string, raw string"))).collect()
    assert [(r.code, r.severity) for r in issues] == [("turn_not_in_conversation", "error")]


def test_upgrade_chain(spark):
    docs = spark.createDataFrame([("a", "0.0"), ("b", "0.1"), ("c", "3.0"), ("d", "0.7")], "doc_id string, version string")
    mark = lambda n: (lambda d: d.withColumn("seen", F.concat("seen", F.lit(n))))
    docs = docs.withColumn("seen", F.lit(""))
    chain = [V.Upgrade("0.0", "0.2", mark("x")), V.Upgrade("0.2", "0.5", mark("y"))]
    good, bad = V.upgrade(docs, chain, current="0.5")
    assert {r.doc_id: (r.version, r.seen) for r in good.collect()} == {"a": ("0.5", "xy"), "d": ("0.7", "")}
    assert {r.doc_id: r.code for r in bad.collect()} == {"b": "no_upgrade_path", "c": "unsupported_major_version"}
    loop = [V.Upgrade("0.0", "0.1", mark("x")), V.Upgrade("0.1", "0.0", mark("y"))]
    _, stuck = V.upgrade(docs.filter("doc_id = 'a'"), loop, current="0.5")
    assert stuck.first().code == "upgrade_cycle"


def test_lists_must_be_there_and_be_lists(spark):
    good = {"context_version": "0.1", "id": "d", "metadata": {"created_at": "2025-01-01T00:00:00Z", "updated_at": "2025-01-01T00:00:00Z"}, "conversations": [], "items": []}
    conv = {"id": "c", "source": {"kind": "cli", "platform": "p"}, "captured_at": "2025-01-01T00:00:00Z"}
    cases = {
        "none": {k: v for k, v in good.items() if k not in ("conversations", "items")}, "text": good | {"conversations": "[]", "items": "x"}, "object": good | {"conversations": {}, "items": {"a": 1}},
        "null": good | {"conversations": None, "items": None}, "turns": good | {"conversations": [conv, conv | {"turns": {}}, conv | {"turns": []}]}, "good": good,
    }
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], "doc_id string, raw string")
    got = {(r.doc_id, r.path) for r in V.validate(V.parse_documents(raw)).filter("code = 'schema'").collect()}
    both = {(n, p) for n in ("none", "text", "object", "null") for p in ("$.conversations", "$.items")}
    assert got == both | {("turns", "$.conversations[0].turns"), ("turns", "$.conversations[1].turns")}


def test_places_of_items_beyond_an_int(spark, tmp_path):
    """Chats whose keys lie far apart: the same faults at the same places, shifted."""
    far = 579_600  # every choice by arithmetic repeats after so many chats
    rows = [(c + by, t, "user", "Some words.") for c in range(10, 50) for t in range(8) for by in (0, far)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/t/conversations.parquet")
    sf = f"{tmp_path}/t"
    found = [(int(r.doc_id[1:]), r.severity, r.code, r.path) for r in V.validate(M.tampered(spark, sf)).collect()]
    shift = lambda p: re.sub(r"(conversations|items)\[(\d+)\]", lambda m: f"{m[1]}[{int(m[2]) + far * (100_000 if m[1] == 'items' else 1)}]", p)
    low = [x for x in found if x[0] < far // 10]
    assert sorted((d + far // 10, s, c, shift(p)) for d, s, c, p in low) == sorted(x for x in found if x[0] >= far // 10)
    assert {"unknown_item_type", "duplicate_id", "duplicate_turn_index", "span_without_turn", "source_mismatch", "invalid_timestamp"} <= {x[2] for x in low}
    assert sum(r.n for r in M.v14_format(spark, sf).collect()) == len(found)
    assert {int(r.doc_id[1:]) for r in M.v11_upgrade(spark, sf).collect() if r.code is None} >= {1, 1 + far // 10}


def test_queries_on_chats_beyond_an_int(spark, tmp_path):
    """Each query gives as much for chats whose items' places pass an int as for the same chats near zero."""
    far = 579_600
    rows = [(c + by, t, "user", "Some words.") for c in range(10, 50) for t in range(8) for by in (0, far)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/u/conversations.parquet")
    run = all_queries()
    for name in (
        "v11_upgrade", "v1_version_gate", "v2_unknown_types", "v3_structure", "v4_timestamps", "v5_timestamp_order", "v6_duplicate_ids",
        "v7_duplicate_turn_index", "v8_references",
    ):
        docs = [int(r.doc_id[1:]) for r in run[name](spark, f"{tmp_path}/u").select("doc_id").collect()]
        low = sorted(d + far // 10 for d in docs if d < far // 10)
        assert low == sorted(d for d in docs if d >= far // 10), name
        assert low or name == "v3_structure", name
    places = [int(n) for r in run["v14_issue_lines"](spark, f"{tmp_path}/u").collect() for n in re.findall(r"items\[(\d+)\]", r.line)]
    assert max(places) > 1 << 31


def test_places_of_turns_beyond_an_int(spark, tmp_path):
    """A chat of more than 214,748 turns: the places of its items pass an int by the turn alone."""
    turns = [1, 17, 300_001, 300_017]
    spark.createDataFrame([(0, t, "user", "Some words.") for t in turns], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/w/conversations.parquet")
    places = sorted(r.i for r in M.tampered(spark, f"{tmp_path}/w").items.filter("type = 'constraint'").collect())
    assert [p // 10_000 for p in places] == turns
    run = all_queries()
    for name in ("v1_version_gate", "v2_unknown_types", "v4_timestamps", "v8_references", "v11_upgrade", "v14_issue_lines"):
        run[name](spark, f"{tmp_path}/w").collect()
