import json

from pyspark.sql import functions as F

from turnloom.operators import reconcile as REC
from turnloom.operators import semantic as SEM
from turnloom.operators.context import encode, extract_context


def item(ref="i1", type="fact", content="x", origin="user", assertion="explicit", confidence=0.9, evidence=(("m0", "xx"),), **more):
    base = dict(ref=ref, type=type, content=content, origin=origin, assertion=assertion, confidence=confidence, strength=None, status=None,
                language=None, filename=None, uri=None, title=None, evidence=[dict(message=m, quote=q) for m, q in evidence])
    return {**base, **more}


def run(spark, turns, items, relations=(), conv="c", **options):
    raw = spark.createDataFrame([(conv, json.dumps({"items": items, "relations": list(relations)}))], "conv_id string, output string")
    good, bad = SEM.parse_outputs(raw)
    assert bad.count() == 0
    rows, rels = SEM.output_rows(good)
    out, edges, notes = SEM.normalize(rows, rels, turns, **options)
    return out, edges, [(r.ref, r.code) for r in notes.collect()]


def test_mislabelled_origin_becomes_a_proposal(spark, turns):
    t = turns({"c": [("user", "Which one?"), ("assistant", "MongoDB may be easier for a document-heavy app.")]})
    out, _, notes = run(spark, t, [item(type="preference", content="MongoDB", evidence=[("m1", "MongoDB may be easier")])])
    r = out.first()
    assert (r.type, r.status, r.assertion, r.origin, r.start) == ("decision", "proposed", "suggested", "assistant", 0)
    assert {c for _, c in notes} == {"origin_corrected", "attribution_rule"}


def test_tool_output_is_a_quoted_fact(spark, turns):
    t = turns({"c": [("tool", "Limit: you must not exceed 5 calls")]})
    r = run(spark, t, [item(type="constraint", strength="must_not", content="No more than 5", origin="tool", evidence=[("m0", "must not exceed 5 calls")])])[0].first()
    assert (r.type, r.assertion, r.strength, r.origin) == ("fact", "quoted", None, "tool")


def test_evidence_policies(spark, turns):
    t = turns({"c": [("user", "The API must be versioned.")]})
    items = [item("a", evidence=[]), item("b", evidence=[("m0", "not there")]), item("c", evidence=[("m7", "The API")])]
    out, _, notes = run(spark, t, items)
    assert out.count() == 0
    assert ("a", "missing_evidence") in notes and ("b", "unsupported_item") in notes and ("c", "unknown_message_ref") in notes
    kept = run(spark, t, items, policy="lenient")[0].collect()
    assert [(r.ref, r.confidence, r.start) for r in kept] == [("b", 0.4, None)]


def test_quotes_fold_and_keep_original_offsets(spark, turns):
    text = "He said: “Don’t  use\nFirebase” – ok."
    t = turns({"c": [("user", text)]})
    for quote in ("Don’t  use\nFirebase", "don't use firebase", '"DON\'T USE FIREBASE..."', "…Firebase” - OK"):
        r = run(spark, t, [item(evidence=[("m0", quote)])])[0].first()
        assert text[r.start:r.end].lower().startswith(("don", "firebase")), quote


def test_types_are_repaired_and_copies_dropped(spark, turns):
    t = turns({"c": [("user", "xx see https://a.example/y and z")]})
    items = [
        item("a", type="constraint"), item("a", type="constraint", strength="must"), item("a", type="fact"), item("t", type="task", status="answered"),
        item("r", type="reference", content="https://a.example/y", evidence=[("m0", "https://a.example/y")]), item("s", type="reference", content="no link"),
        item("k", type="code_artifact", language="TS"), item("q", assertion="inferred", confidence=0.95), item("w", type="fact", assertion="inferred", confidence=0.95),
    ]
    rels = [dict(type="supersedes", **{"from": "t", "to": "r"}), dict(type="supersedes", **{"from": "q", "to": "w"}), dict(type="conflicts_with", **{"from": "t", "to": "s"})]
    out, edges, notes = run(spark, t, items, rels)
    got = {r.ref: r for r in out.collect()}
    assert got["a"].strength == "must" and got["t"].status == "open" and got["r"].uri == "https://a.example/y" and got["k"].language == "ts"
    assert got["q"].confidence == 0.8 and "w" not in got
    assert notes.count(("a", "missing_field")) == 1 and ("a", "duplicate_ref") in notes and ("s", "missing_field") in notes and ("w", "duplicate_item") in notes
    assert edges.count() == 1 and sum(c == "relation_dropped" for _, c in notes) == 2


def test_outputs_are_rejected_whole(spark):
    good = {"items": [item()], "relations": []}
    bad = [("fenced", "```json\n" + json.dumps(good) + "\n```"), ("text", "sorry"), ("shape", json.dumps({"items": []})), ("kind", json.dumps({"items": [item(type="mood")], "relations": []})),
           ("range", json.dumps({"items": [item(confidence=1.5)], "relations": []})), ("many", json.dumps({"items": [item(f"i{n}") for n in range(201)], "relations": []})),
           ("quotes", json.dumps({"items": [item(evidence=[("m0", "x")] * 9)], "relations": []}))]
    ok, no = SEM.parse_outputs(spark.createDataFrame(bad, "conv_id string, output string"))
    assert [r.conv_id for r in ok.collect()] == ["fenced"]
    assert {r.conv_id: r.code for r in no.collect()} == {"text": "invalid_json", "shape": "schema", "kind": "schema", "range": "schema", "many": "too_many", "quotes": "schema"}


def test_only_selected_turns_reach_a_prompt_and_failures_are_rows(spark, turns):
    t = turns({"c": [("user", f"message {i}") for i in range(10)], "e": [("user", "fails")]}).filter("idx in (1, 4, 5, 8) or conv_id = 'e'")

    def generate(prompt):
        if "fails" in prompt:
            raise TimeoutError
        return prompt

    rows = {r.conv_id: r for r in SEM.call_provider(SEM.prompt_rows(t), generate, 2).collect()}
    assert [m["ref"] for m in json.loads(rows["c"].output)] == ["m1", "m4", "m5", "m8"]
    assert rows["e"].output is None and rows["e"].code == "provider_TimeoutError"


def reconciled(spark, t, items, relations=()):
    model, edges, _ = run(spark, t, items, relations)
    return extract_context(t, "hybrid", model_items=model, model_relations=edges), encode(t)


def test_merge_takes_the_more_confident_text(spark, turns):
    t = turns({"c": [("user", "I prefer React and Tailwind.")]})
    out, _ = reconciled(spark, t, [item(type="preference", content="Prefers React and Tailwind", confidence=0.95, evidence=[("m0", "prefer React and Tailwind")])])
    r = out["items"].first()
    assert (r.content, r.confidence, r.merged, r.assertion, len(r.evidence)) == ("Prefers React and Tailwind", 0.95, 1, "explicit", 2)
    rep = out["report"].first()
    assert (rep.candidates, rep["items"], rep.merged) == (2, 1, 1)


def test_literal_copies_of_rules_win(spark, turns):
    t = turns({"c": [("user", "See https://a.example/x/ now.\n```js\nlet a = 1;\n```")]})
    out, _ = reconciled(spark, t, [
        item("r", type="reference", content="link", uri="https://A.example/x", confidence=1.0, evidence=[("m0", "See")]),
        item("k", type="code_artifact", content="let  a = 1;", language="js", confidence=1.0, evidence=[("m0", "let a = 1;")]),
    ])
    rows = out["items"].collect()
    assert {r.kind for r in rows} == {"deterministic"} and sum(r.merged for r in rows) == 2


def test_origins_stay_apart_and_relations_follow(spark, turns):
    t = turns({"c": [("user", "The backend must use Django."), ("assistant", "We will use FastAPI."), ("user", "I prefer Vue.")]})
    out, rules = reconciled(
        spark, t,
        [item("a", type="constraint", content="Use Django", strength="must", confidence=0.99, evidence=[("m0", "must use Django")]),
         item("b", type="preference", content="Vue", confidence=0.2, evidence=[("m2", "I prefer Vue.")]),
         item("f", type="fact", content="Uses Django", evidence=[("m0", "The backend must use Django.")])],
        [dict(type="supersedes", **{"from": "b", "to": "a"})],
    )
    got = {r.content: r for r in out["items"].collect()}
    assert set(got) == {"Use Django", "We will use FastAPI.", "I prefer Vue.", "Uses Django"}
    edges = {(r.type, r["from"], r["to"]) for r in out["relations"].collect()}
    assert ("supersedes", got["I prefer Vue."].item_id, got["Use Django"].item_id) in edges
    assert not any(k == "same_evidence" and {a, b} == {got["Use Django"].item_id, got["Uses Django"].item_id} for k, a, b in edges)


def test_same_evidence_links_types(spark, turns):
    t = turns({"c": [("user", "The backend must use Django.")]})
    out, _ = reconciled(spark, t, [item("f", type="fact", content="Uses Django", evidence=[("m0", "The backend must use Django.")])])
    assert [r.type for r in out["relations"].collect()] == ["same_evidence"] and out["items"].count() == 2


def test_fallback_and_modes(spark, turns):
    t = turns({"c": [("user", "I prefer Vue.")], "e": [("user", "I prefer React.")]})
    failed = spark.createDataFrame([("e", "timeout")], "conv_id string, code string")
    model, edges, _ = run(spark, t, [item(type="preference", content="Vue", evidence=[("m0", "I prefer Vue.")])])
    hybrid = extract_context(t, "hybrid", model_items=model, model_relations=edges, failures=failed)
    assert {(r.conv_id, r.fallback) for r in hybrid["items"].collect()} == {("c", False), ("e", True)}
    only = extract_context(t, "semantic", model_items=model, failures=failed)
    assert [r.conv_id for r in only["items"].collect()] == ["c"]
    assert REC.union_all([encode(t), model]).count() == 3 and F is not None
