import json

from pyspark.sql import functions as F

from turnloom.operators import evaluate as EV
from turnloom.operators.extract import annotate
from turnloom.operators.context import encode
from turnloom.sources.fixtures import fixture_gold, fixture_turns, read_fixtures

U, A, S = "user", "assistant", "system"
CASES = {
    "correction": ([(U, "I keep bees on the roof."), (A, "Bees stay calm up there."), (U, "Since spring I keep them in the yard.")], None,
                   [("fact", U, 0, ["roof"]), ("fact", U, 2, ["yard"])], []),
    "oven": ([(U, "I need the ovens to burn oak."), (A, "You could fire with gas instead. It heats more evenly.")], None,
               [("constraint", U, 0, ["oak"]), ("decision", A, 1, ["gas"])], [("constraint", U, ["gas"]), ("decision", U, ["gas"])]),
    "thread": ([(U, "I prefer linen thread."), (A, "Cotton may be easier on a wide loom.")], None,
                 [("preference", U, 0, ["linen"]), ("decision", A, 1, ["cotton"])], [("preference", U, ["cotton"]), ("preference", A, ["cotton"])]),
    "boundary": ([(U, "The gate must be latched."), (A, "UNSELECTED: we decided to use chains."), (U, "I prefer short fence posts."), (U, "UNSELECTED: the barn must use slate.")], [0, 2],
                 [("constraint", U, 0, ["latched"]), ("preference", U, 2, ["short fence posts"])], [("decision", A, ["chains"]), ("constraint", U, ["slate"])]),
    "system": ([(S, "Always reply in verse."), (U, "The kiln must stay dry. Which glaze should we use? Next step: fire a small tile."),
                (A, "You could try celadon, see [Notes](https://clay.example/docs/celadon).\n```ts\nkiln.heat('x');\n```")], None,
               [("constraint", S, 0, ["verse"]), ("constraint", U, 1, ["dry"]), ("question", U, 1, ["glaze"]), ("task", U, 1, ["small tile"]),
                ("decision", A, 2, ["celadon"]), ("reference", A, 2, ["clay.example"]), ("code_artifact", A, 2, ["kiln.heat"])], [("constraint", U, ["celadon"])]),
    "boat": ([(U, "I'm designing a canal boat. I prefer oak and cork. The hull must use steel. A lifeboat is required."),
                    (A, "A usual fitting is the Dutch leeboard frame with rope and pulleys.")], None,
                   [("fact", U, 0, ["canal boat"]), ("preference", U, 0, ["oak", "cork"]), ("constraint", U, 0, ["steel"]), ("constraint", U, 0, ["lifeboat"]),
                    ("decision", A, 1, ["leeboard frame"]), ("decision", A, 1, ["rope"]), ("decision", A, 1, ["pulleys"])],
                   [("constraint", U, ["rope"]), ("constraint", U, ["pulleys"]), ("preference", U, ["pulleys"])]),
}
# gold, predicted, matched, origin, provenance, unsupported, forbidden and F1 of the rules, as published
EXPECTED = {
    "correction": (2, 0, 0, 0, 0, 0, 0, 0.0), "oven": (2, 0, 0, 0, 0, 0, 0, 0.0), "thread": (2, 1, 1, 1, 1, 0, 0, 2 / 3),
    "boundary": (2, 2, 2, 2, 2, 0, 0, 1.0), "system": (7, 5, 5, 5, 5, 0, 0, 5 / 6), "boat": (7, 4, 4, 4, 4, 0, 0, 8 / 11),
    "TOTAL": (22, 12, 12, 12, 12, 0, 0, 24 / 34),
}


def test_rules_reach_the_published_scores(spark, tmp_path):
    for name, (messages, selection, gold, bad) in CASES.items():
        fixture = {
            "id": name, "conversation": {"source": "chatgpt", "title": "t", "url": "", "capturedAt": "2025-01-01T00:00:00Z", "messages": [{"role": r, "content": c} for r, c in messages]},
            "expected": [dict(type=t, origin=o, message=m, match=k) for t, o, m, k in gold], "forbidden": [dict(type=t, origin=o, match=k, reason="r") for t, o, k in bad],
        }
        if selection:
            fixture["selection"] = selection
        (tmp_path / f"{name}.eval.json").write_text(json.dumps(fixture, indent=1))
    (tmp_path / "notes.json").write_text("{}")
    fixtures = read_fixtures(spark, str(tmp_path))
    turns = fixture_turns(fixtures)
    items = annotate(encode(turns))
    assert not items.filter(F.lower("content").contains("unselected")).count()
    gold, bad = fixture_gold(fixtures)
    rows = {r.fixture: r for r in EV.report(EV.evaluation_counts(gold, bad, items, turns)).collect()}
    for name, want in EXPECTED.items():
        r = rows[name]
        assert tuple(r[c] for c in EV.COUNTS) == want[:7], name
        assert abs(r.f1 - want[7]) < 1e-9
    assert rows["correction"].precision == 1.0 and rows["correction"].recall == 0.0
