"""Registered queries against their SQL on the smallest tables, and what their plans look like.

`python -m tests.check_all` runs all of them at sf0.01.
"""

import os

import pytest

from tests.oracle import compare, connect
from turnloom.plans.registry import all_queries, all_sql

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "s1_turns x4_code_items x14_items w1_dedupe j1_provenance a1_summary p1_parse_selection p12_platform f6_locate_quote f17_latex k1_assemble k3_upsert"
    " k6_transcript_md t2_top_sentences w9_debounce i2_prefix_matches a7_top_sources f24_limit_headers h4_attribution_rules h9_normalise r6_running_counters"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql()) and len(all_queries()) > 160


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    assert compare(all_queries()[name](spark, SF), con, all_sql()[name]) is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["x14_items", "w1_dedupe", "f9_secret_scan", "f6_locate_quote", "h9_normalise", "f11_markdown", "k2_json_fragments", "i2_prefix_matches", "w8_changes"])
def test_native_plans_hold_no_python_and_no_cross_join(spark, name):
    text = plan(all_queries()[name](spark, SF))
    assert "EvalPython" not in text and "InPandas" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_what_is_used(spark):
    text = plan(all_queries()["a7_top_sources"](spark, SF))
    assert "EqualTo(event_type,view)" in text and "value" not in text[text.index("ReadSchema"):][:200]


def test_postings_are_met_once_per_distinct_term(spark, monkeypatch):
    """What the prefix search makes of the index doesn't grow with queries that share their terms; results as by brute force."""
    from turnloom.operators import search as SE

    texts = {f"c{i}": f"harvest word{i % 7} {'tasting' if i % 5 == 0 else 'other'} tail{i}" for i in range(60)}
    postings = [("content", t, c) for c, x in texts.items() for t in x.split()] + [("title", "harvest", "c1"), ("content", "harvest", None), ("content", "tastes", None)]
    index = spark.createDataFrame(postings, "field string, token string, conv_id string")
    queries = [(i, q) for i, q in enumerate(["har tas", "tas har", "har", "har tas other", "zzz har", "", None, "word1 h"] * 4)]
    made, kept = [], SE.cut
    monkeypatch.setattr(SE, "cut", lambda df: made.append(kept(df)) or made[-1])
    got = SE.prefix_matches(index, spark.createDataFrame(queries, "query_id long, query string")).collect()
    want = set()
    for n, q in queries:
        terms = set((q or "").split())
        for place in {(f, c) for f, _, c in postings}:
            hits = [sum(t.startswith(x) for f, t, c in postings if (f, c) == place) for x in terms]
            if hits and all(hits):
                want.add((n, *place, sum(hits)))
    assert {(r.query_id, r.field, r.conv_id, r.hits) for r in got} == want and len(got) == len(want)
    assert len(made) == 1 and made[0].count() == len({(x, f, c) for f, t, c in postings for x in ("har", "tas", "other", "word1", "h", "zzz") if t.startswith(x)})
