"""Extractors and compressors of one's own, modes and policies, stored search."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators import compressors as CP
from turnloom.operators import context as CX
from turnloom.operators import search as SE
from turnloom.plans.seeded import conversations


def chats(turns):
    return turns({"a": [("user", "We decided to use slate."), ("user", "We decided to use slate."), ("assistant", "Fine.")], "b": [("user", "The gate must be latched.")]})


def longest(t):
    top = t.groupBy("doc_id", "conv_id", "conv_pos").agg(F.max_by("content", F.length("content")).alias("content"))
    return {"items": top.withColumn("type", F.lit("fact"))}


def test_modes_pick_extractors_by_kind_and_fall_back(spark, turns):
    t = chats(turns)
    own = CX.register(CX.ContextExtractor("longest", "deterministic", longest))
    failures = spark.createDataFrame([("b", "timeout")], "conv_id string, code string")
    said = t.filter("idx = 0").select("doc_id", "conv_id", "conv_pos", F.lit("task").alias("type"), F.concat(F.lit("said in "), "conv_id").alias("content"))
    model = CX.ContextExtractor("model", "semantic", lambda _: {"items": said, "failures": failures})
    every = [CX.rule_extractor(), *CX.registered("longest"), model]
    seen = lambda out: sorted((r.conv_id, r.type, r.fallback) for r in out["items"].collect())
    rules = [("a", "decision", False), ("a", "fact", False), ("b", "constraint", True), ("b", "fact", True)]
    assert seen(CX.run_extractors(t, every)) == sorted([*rules, ("a", "task", False)])
    assert seen(CX.run_extractors(t, every, "deterministic")) == [(c, k, False) for c, k, _ in rules]
    alone = CX.run_extractors(t, every, "semantic")
    assert seen(alone) == [("a", "task", False)] and [(r.level, r.code, r.cause) for r in alone["diagnostics"].collect()] == [("error", "semantic_failed", "timeout")]
    with pytest.raises(ValueError):
        CX.run_extractors(t, [own], "semantic")
    with pytest.raises(ValueError):
        CX.register(CX.ContextExtractor("x", "magic", longest))


def test_dedupe_flag(turns):
    t = chats(turns)
    count = lambda flag: CX.extract_context(t, dedupe=flag)["items"].filter("type = 'decision'").count()
    assert (count(True), count(False)) == (1, 2)


def test_compressors_by_name_and_own(turns):
    t = chats(turns)
    conv = conversations(t)
    last = {r.conv_id: r.summary for r in CP.summarise(conv, t, "last_turns").collect()}
    assert last["b"] == "user: The gate must be latched." and last["a"].endswith("assistant: Fine.")
    own = CP.summarise(conv, t, lambda c, t: t.groupBy("conv_id").agg(F.count(F.lit(1)).cast("string").alias("summary")), max_chars=0)
    assert {(r.conv_id, r.summary, r.cut) for r in own.collect()} == {("a", "", True), ("b", "", True)}
    assert {r.conv_id for r in CP.summarise(conv, t).collect()} == {"a", "b"}


def test_stored_search_takes_terms_to_the_scan(spark, tmp_path):
    index = spark.range(20_000).select(F.lit("content").alias("field"), F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("conv_id"), F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("token"))
    SE.write_search_tables(index, str(tmp_path))
    found = SE.stored_matches(spark, str(tmp_path), "W00001 w01999, w00001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,w00001)" in plan and "StringStartsWith(token,w01999)" in plan
    both = {f"c{i % 50}" for i in range(10, 20)} & {f"c{i % 50}" for i in range(19990, 20000)}
    assert {(r.conv_id, r.hits) for r in found.collect()} == {(c, 2) for c in both}
    assert SE.stored_matches(spark, str(tmp_path), " ,").count() == 0
