"""Cases that an earlier version got wrong."""

import random
import re
import time

from pyspark.sql import functions as F

from turnloom.functions import secrets as S
from turnloom.operators import analytics as AN
from turnloom.operators import render as RN
from turnloom.operators.components import components
from turnloom.sources import pages as PG


def test_long_secrets_are_found_and_leave_no_tail(spark):
    jwt = "eyJ" + "a" * 5000 + ".eyJ" + "b" * 5000 + "." + "c" * 1500
    key = "sk-proj-" + "Z9" * 500
    rows = spark.createDataFrame([(f"x {jwt} y",), (f"end {key}",)], "text string")
    out = rows.select(F.size(S.scan(F.col("text"))).alias("n"), S.redact_text(F.col("text")).alias("t")).collect()
    assert [r["n"] for r in out] == [1, 1]
    assert out[0]["t"] == "x [REDACTED:JWT] y" and out[1]["t"] == "end [REDACTED:OpenAI API Key]"


def test_tokens_are_found_in_time_proportional_to_the_text(spark):
    def seconds(n):
        df = spark.createDataFrame([("-eyJ" * n + " x",), ("-eyJabc.eyJ" * (n // 3),)], "text string")
        started = time.perf_counter()
        assert df.select(F.size(S.scan(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] == 0
        return time.perf_counter() - started

    seconds(10)
    small, large = seconds(600_000), seconds(2_500_000)  # 10 MB
    assert large <= 8 * max(small, 0.5)


def test_one_pass_finds_what_the_plain_pattern_finds(spark):
    rng = random.Random(1)
    bits = ["eyJ", "-", "_", ".", ".", "a" * 9, "b" * 10, "c" * 11, " ", "x", "é", "-eyJ", ".eyJ", "eyJabcdefghijk", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    plain = re.compile(next(p for k, _, p, _ in S.PATTERNS if k == "JWT"))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", F.regexp_extract_all("text", F.lit(S.IN_ONE_PASS["JWT"]), F.lit(1)).alias("v")).collect()
    want = {i: plain.findall(t) for i, t in enumerate(texts)}
    assert {r.i: list(r.v) for r in got} == want and sum(map(bool, want.values())) > 20


def test_truth_values_are_not_summed(spark):
    e = spark.createDataFrame([("a", '{"v": true}'), ("a", '{"v": 2}'), ("a", '{"v": "3"}'), ("b", '{"v": 9}')], "event string, properties string")
    assert AN.sum_property(e, "a", "v").first()["total"] == 2.0


def grid(html):
    builder = PG._Builder()
    builder.feed(html)
    return PG._grid(next(n for n in builder.root.walk() if n.tag == "table"))


def test_inner_tables_do_not_add_rows_and_spans_are_whole():
    html = "<table><tr><td>a<table><tr><td>in</td><td>side</td></tr></table></td><td colspan='3'>b</td></tr><tr><td>c</td></tr></table>"
    assert grid(html) == [["a in side", "b", "b", "b"], ["c", "", "", ""]]
    assert grid("<table><tr><td rowspan=3>r</td><td>1</td></tr><tr><td>2</td></tr><tr><td colspan=2>3</td></tr><tr><td>4</td></tr></table>") == [
        ["r", "1", ""], ["r", "2", ""], ["r", "3", "3"], ["4", "", ""]
    ]
    assert grid("<table><tr><td rowspan=2 colspan=2>x</td><td>y</td></tr><tr><td>z</td><td>w</td></tr></table>") == [["x", "x", "y", ""], ["x", "x", "z", "w"]]
    assert PG._span("1200", 1000) == 1000 and PG._span("250", 1000) == 250 and PG._span("x", 1000) == 1 and PG._span("0", 9) == 1


def test_a_span_beyond_the_table_costs_nothing():
    started = time.perf_counter()
    assert grid("<table><tr><td colspan=1000 rowspan=65534>x</td></tr><tr></tr></table>") == [["x"] * 1000] * 2
    assert time.perf_counter() - started < 2


def test_equal_titles_get_their_own_file(spark):
    conv = spark.createDataFrame([("c1", "Same"), ("c2", "Same")], "conv_id string, title string")
    parts = spark.createDataFrame([("c1", 0, "x"), ("c2", 0, "y")], "conv_id string, block long, text string")
    entries, _ = RN.bundle(conv, parts, "md")
    assert entries.select("path").distinct().count() == 2


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
