import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators.matching import match_by_class, match_in_order
from turnloom.operators.ordering import first_n, number_rows
from turnloom.operators.reconcile import group_candidates, reconcile


def greedy(pairs):
    used, out = set(), set()
    for b in sorted({b for _, b in pairs}):
        free = sorted(a for a, x in pairs if x == b and a not in used)
        if free:
            used.add(free[0])
            out.add((free[0], b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_equals_the_sequential_walk(spark, seed):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(25), rnd.randrange(30)) for _ in range(70)} | {(0, b) for b in range(30)}
    df = spark.createDataFrame([(a, a, b, b) for a, b in pairs], "a int, a_order int, b int, b_order int")
    assert {(r.a, r.b) for r in match_in_order(df).collect()} == greedy(pairs)


def candidate_rows(rnd, ext, n, keys, turns):
    rows = []
    for i in range(n):
        start = rnd.randrange(0, 40)
        rows.append((f"e{ext}_{i}", "d", f"c{i % 5}", i % 5, i, rnd.choice(keys), rnd.choice(turns), start, start + rnd.randrange(5, 15), rnd.choice([0.5, 0.7, 0.9])))
    return rows


def candidates(spark, ext, rows):
    df = spark.createDataFrame(rows, "item_id string, doc_id string, conv_id string, conv_pos long, o1 int, content string, turn_id string, start int, end int, confidence double")
    text = {n: F.lit(None).cast("string").alias(n) for n in ("strength", "status", "language", "filename", "uri", "title")}
    return df.select(
        "item_id", "doc_id", "conv_id", "conv_pos", "o1", F.lit(0).alias("o2"), F.lit(0).alias("o3"), F.lit(0).alias("idx"), "turn_id", F.lit("user").alias("role"),
        F.lit("fact").alias("type"), "content", "start", "end", *text.values(), "confidence", F.lit("m").alias("method"), F.lit("a").alias("agent"), F.lit("user").alias("origin"),
        F.lit("unknown").alias("assertion"), F.array(F.struct("turn_id", "start", "end")).alias("evidence"), F.lit(f"x{ext}").alias("extractor"), F.lit("semantic").alias("kind"), F.lit(ext).alias("ext_pos"),
    )


def brute_groups(extractors):
    groups = []
    for ext, rows in enumerate(extractors):
        for r in sorted(rows, key=lambda r: (r[3], r[4], r[0])):
            def same(m, r=r):
                inter = min(m[8], r[8]) - max(m[7], r[7])
                near = m[6] == r[6] and inter > 0 and inter / min(m[8] - m[7], r[8] - r[7]) >= 0.5
                return m[5] == r[5] or near

            home = next((g for g in groups if all(e != ext for e, _ in g) and any(same(m) for _, m in g)), None)
            if home is None:
                groups.append([(ext, r)])
            else:
                home.append((ext, r))
    return {frozenset(m[0] for _, m in g) for g in groups}


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_the_sequential_walk_with_many_copies(spark, seed):
    rnd = random.Random(seed)
    keys, turns = ["alpha", "alpha", "alpha", "beta", "gamma", "delta"], ["t1", "t2", "t3"]
    rows = [candidate_rows(rnd, e, n, keys, turns) for e, n in enumerate((14, 18, 9))]
    got = group_candidates([candidates(spark, e, r) for e, r in enumerate(rows)])
    groups = {}
    for r in got.select("group_id", "item_id").collect():
        groups.setdefault(r.group_id, set()).add(r.item_id)
    assert {frozenset(g) for g in groups.values()} == brute_groups(rows)


def test_numbering_in_blocks(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("hot"), (F.col("id") * 7 % 5003).alias("p"))
    got = number_rows(df, ["hot"], F.floor(F.col("p") / 100), ["p"], "n").collect()
    for hot in (True, False):
        rows = sorted((r.p, r.n) for r in got if r.hot == hot)
        assert [n for _, n in rows] == list(range(len(rows)))


def test_first_n_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id").repartition(4)
    plan = first_n(df, ["k"], [F.col("id").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_a_chain_of_ten_thousand_links(spark):
    """Every b could take the a of the one before it: only one after the other is there an order."""
    pairs = [(i, i) for i in range(10_000)] + [(i - 1, i) for i in range(1, 10_000)]
    df = spark.createDataFrame([(f"a{a}", a, f"b{b}", b) for a, b in pairs], "a string, a_order int, b string, b_order int")
    got = {(r.a, r.b) for r in match_in_order(df).collect()}
    assert got == {(f"a{i}", f"b{i}") for i in range(10_000)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walk_without_rounds_equals_the_sequential_one(spark, seed):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(40), rnd.randrange(50)) for _ in range(90)}
    df = spark.createDataFrame([(a, a, b, b) for a, b in pairs], "a int, a_order int, b int, b_order int").repartition(5)
    assert {(r.a, r.b) for r in match_in_order(df, rounds=0).collect()} == greedy(pairs)


def by_class(members, arriving, choices):
    """Sequential: the first free a of the class or of the choices."""
    lists, front, taken, out = {}, {}, set(), set()
    for k, a in sorted(members, key=lambda m: m[1]):
        lists.setdefault(k, []).append(a)
    own = {}
    for a, b in choices:
        own.setdefault(b, []).append(a)
    for k, b in sorted(arriving, key=lambda m: m[1]):
        while front.get(k, 0) < len(lists.get(k, [])) and lists[k][front.get(k, 0)] in taken:
            front[k] = front.get(k, 0) + 1
        options = [a for a in own.get(b, []) if a not in taken] + lists.get(k, [])[front.get(k, 0):front.get(k, 0) + 1]
        if options:
            taken.add(min(options))
            out.add((min(options), b))
    return out


def classes(spark, members, arriving, choices):
    m = spark.createDataFrame([(k, f"a{a}", a, a // 64) for k, a in members], "key string, a string, a_order int, a_block int").repartition(4)
    v = spark.createDataFrame([(k, f"b{b}", b, b // 64) for k, b in arriving], "key string, b string, b_order int, b_block int").repartition(4)
    c = spark.createDataFrame([(f"a{a}", f"b{b}") for a, b in choices], "a string, b string")
    return {(int(r.a[1:]), int(r.b[1:])) for r in match_by_class(m, v, c, ["key"]).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_the_sequential_walk(spark, seed):
    rnd = random.Random(seed)
    keys = [rnd.choice("xxxyzuvw") for _ in range(300)]
    members = [(keys[i], i) for i in range(150)] + [(rnd.choice("xyz"), rnd.randrange(150)) for _ in range(10)]
    members = list(dict.fromkeys(members))
    arriving = [(keys[150 + i], i) for i in range(150)]
    choices = {(rnd.randrange(150), rnd.randrange(150)) for _ in range(40)}
    assert classes(spark, members, arriving, choices) == by_class(members, arriving, choices)


def test_a_hundred_thousand_equal_copies_with_crossings(spark):
    rnd = random.Random(3)
    n = 100_000
    members = [("hot" if i % 50 else f"k{i % 7}", i) for i in range(n)]
    arriving = [("hot" if i % 40 else f"k{i % 9}", i) for i in range(n)]
    choices = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(3000)}
    assert classes(spark, members, arriving, choices) == by_class(members, arriving, choices)


def test_one_chat_in_two_documents_is_reconciled_in_each(spark):
    rnd = random.Random(6)
    rows = [candidate_rows(rnd, e, 12, ["alpha", "alpha", "beta"], ["t1", "t2"]) for e in range(2)]
    one = [candidates(spark, e, r) for e, r in enumerate(rows)]
    two = [c.unionByName(c.withColumn("doc_id", F.lit("d2"))) for c in one]
    single, double = reconcile(one), reconcile(two)
    for name in ("items", "merged", "relations", "members"):
        want = sorted(map(repr, single[name].drop("b_order", "g_order").collect()))
        for doc in ("d", "d2"):
            got = double[name].filter(F.col("doc_id") == doc).withColumn("doc_id", F.lit("d")).drop("b_order", "g_order")
            assert sorted(map(repr, got.collect())) == want
