"""Pairs of different components that meet: each once, however many lists they share, and none lost."""

import random
from itertools import combinations

from turnloom.llm import jaccard as J


def across(spark, sigs, root):
    rest = spark.createDataFrame([(s, n, root[n]) for n, own in sigs.items() for s in own], "sig long, node long, root long")
    marks = spark.createDataFrame([(n, 100, *[0] * len(J._BITS)) for n in sigs], "node long, n int, " + ", ".join(f"{c} long" for c in J._BITS))
    return [tuple(r) for r in J._across(rest, marks, 85).collect()]


def test_near_copies_meet_once_for_all_they_share(spark):
    sigs = {n: range(36) for n in range(30)}
    got = across(spark, sigs, {n: n for n in sigs})
    assert sorted(got) == sorted(combinations(range(30), 2))


def test_no_pair_is_lost(spark):
    rng = random.Random(5)
    sigs = {n: rng.sample(range(-150, 150), rng.choice((2, 10, 40, 60))) for n in range(60)}
    root = {n: rng.randrange(12) for n in sigs}
    want = {(a, b) for a, b in combinations(sigs, 2) if root[a] != root[b] and set(sigs[a]) & set(sigs[b])}
    got = across(spark, sigs, root)
    assert set(got) == want
    assert len(got) < sum(len(set(sigs[a]) & set(sigs[b])) for a, b in want) * 0.8
