"""SimHash components against a plain version over all pairs."""

import collections
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnloom.llm import fingerprints as S
from turnloom.llm import queries
from turnloom.operators import components as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"Wort{i % 977} é{i}" for i in range(40_000))
ROWS = [
    (3, "The cat sat on the mat"), (2, "the  CAT sat\ton the mat"), (3, "The cat sat on the mat"), (4, None), (5, ""), (6, " \n"), (7, "one two"), (8, "One\x0btwo"),
    (9, "one"), (10, "a b c"), (11, "ÄB c d"), (None, "The cat sat on the mat"), (None, None), (None, "only without an id here"), (12, LONG), (13, LONG + " tail"), (14, "x y " * 3000),
]


def plain_print(text, k=3):
    w = WORD.findall((text or "").translate(FOLD))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{fingerprint: set of fingerprints reachable}, from all pairs."""
    nodes = sorted(set(prints))
    group = {n: {n} for n in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 2 and group[a] is not group[b]:
                group[a] |= group[b]
                for n in group[b]:
                    group[n] = group[a]
    return group


def plain_rows(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    group = plain_components([p for _, p in prints])
    ids = collections.defaultdict(list)
    for i, p in prints:
        if i is not None:
            ids[p].append(i)
    return sorted(map(repr, [(i, f"{p:016x}", min((x for n in group[p] for x in ids[n]), default=None)) for i, p in prints]))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", 1, "b") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int, `a.b` string").repartition(3)


def test_no_join_sends_a_table_to_the_driver(docs, monkeypatch):
    """Not even where all tables look small: behind an explode, a checkpoint and in Parquet they look smaller than they are."""
    plans = []

    def noted(module, name):
        kept = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df: plans.append(str(df._jdf.queryExecution().executedPlan())) or kept(df))

    noted(S, "stored")
    noted(C, "cut")
    for df in (S.join(docs), S.one_of_each(docs.drop("fp", "component_id", "a.b"))):
        plans.append(str(df._jdf.queryExecution().executedPlan()))
    assert sum("SortMergeJoin" in x for x in plans) > 5 and not [x for x in plans if "Broadcast" in x]


def test_rows_equal_all_pairs(docs):
    assert sorted(repr(tuple(r)) for r in S.join(docs).collect()) == plain_rows(ROWS)


def test_slices_of_any_size_give_the_same_prints(docs, monkeypatch):
    import pyarrow as pa

    from turnloom.llm.arrays import Block

    texts = [t for _, t in ROWS if t != LONG]
    want = [plain_print(t) for t in texts]
    for chunk in (1, 2, 3, 7, 100):
        monkeypatch.setattr(S, "CHUNK", chunk)
        block = Block(pa.RecordBatch.from_pydict({"text": pa.array([t if t is None or len(t) < 20_000 else "x y" for t in texts])}))
        short = [w if t is None or len(t) < 20_000 else plain_print("x y") for t, w in zip(texts, want)]
        assert S.fingerprints(block, 3).tolist() == short


@pytest.mark.parametrize("segments", [4, 8, 16])
def test_links_join_what_all_pairs_join(spark, segments):
    """Random prints, a chain two bits apart a step, a dense ball, the extremes."""
    rng = np.random.default_rng(segments)
    prints = [int(x) for x in rng.integers(0, 1 << 64, 40, dtype=np.uint64)]
    at = prints[0]
    for _ in range(25):
        for b in rng.choice(64, 2, replace=False):
            at ^= 1 << int(b)
        prints.append(at)
    ball = [prints[1] ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (150, 3))]
    prints = sorted({*prints, *ball, 0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2})
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {p: {p} for p in prints}
    rows = S.links(nodes, segments).collect()
    for r in rows:
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        assert (a ^ b).bit_count() <= 2
        if got[a] is not got[b]:
            got[a] |= got[b]
            for n in got[b]:
                got[n] = got[a]
    assert got == plain_components(prints) and len(rows) <= 65 * len(prints)


def test_a_cell_full_of_neighbours_costs_no_pairs(spark):
    """2,000 prints within two bits of one: fewer rows than 65 a print."""
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)})
    nodes = spark.createDataFrame([(p,) for p in prints if p < 1 << 63], "fp long")
    n = nodes.count()
    assert n > 1900 and S.links(nodes).count() < 65 * n


def test_one_of_each_keeps_columns_of_any_name(docs):
    rows = S.one_of_each(docs)
    assert rows.columns == docs.columns
    got = sorted(repr((r["doc_id"], r["text"])) for r in rows.collect())
    seen, want = set(), []
    group = plain_components([plain_print(t) for _, t in ROWS])
    for i, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        key = min(group[plain_print(t)])
        if not WORD.search(t or "") or key not in seen:
            want.append(repr((i, t)))
            seen |= {key} if WORD.search(t or "") else set()
    assert got == sorted(want)


def test_empty_table_and_query(spark, docs, tmp_path):
    none = docs.limit(0)
    assert S.join(none).count() == 0 and S.one_of_each(none).count() == 0
    docs.select("doc_id", F.col("text"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_simhash"][0](spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_rows(ROWS)
