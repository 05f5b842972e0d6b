"""Vector codes against a plain version that compares every part with every entry."""

import collections
import hashlib
import math

import numpy as np
import pytest

from turnloom.llm import queries
from turnloom.llm import vectorcodes as V

NAN, INF = float("nan"), float("inf")


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(scale * x) for x in v] if all(abs(x) < 2.0**50 for x in v) else None, lab) for i, v, lab in kept]
    order = sorted((r for r in whole if r[1] is not None and len(r[1]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(order[0][1]) if order else -1
    order = [r for r in order if len(r[1]) == dim]
    w = max(dim, 0) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds if order else 0):
        for p in range(parts):
            members = collections.defaultdict(list)
            for _, v, _ in order:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for i, m in members.items():
                books[p][i] = [sum(c) // len(m) for c in zip(*m)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in whole:
        if v is None or len(v) != dim:
            out.append((i, None, None, lab))
            continue
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        out.append((i, "".join(f"{e:02x}" for _, e in best), error if error < 1 << 63 else None, lab))
    sums = collections.defaultdict(lambda: None)
    for _, _, error, lab in out:
        if error is not None:
            sums[lab] = (sums[lab] or 0) + error
    clip = lambda x: None if x is None or x >= 1 << 63 else x
    return sorted(repr((i, c, e, clip(sums[lab]), digest)) for i, c, e, lab in out)


def table(spark, rows, extra=True):
    if extra:
        return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, code int, `a.b` string").repartition(3)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def vectors(n, dim=16, seed=0, size=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, size, (5, dim))
    return [(i, (centers[i % 5] + rng.normal(0, size / 3, dim)).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]


AWKWARD = [
    (3, [0.0] * 16, 1), (3, [0.0] * 16, 1), (3, [-0.5] * 16, 1), (100, None, 1), (101, [1.0, None] * 8, 1), (102, [NAN] * 16, 2), (103, [-INF] + [1.0] * 15, 2),
    (None, [0.25] * 16, None), (104, [1.0] * 8, 5), (105, [1.0] * 15, 5), (106, [], 5), (107, [2.0**51] + [0.0] * 15, 5), (108, [-1e-9] * 16, 6), (109, [2.0**21, -(2.0**21)] * 8, 6),
]


@pytest.mark.parametrize("rows", [vectors(300), vectors(9), vectors(40) + AWKWARD, [(i, [float(i // 20)] * 16, 0) for i in range(60)], vectors(60, size=1e12), AWKWARD])
def test_rows_equal_the_plain_version(spark, rows):
    assert got(V.compress(table(spark, rows))) == plain(rows)


def test_other_shapes(spark):
    rows = vectors(120, dim=12)
    assert got(V.compress(table(spark, rows), parts=3, entries=64, rounds=2, scale=10)) == plain(rows, 3, 64, 2, 10)
    assert V.compress(table(spark, [])).count() == 0
    odd = [(1, [1.0] * 7, 1)]
    assert got(V.compress(table(spark, odd))) == plain(odd)
    none = [(1, [], 1), (2, [], None)]
    assert got(V.compress(table(spark, none))) == plain(none)


def test_many_labels_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(V, "FEW_LABELS", 1)
    rows = vectors(80) + AWKWARD
    assert got(V.compress(table(spark, rows))) == plain(rows)


@pytest.mark.parametrize("top", [3, 1000, 1 << 40])
def test_box_of_masks_holds_every_entry_as_near(top):
    rng = np.random.default_rng(top)
    kind = np.int64 if top < 1 << 20 else object
    entries, x = (rng.integers(-top, top + 1, (n, 5)).astype(kind) for n in (40, 200))
    s = V.Slices(entries)
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    radius = np.array([math.isqrt(int(v)) for v in s.guess(x)], kind)
    masks = s.candidates(x, radius)
    inside = (np.abs(x[:, None] - entries[None]) <= radius[:, None, None]).all(axis=2)
    assert [[bool(int(m) >> i & 1) for i in range(40)] for m in masks] == inside.tolist()
    pick, best = s.nearest(x)
    assert pick.tolist() == [min(range(40), key=lambda i: (r[i], i)) for r in d.tolist()] and best.tolist() == d.min(axis=1).tolist()
    assert inside.sum() < 0.9 * inside.size  # the box leaves entries out


def test_codes_decode_to_entries():
    books = V.Codebooks([[[1, 2], [3, 4]], [[5, 6], [7, 8]]])
    assert books.decode("0100") == [3, 4, 5, 6] and V.Assigner(books)(np.array([[3, 4, 5, 7]]))[0].tolist() == [[1, 0]]


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [r for r in vectors(90, dim=24) + [(200, None, 1), (201, [NAN] * 24, 1), (202, [None] * 24, 1)]]
    table(spark, rows, extra=False).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    fn, sql = queries.QUERIES["op12_codes"]
    df = fn(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(sql)
    assert [c[0] for c in want.description] == df.columns
    assert got(df) == sorted(map(repr, want.fetchall()))
