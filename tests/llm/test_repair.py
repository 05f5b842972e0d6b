"""Conversation repair against a plain walk over whole strings and against all edits of short conversations."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from turnloom.llm import queries
from turnloom.llm import repair as R

LEGAL = re.compile(r"(s?(ua)+)?")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def order(r):
    return (r[0] is not None, r[0] or 0, r[1], r[2])


def plain_faults(rows):
    """rows (turn, role, text) in order -> their first faults."""
    seen, out = set(), []
    for _, role, text in rows:
        worded = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not worded else "d" if (role, text) in seen else "" if worded[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def plain_parse(initials, faults):
    """Least (cost, audit, final) by a dictionary of last role -> (cost, audit), inserts tried everywhere."""
    tops = {"": (0, "")}

    def inserted(tops):
        out = dict(tops)
        for _ in range(3):
            for last, (c, a) in list(out.items()):
                for x in "ua":
                    if (last, x) in NEXT:
                        out[x] = min(out.get(x, (1 << 60, "")), (c + 2, a + "I"))
        return out

    for x, f in zip(initials, faults):
        new = {}
        for last, (c, a) in inserted(tops).items():
            ways = [(last, c + 3, a + "D")]
            if f not in ("b", "d"):
                t = f == "t"
                if (last, x) in NEXT:
                    ways.append((NEXT[last, x], c + t, a + "K"))
                ways += [(y, c + 2 + t, a + "R") for y in "ua" if (last, y) in NEXT]
            for top, cost, audit in ways:
                new[top] = min(new.get(top, (1 << 60, "")), (cost, audit))
        tops = new
    tops = inserted(tops)
    return min(tops[t] for t in ("", "a") if t in tops)


def plain_repaired(rows, audit):
    last, out, source = "", [], iter(rows)
    for e in audit:
        _, role, text = (None, "", "") if e == "I" else next(source)
        if e == "D":
            continue
        if e == "K":
            last = role[:1]
        else:
            last = next(y for y in "ua" if (last, y) in NEXT)
            role = FULL[last]
        out.append((role, text))
    assert LEGAL.fullmatch("".join(r[:1] for r, _ in out))
    return out


def plain(rows, known=()):
    """rows (conv_id, turn, role, text) -> {conv_id: result}."""
    sp = lambda x: " " if x is None else x
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, sp(role), sp(text)))
    out = {c: (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in known}
    for conv, own in by.items():
        own.sort(key=order)
        f = plain_faults(own)
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        cost, audit = plain_parse(initials, f)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in plain_repaired(own, audit))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (conv, gaps, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def plain_damage(rows):
    sp = lambda x: " " if x is None else x
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def random_rows(seed, n, convs, long=0):
    rng = random.Random(seed)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system"] * 2 + ["tool", "ü", "", "usher: x", None, "User", "a" * 40, "a" * 40 + "b"]
    texts = ["ok.", "ok", "", " \t", None, "Why?", "no!\n", "so . x", "é.", "a" * 50 + "1.", "a" * 50 + "2.", "x.\x1c", ".\x0b", "end.:"]
    rows = []
    for i in range(n):
        conv = None if rng.random() < 0.05 else rng.randrange(convs)
        conv = 7 if rng.random() < long else conv
        turn = None if rng.random() < 0.1 else rng.choice([rng.randrange(12), rng.randrange(12), i])
        rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {i}."))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, `a.b` string").repartition(4)


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r for r in rows}


def test_parser_finds_the_least_of_all_edits():
    """Every sequence of edits with up to two inserts between rows, for all short conversations."""
    for n in range(4):
        for initials in itertools.product("suat", repeat=n):
            for faults in itertools.product(["", "t", "d"], repeat=n):
                best = (1 << 60, "")
                for edits in itertools.product("KRD", repeat=n):
                    for inserts in itertools.product(["", "I", "II"], repeat=n + 1):
                        last, cost, audit = "", 0, ""
                        for i in range(n + 1):
                            for e in inserts[i] + (edits[i] if i < n else ""):
                                audit += e
                                if e == "D":
                                    cost += 3
                                    continue
                                if e != "I" and faults[i] == "d":
                                    last = None
                                    break
                                cost += {"K": 0, "R": 2, "I": 2}[e] + (e != "I" and faults[i] == "t")
                                last = NEXT.get((last, initials[i])) if e == "K" else next((y for y in "ua" if (last, y) in NEXT), None)
                                if last is None:
                                    break
                            if last is None:
                                break
                        if last in ("", "a"):
                            best = min(best, (cost, audit))
                tops = {0: R.Node((0,), 0)}
                for x, f in zip(initials, faults):
                    tops = R.read_row(tops, x, f, 1)
                ends = [n2 for t, n2 in R.with_inserts(tops).items() if t in R.ACCEPTS]
                low = min((e.cost, "".join(x.edit for x in e.nodes())) for e in ends)
                assert low == best == plain_parse(initials, faults), (initials, faults)


def test_rows_equal_the_plain_walk(spark):
    rows = random_rows(1, 600, 60)
    assert got(R.repair(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_segments_of_any_size_join_up(spark, monkeypatch, size):
    monkeypatch.setattr(R, "ROWS", size)
    rows = random_rows(size, 400, 5, long=0.5)
    assert got(R.repair(frame(spark, rows))) == plain(rows)


def test_one_conversation_with_most_rows_is_spread(spark):
    """Roles that fit badly, equal rows by the thousand, and more rows than a segment takes."""
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), f"line {i}{rng.choice(['.', ''])}") for i in range(12_000)]
    rows += [(1, 50, "user", "the same.")] * 3000 + [(1, None, "tool", "")] * 2000 + [(2, 0, "user", "alone.")]
    df = frame(spark, rows)
    assert got(R.repair(df)) == plain(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        parts = R.segments(R.faults(df.select("conv_id", "turn", "role", "text"))).filter("conv_id = 1").select("part", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["part"] for r in parts}) > 1 and len(parts) > 3


def test_repaired_rows(spark):
    rows = random_rows(9, 200, 20)
    made = R.repaired(frame(spark, rows)).orderBy("conv_id", "part", "seq", "line").collect()
    by = collections.defaultdict(list)
    for r in made:
        by[r["conv_id"]].append((r["role"], r["text"]))
    audits = plain(rows)
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, " " if role is None else role, " " if text is None else text))
    want = {c: plain_repaired(sorted(o, key=order), audits[c][7]) for c, o in own.items()}
    assert dict(by) == {c: w for c, w in want.items() if w}


def test_long_text_empty_table_and_query(spark, tmp_path):
    assert R.repair(frame(spark, []).limit(0)).count() == 0
    rows = random_rows(3, 500, 150) + [(500, 0, "user", "word " * 200_000 + "."), (500, 1, "assistant", "x" * 300_000)]
    rows += [(900, t, "user", "gone.") for t in range(2000) if zlib.crc32(f"900:{t}".encode()) % 20 == 0]  # every row is dropped
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    df = queries.QUERIES["op13_repair"][0](spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [
        ("conv_id", "bigint"), *[(c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", "string"), ("repaired_sha256", "string")
    ]
    assert got(df) == plain(plain_damage(rows), {r[0] for r in rows})
