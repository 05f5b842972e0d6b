"""Conversation repair: generalised LR parsing of role sequences with weighted edits.

The role grammar is

    C -> H L | (nothing)      H -> s | (nothing)      L -> T | L T      T -> u a

Every row is kept, rerolled or deleted and empty rows may be inserted; each way
is a stack of the LR table. Stacks live in a graph: a node holds its stack and
points to the node it came from, so histories are shared. After every row nodes
with equal stack tops are merged into the one of least (cost, audit). Two nodes
behind the same rows never have audits of which one begins the other at equal
cost (an insertion costs), so what is least stays least whatever follows.

That also lets a conversation be parsed in segments: a segment starts from each
stack top it may meet, and the least ways between tops are put together in
order. Rows are dealt by ranges of (conversation, turn, ...), so a conversation
of any length is spread over tasks; equal rows are folded into one with a count
before that. What follows a conversation through one task is a few strings per
segment, and the SHA-256 of its text, which has no other order; both are
streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from turnloom.llm.tables import stored

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2  # costs
TRUNCATED = 1  # for a truncated row that stays
ROLES = {"u": "user", "a": "assistant"}  # what rows may become
SHIFT = {(0, "s"): 6, (1, "u"): 2, (2, "a"): 4, (3, "u"): 2}
EMPTY = {(0, "u"): "H"}  # reduce nothing to H before this symbol
REDUCE = {6: ("H", 1), 4: ("T", 2), 5: ("L", 1), 7: ("L", 2)}
GOTO = {(0, "H"): 1, (1, "T"): 5, (3, "T"): 7, (1, "L"): 3}
STARTS = {0: (0,), 1: (0, 1), 2: (0, 1, 2), 3: (0, 1, 3)}  # a stack for each top between rows
ACCEPTS = {0, 3}
ROWS, BYTES = 4096, 4 << 20  # of a segment

_SPACE = r"\x20\x09-\x0D"
_PAIRS = {"su", "ua", "au"}


@lru_cache(maxsize=None)
def shift(stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
    """The stack after a symbol and all reductions; None if the symbol can't come."""
    while (top := stack[-1], symbol) not in SHIFT:
        if (top, symbol) not in EMPTY:
            return None
        stack = (*stack, GOTO[top, EMPTY[top, symbol]])
    stack = (*stack, SHIFT[stack[-1], symbol])
    while stack[-1] in REDUCE:
        name, size = REDUCE[stack[-1]]
        stack = stack[:-size]
        stack = (*stack, GOTO[stack[-1], name])
    return stack


class Node:
    """A stack, what it cost, and the edit that led here from `back`."""

    __slots__ = ("stack", "cost", "back", "edit", "depth", "mark")

    def __init__(self, stack, cost, back=None, edit="", mark=None):
        self.stack, self.cost, self.back, self.edit, self.mark = stack, cost, back, edit, mark
        self.depth = back.depth + 1 if back else 0

    def less(self, other: Node) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        one, two, p, q = [], [], self, other
        while p is not q:  # up to the last common node
            if p.depth >= q.depth:
                one.append(p.edit)
                p = p.back
            else:
                two.append(q.edit)
                q = q.back
        return "".join(reversed(one)) < "".join(reversed(two))

    def nodes(self) -> list[Node]:
        """From the first edit to this one."""
        out, node = [], self
        while node.back:
            out.append(node)
            node = node.back
        return out[::-1]


def merge(tops: dict[int, Node], node: Node) -> None:
    """Keeps the least of the nodes with an equal stack top."""
    held = tops.get(node.stack[-1])
    if held is None or node.less(held):
        tops[node.stack[-1]] = node


def with_inserts(tops: dict[int, Node]) -> dict[int, Node]:
    """The tops and those behind one or two inserted rows; a third one would come back to a top at a higher cost."""
    out, fresh = dict(tops), list(tops.values())
    for _ in range(2):
        made = [Node(s, n.cost + INSERT, n, "I") for n in fresh for symbol in ROLES if (s := shift(n.stack, symbol))]
        for n in made:
            merge(out, n)
        fresh = made
    return out


def read_row(tops: dict[int, Node], initial: str, fault: str, copies: int) -> dict[int, Node]:
    """The tops after a row; `fault` is its first fault (b, d, t or none), later copies are deleted."""
    out: dict[int, Node] = {}
    for n in tops.values():
        merge(out, Node(n.stack, n.cost + DELETE, n, "D"))
    if fault not in ("b", "d"):
        extra = TRUNCATED if fault == "t" else 0
        for n in with_inserts(tops).values():
            if s := shift(n.stack, initial):
                merge(out, Node(s, n.cost + KEEP + extra, n, "K"))
            for symbol in ROLES:
                if s := shift(n.stack, symbol):
                    merge(out, Node(s, n.cost + REROLE + extra, n, "R"))
    if copies > 1:
        out = {t: Node(n.stack, n.cost + DELETE * (copies - 1), n, "D" * (copies - 1)) for t, n in out.items()}
    return out


def replay(start: int, audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows (role, text) from the ones before, one of these per D, K or R."""
    stack, source = STARTS[start], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "D":
            continue
        if edit == "K":
            stack = shift(stack, role[:1])
        else:
            symbol = next(x for x in ROLES if shift(stack, x))
            stack, role = shift(stack, symbol), ROLES[symbol]
        yield role, text


class Segment:
    """Consecutive rows of one conversation, parsed from every top that may come before them."""

    def __init__(self, conv, fresh: bool):
        self.conv, self.size = conv, 0
        self.tops = {s: {s: Node(STARTS[s], 0)} for s in (STARTS if not fresh else (0,))}
        self.counts = {"b": 0, "d": 0, "t": 0}
        self.illegal, self.first, self.last = 0, None, None
        self.rows: list[dict] = []

    def add(self, role: str, text: str, n: int, fault: str) -> None:
        initial = role[:1]
        for s in self.tops:
            self.tops[s] = read_row(self.tops[s], initial, fault, n)
        if fault:
            self.counts[fault] += 1
        self.counts["b" if fault == "b" else "d"] += n - 1
        self.illegal += n - 1 + (self.first is not None and self.last + initial not in _PAIRS)
        self.first = initial if self.first is None else self.first
        self.last = initial
        gone = fault in ("b", "d")
        self.rows.append({"role": role, "text": "" if gone else text, "n": n})
        self.size += len(text) if not gone else 0

    def full(self) -> bool:
        return len(self.rows) >= ROWS or self.size >= BYTES

    def record(self, part: int, seq: int) -> dict:
        ways = [
            {"start": s, "top": t, "cost": n.cost, "audit": "".join(x.edit for x in n.nodes())}
            for s, tops in self.tops.items() for t, n in tops.items()
        ]
        return {
            "conv_id": self.conv, "part": part, "seq": seq, "first": self.first, "last": self.last, "illegal": self.illegal,
            "blank": self.counts["b"], "duplicate": self.counts["d"], "truncated": self.counts["t"], "ways": ways, "rows": self.rows,
        }


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_SEGMENT = (
    "part int, seq int, first string, last string, illegal long, blank long, duplicate long, truncated long, "
    "ways array<struct<start int, top int, cost long, audit string>>, rows array<struct<role string, text string, n long>>"
)
_CHOSEN = "part int, seq int, start int, edits string, cost long, blank long, duplicate long, truncated long, illegal long"


def _schema(conv: StructField, ddl: str) -> StructType:
    return StructType([conv, *StructType.fromDDL(ddl).fields])


def _python_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _batches(records: Iterator[dict], schema: pa.Schema, size: int = 256, limit: int = BYTES) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in records:
        held.append(r)
        weight += sum(len(x["text"]) for x in r["rows"]) if "rows" in r else len(r.get("edits") or "")
        if len(held) >= size or weight >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n, fault of the distinct rows; null roles and texts are one space.

    `n` counts equal rows. `fault` is the first row's: b (blank), d (role and text
    seen at an earlier turn), t (truncated) or empty.
    """
    whole = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    folded = stored(whole.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    firsts = folded.groupBy("conv_id", "role", "text").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("f")).filter("c > 1")
    firsts = firsts.select(F.col("conv_id").alias("c2"), F.col("role").alias("r2"), F.col("text").alias("t2"), "f")
    same = F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("r2")) & (F.col("text") == F.col("t2"))
    later = F.coalesce(place > F.col("f"), F.lit(False))
    fault = (
        F.when(~F.col("text").rlike(f"[^{_SPACE}]"), "b").when(later, "d").when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), "t").otherwise("")
    )
    return folded.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def segments(rows: DataFrame) -> DataFrame:
    """Parsed segments of faults(rows), ordered by (part, seq) within a conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema

    # short keys for the ranges, never against the order of the whole rows
    role = F.substring("role", 1, 32)
    text = F.when(F.char_length("role") <= 32, F.substring("text", 1, 32)).asc_nulls_last()
    dealt = rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), role, text)
    ordered = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    schema = _schema(rows.schema["conv_id"], _SEGMENT)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, seq, at = TaskContext.get().partitionId(), 0, None
        for r in _python_rows(batches):
            if at is None or at.conv != r["conv_id"] or at.full():
                fresh = at is not None and at.conv != r["conv_id"]  # the first one may go on from the range before
                if at is not None:
                    yield at.record(part, seq)
                    seq += 1
                at = Segment(r["conv_id"], fresh)
            at.add(r["role"], r["text"], r["n"], r["fault"])
        if at is not None:
            yield at.record(part, seq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(parse(batches), to_arrow_schema(schema))

    return ordered.mapInArrow(run, schema)


def _by_conversation(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq")


def _runs(records: Iterator[dict]) -> Iterator[Iterator[dict]]:
    """Consecutive records of equal conv_id (null counts as a value), streamed."""
    from itertools import groupby

    for _, run in groupby(records, key=lambda r: (r["conv_id"] is None, r["conv_id"])):
        yield run


def chosen(parsed: DataFrame) -> DataFrame:
    """The least way through each conversation: start and edits per segment, totals on its last one."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(parsed.schema["conv_id"], _CHOSEN)

    def stitch(segs: Iterator[dict]) -> Iterator[dict]:
        tops, total, last = {0: Node(STARTS[0], 0)}, dict.fromkeys(COUNTS, 0), None
        for seg in segs:
            met: dict[int, Node] = {}
            for w in seg["ways"]:
                if w["start"] in tops:
                    back = tops[w["start"]]
                    merge(met, Node(STARTS[w["top"]], back.cost + w["cost"], back, w["audit"], (seg["part"], seg["seq"], w["start"])))
            tops = met
            for c in COUNTS:
                total[c] += seg[c]
            total["illegal"] += last is not None and last + seg["first"] not in _PAIRS
            last, conv = seg["last"], seg["conv_id"]
        end: dict[int, Node] = {}
        for t, n in with_inserts(tops).items():
            if t in ACCEPTS and (not end or n.less(end[0])):
                end[0] = n
        path = end[0].nodes()
        tail = "".join(n.edit for n in path if n.mark is None)  # inserts behind the last row
        path = [n for n in path if n.mark is not None]
        for n in path:
            part, seq, start = n.mark
            out = {"conv_id": conv, "part": part, "seq": seq, "start": start, "edits": n.edit}
            yield out if n is not path[-1] else out | total | {"edits": n.edit + tail, "cost": end[0].cost}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((r for segs in _runs(_python_rows(batches)) for r in stitch(segs)), to_arrow_schema(schema))

    return _by_conversation(parsed.drop("rows")).mapInArrow(run, schema)


def _lines(seg: dict) -> Iterator[tuple[str, str]]:
    return replay(seg["start"], seg["edits"], ((r["role"], r["text"]) for r in seg["rows"] for _ in range(r["n"])))


def lines(parsed: DataFrame, ways: DataFrame) -> DataFrame:
    """conv_id, part, seq, line, role, text: the repaired rows in order."""
    schema = _schema(parsed.schema["conv_id"], "part int, seq int, line int, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for seg in _python_rows(batches):
            place = {c: seg[c] for c in ("conv_id", "part", "seq")}
            made = [place | {"line": i, "role": role, "text": text} for i, (role, text) in enumerate(_lines(seg))]
            yield pa.RecordBatch.from_pylist(made, to_arrow_schema(schema))

    met = parsed.select("conv_id", "part", "seq", "rows").join(ways.select("part", "seq", "start", "edits"), ["part", "seq"])
    return met.select("conv_id", "part", "seq", "rows", "start", "edits").mapInArrow(run, schema)


def _digests(parsed: DataFrame, ways: DataFrame) -> DataFrame:
    """One row per conversation: the totals, audit and repaired_sha256."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(parsed.schema["conv_id"], "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def digest(segs: Iterator[dict]) -> dict:
        sha, edits, empty = hashlib.sha256(), [], True
        for seg in segs:
            edits.append(seg["edits"])
            for role, text in _lines(seg):
                sha.update(f"{role}:{text}".encode() if empty else f"\n{role}:{text}".encode())
                empty = False
        return {c: seg[c] for c in ("conv_id", *COUNTS, "cost")} | {"audit": "".join(edits), "repaired_sha256": sha.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((digest(segs) for segs in _runs(_python_rows(batches))), to_arrow_schema(schema))

    met = parsed.select("conv_id", "part", "seq", "rows").join(ways.drop("conv_id"), ["part", "seq"])
    return _by_conversation(met).mapInArrow(run, schema)


def gaps(rows: DataFrame) -> DataFrame:
    """conv_id and the turns missing between its least and largest; 0 without turns, null beyond 64 bits."""
    wide = lambda c: c.cast("decimal(38,0)")
    missing = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.countDistinct("turn"))
    found = rows.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0).cast("decimal(38,0)")).alias("g"))
    return found.select("conv_id", F.expr("try_cast(g as bigint)").alias("gaps"))


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conversation.

    rows(conv_id, turn, role, text) are read by turn, nulls first, equal turns by
    role and text. Null roles and texts are one space; rows without a conv_id are
    one conversation. Equal rows are all there: the later ones count as blank or
    duplicate and are deleted. `conversations(conv_id)` names further ones to
    return; those without rows have zeros, an empty audit and the hash of nothing.
    A text of any length is one row; other columns are not read.
    """
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    parsed = stored(segments(stored(faults(rows))))
    found = _digests(parsed, stored(chosen(parsed)))
    ids = rows.select("conv_id") if conversations is None else conversations.select("conv_id").union(rows.select("conv_id"))
    out = ids.distinct().alias("i")
    for name, side in (("d", found), ("g", gaps(rows))):
        out = out.join(side.alias(name), F.col("i.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c.split(".")[1])
    known = F.when(F.col("d.audit").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("g.gaps")).alias("gaps")
    digest = F.coalesce("d.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return out.select("i.conv_id", known, *[zero(f"d.{c}") for c in (*COUNTS, "cost")], F.coalesce("d.audit", F.lit("")).alias("audit"), digest)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, part, seq, line, role, text: the rows after repair; (part, seq, line) orders a conversation."""
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    parsed = stored(segments(stored(faults(rows))))
    return lines(parsed, stored(chosen(parsed)))


def _kind() -> Column:
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return F.crc32(key) % 20


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with a fifth part hurt, by crc32 of `conv_id:turn` mod 20.

    0: the row goes; 1: its text is emptied; 2: its sentence ends go; 3: it comes
    twice; 4: its role is user. Nulls are one space, but for the turn itself.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = _kind()
    return rows.filter(kind != 0).select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
