"""Quality rules whose cutoffs carry a guarantee on labelled holdouts.

Each rule rejects documents whose value lies above a cutoff. Half of the labelled
documents of a stratum choose one sequence of sets of cutoffs, from the loosest
to the strictest, rule after rule. The other half tests it: a set stands while
an exact binomial test shows that all its rules together reject less than the
allowed share of good documents, and the first that does not ends the sequence.
Only the level is split, over the strata, so with probability 1 - `delta` no
stratum loses more than `allowed` of its good documents. Among the sets that
stand, the one that parts bad from good best is used; what gains nothing is off.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.arrays import Block, columns, grams, per_block
from turnloom.llm.tables import any_columns, stored

SYMBOLS = b"#*$%&|<>"
STEPS = 40
#: value of each rule as a share from 0 to 1; above its cutoff a document is rejected
RULES = {
    "symbols": "least(1D, __n_symbols / greatest(__n_words, 1))",
    "repeats": "__n_repeat_words / greatest(__n_words, 1)",
    "lines": "__n_dup_lines / greatest(__n_lines, 1)",
    "capitals": "__n_upper / greatest(__word_chars, 1)",
    "marks": "least(1D, __n_marks / greatest(__n_words, 1))",
    "long_words": "least(1D, __word_chars / greatest(__n_words, 1) / 40)",
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def _table(marked: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(marked)] = True
    return table


_SYMBOL, _UPPER, _MARK = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"!?")
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False


def counts(block: Block, window: int = 5) -> dict[str, np.ndarray]:
    """The counts of each text of a block; a null text counts as empty."""
    n, data = block.n, block.data
    texts, starts, ends = block.words()
    out = {
        "n_words": np.bincount(texts, minlength=n),
        "word_chars": block.per_text(_STARTS_CHAR[data] & _INSIDE[data]),
        "n_symbols": block.per_text(_SYMBOL[data]),
        "n_upper": block.per_text(_UPPER[data]),
        "n_marks": block.per_text(_MARK[data]),
    }
    own, first, last = block.lines()
    worded = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    own, first, last = own[worded], first[worded], last[worded]
    out["n_lines"] = np.bincount(own, minlength=n)
    different = np.unique(np.stack((own.astype(np.uint64), block.hashes(first, last, lower=False)), axis=1), axis=0)[:, 0]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(different.astype(np.int64), minlength=n)
    at, h = grams(block.hashes(starts, ends, lower=False), texts, window)
    order = np.lexsort((h, texts[at]))
    same = (h[order][1:] == h[order][:-1]) & (texts[at][order][1:] == texts[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(texts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + window, -1)
    out["n_repeat_words"] = np.bincount(texts[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def measured(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The named columns of `docs` with the counts of the text and whether the base rules fail."""
    chosen = docs.select(*keep, *([] if "text" in keep else ["text"]))
    fields = [f for f in chosen.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"__{c} bigint" for c in _COUNTS])

    def work(block: Block) -> pa.RecordBatch:
        got = counts(block)
        return columns(block, keep, **{f"__{c}": got[c].astype(np.int64) for c in _COUNTS})

    return chosen.mapInArrow(per_block(work, limit=1 << 20), schema)


def tail(n: int, k: int, p: float) -> float:
    """P(at most k of n) for a share p, summed exactly."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def _best_step(good: np.ndarray, bad: np.ndarray, stands: Callable[[int, int], bool]) -> int:
    """Of the cutoffs from the loosest on that stand, the one that parts bad from good best; cutoff i rejects what is counted above i, the last one nothing."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    best, gain = len(good) - 1, 0.0
    for step in range(len(good) - 2, -1, -1):
        lost, won = int(good[step + 1 :].sum()), int(bad[step + 1 :].sum())
        if not n_good or not stands(n_good, lost):
            break
        if n_bad and won / n_bad - 20 * lost / n_good > gain:
            best, gain = step, won / n_bad - 20 * lost / n_good
    return best


def _certified(allowed: float, level: float) -> Callable[[int, int], bool]:
    return lambda n, lost: lost <= allowed * n and tail(n, lost, allowed) <= level


def best_cutoff(good: np.ndarray, bad: np.ndarray, allowed: float, level: float) -> float:
    """Cutoff for one sequence of STEPS from the numbers of good and bad documents by step (index: smallest step at or above the value)."""
    step = _best_step(good, bad, _certified(allowed, level))
    return step / STEPS if step <= STEPS else math.inf


def sequence(good: np.ndarray, bad: np.ndarray, allowed: float) -> list[tuple[int, int]]:
    """Moves (rule, step) that tighten the cutoffs one by one, from counts [rule, step] of the learning half.

    The rule that parts bad from good best comes first, down to its best cutoff, then the next.
    """
    moves, n_good, n_bad = [], max(1, int(good[0].sum())), max(1, int(bad[0].sum()))
    for rule in range(len(good)):
        best = _best_step(good[rule], bad[rule], lambda n, lost: lost <= allowed * n)
        won, lost = int(bad[rule][best + 1 :].sum()), int(good[rule][best + 1 :].sum())
        moves += [(lost / n_good * 20 - won / n_bad, rule, -s) for s in range(STEPS, best - 1, -1) if bad[rule][s + 1]]
    return [(rule, -s) for _, rule, s in sorted(moves)]


def cutoffs(values: DataFrame, labels: DataFrame, stratum: str, allowed: float, delta: float) -> DataFrame:
    """`stratum`, one cutoff column per rule, from the labelled documents of `values`.

    values(doc_id, stratum, rule columns, __base_failed); labels(doc_id, quality), where 1 is good and
    null or other values are not used. A document labelled both ways is not used. Half
    of the ids choose the sequence of each stratum, the others test it. Bad documents
    that the base rules reject count as no gain.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("__lo"), F.max("quality").alias("__hi"))
    steps = F.array(*[F.ceil(F.col(r) * STEPS).cast("int") for r in RULES])
    joined = values.join(known.filter("__lo = __hi").select("doc_id", F.col("__lo").alias("__good")), "doc_id").filter("__good = 1 or not __base_failed")
    joined = stored(joined.select(stratum, "__good", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("__learn"), steps.alias("__steps")))
    sums = [F.sum("__good").alias("good"), F.sum(1 - F.col("__good")).alias("bad")]
    table = joined.filter("__learn").select(stratum, "__good", F.posexplode("__steps").alias("rule", "step")).groupBy(stratum, "rule", "step").agg(*sums)
    strata = max(1, joined.select(stratum).distinct().count())
    names = list(RULES)

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros((len(names), STEPS + 2), np.int64), np.zeros((len(names), STEPS + 2), np.int64)
        at = (rows["rule"].to_numpy(int), rows["step"].to_numpy(int))
        np.add.at(good, at, rows["good"].to_numpy(int))
        np.add.at(bad, at, rows["bad"].to_numpy(int))
        moves = sequence(good, bad, allowed)
        return pd.DataFrame([{stratum: rows[stratum].iloc[0], "rules": [r for r, _ in moves], "ends": [s for _, s in moves]}])

    moves = stored(table.groupBy(stratum).applyInPandas(order, f"`{stratum}` string, rules array<int>, ends array<int>").filter("size(rules) > 0"))
    held = joined.filter("not __learn").join(F.broadcast(moves) if moves.count() <= SMALL else moves, stratum)
    # how many of the moves, counted from the last, reject the document by any rule
    depth = F.expr("array_max(transform(rules, (r, i) -> if(__steps[r] > ends[i], size(rules) - i, 0))) as depth")
    tested = held.select(stratum, "__good", depth).groupBy(stratum, "depth").agg(*sums).join(moves, stratum)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rules, ends = rows["rules"].iloc[0], rows["ends"].iloc[0]
        good, bad = np.zeros(len(rules) + 2, np.int64), np.zeros(len(rules) + 2, np.int64)
        np.add.at(good, rows["depth"].to_numpy(int), rows["good"].to_numpy(int))
        np.add.at(bad, rows["depth"].to_numpy(int), rows["bad"].to_numpy(int))
        taken = max(0, len(rules) - _best_step(good, bad, _certified(allowed, delta / strata)))
        out = {f"__cut_{r}": math.inf for r in names}
        for rule, end in list(zip(rules, ends))[:taken]:
            out[f"__cut_{names[rule]}"] = end / STEPS
        return pd.DataFrame([{stratum: rows[stratum].iloc[0], **out}])

    schema = f"`{stratum}` string, " + ", ".join(f"__cut_{r} double" for r in names)
    return tested.groupBy(stratum).applyInPandas(choose, schema)


SMALL = 10_000  # strata

def _valued(rows: DataFrame) -> DataFrame:
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("null"))
    base = (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))
    return rows.withColumn("__stratum", stratum).withColumn("__base_failed", base).withColumns({f"__r_{r}": F.expr(e) for r, e in RULES.items()})


@any_columns("doc_id", "text", "lang")
def judge(docs: DataFrame, labels: DataFrame, keep: Sequence[str], allowed: float = 0.03, delta: float = 0.1) -> DataFrame:
    """The named columns of `docs` with the counts (`__n_words` and so on), `__base_failed` and `__kept`.

    docs(doc_id, text, lang): strata are the values of `lang`, null one of them. A
    stratum without enough labelled documents rejects nothing beyond the base rules.
    A null text has no words and fails the base rules. Every row stays, repeated or not.
    """
    carried = list(dict.fromkeys([*keep, "doc_id", "lang"]))
    narrow = _valued(stored(measured(docs, ["doc_id", "lang"])))
    chosen = stored(cutoffs(narrow.selectExpr("doc_id", "__stratum", "__base_failed", *[f"__r_{r} as `{r}`" for r in RULES]), labels.select("doc_id", "quality"), "__stratum", allowed, delta))
    chosen = F.broadcast(chosen) if chosen.count() <= SMALL else chosen
    rows = narrow if set(carried) <= {"doc_id", "lang"} else _valued(measured(docs, carried))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(f"__r_{r}") > F.coalesce(F.col(f"__cut_{r}"), F.lit(math.inf)))
    out = rows.join(chosen, "__stratum", "left").withColumn("__kept", ~F.col("__base_failed") & ~rejected)
    return out.select(*carried, *[f"__{c}" for c in _COUNTS], "__base_failed", "__kept")
