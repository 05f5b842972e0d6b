"""One-to-one matching where every `b`, in order, takes its first free `a`.

Taken one after the other this is a driver loop over all rows. Here a few rounds
settle every pair that is the best one left for both ends: no earlier `b` can
still want that `a`, and no earlier `a` is left for that `b`, so the sequential
result must contain the pair. What then still depends on each other is cut into
connected components, and each component is walked in order by one task as its
rows stream past; the walk holds the ends that are taken. The number of rounds
is fixed, however long a chain of dependent pairs is: only within such a chain
is there no other order than one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.components import components
from turnloom.operators.ordering import number_rows
from turnloom.session import cut

ROUNDS = 3


def match_in_order(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`pairs(a, a_order, b, b_order)` -> matched `(a, b)`. Orders are unique and comparable."""
    left = cut(pairs.select("a", "a_order", "b", "b_order").distinct())
    done: list[DataFrame] = []
    for _ in range(rounds):
        if left.isEmpty():
            break
        best_a = left.groupBy("b").agg(F.min("a_order").alias("a_order"))
        best_b = left.groupBy("a").agg(F.min("b_order").alias("b_order"))
        settled = cut(
            left.join(best_a, ["b", "a_order"], "left_semi").join(best_b, ["a", "b_order"], "left_semi").select("a", "b")
        )
        done.append(settled)
        left = cut(
            left.join(settled.select("a"), "a", "left_anti").join(settled.select("b"), "b", "left_anti")
        )
    if not left.isEmpty():
        done.append(_walked(left))
    return reduce(DataFrame.unionByName, done) if done else pairs.select("a", "b").limit(0)


def _name(side: str, *values: str) -> Column:
    """A short name of an end of a pair; the two sides never meet."""
    return F.concat(F.lit(side), F.md5(F.to_json(F.struct(*values))))


def _walked(pairs: DataFrame) -> DataFrame:
    """The sequential result of `pairs`, component by component."""
    named = cut(pairs.withColumns({"x": _name("a", "a"), "y": _name("b", "b")}))
    roots = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    placed = named.join(roots.withColumnsRenamed({"node": "y"}), "y")
    ordered = placed.repartition("root").sortWithinPartitions("root", "b_order", "a_order").select("root", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, settled, taken = None, None, set()
        for batch in batches:
            hits = []
            for r, x, y in zip(*(batch.column(c).to_pylist() for c in ("root", "x", "y"))):
                if r != root:
                    root, settled, taken = r, None, set()
                hit = y != settled and x not in taken
                if hit:
                    settled = y
                    taken.add(x)
                hits.append(hit)
            yield batch.filter(pa.array(hits, pa.bool_())).select(["x", "y"])

    return named.join(ordered.mapInArrow(run, "x string, y string"), ["x", "y"], "left_semi").select("a", "b")


def match_by_class(members: DataFrame, arriving: DataFrame, pairs: DataFrame, classes: list[str]) -> DataFrame:
    """Every `b`, in order, takes the first free `a` of its class or of its own `pairs`.

    `members(*classes, a, a_order, a_block)`: an `a` may be in several classes.
    `arriving(*classes, b, b_order, b_block)`: a `b` is in one. `pairs(a, b)` are
    further choices. Blocks never decrease along the orders of a class. Returns `(a, b)`.

    Where no choice leads out of a class, or into it, its k-th `b` takes its k-th `a`:
    both are numbered in blocks and joined, whatever the size of the class. Classes that
    such choices connect form components; a component is walked in order by one task,
    with a row per member, arrival and choice, never a pair per two members of a class.
    """
    key = _name("k", *classes)
    a = cut(members.select(key.alias("k"), "a", "a_order", "a_block").distinct())
    b = cut(arriving.select(key.alias("k"), "b", "b_order", "b_block"))
    out = pairs.select("a", "b").distinct().join(b.select("b", F.col("k").alias("kb")), "b").join(a.select("a", F.col("k").alias("ka")), "a")
    crossing = cut(out.filter("ka <> kb"))
    several = a.groupBy("a").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("a", "lo")
    edges = crossing.select(F.col("ka").alias("a"), F.col("kb").alias("b")).union(a.join(several, "a").select(F.col("lo").alias("a"), F.col("k").alias("b")))
    roots = cut(components(edges.filter("a <> b").distinct()).withColumnRenamed("node", "k"))

    free_a, free_b = a.join(roots, "k", "left_anti"), b.join(roots, "k", "left_anti")
    both = free_b.select("k").distinct()
    nth_a = number_rows(free_a.join(both, "k", "left_semi"), ["k"], F.col("a_block"), ["a_order"], "n").select("k", "n", "a")
    nth_b = number_rows(free_b, ["k"], F.col("b_block"), ["b_order"], "n").select("k", "n", "b")
    plain = nth_a.join(nth_b, ["k", "n"]).select("a", "b")
    return plain.unionByName(_walked_classes(a.join(roots, "k"), b.join(roots, "k"), crossing))


def _walked_classes(a: DataFrame, b: DataFrame, crossing: DataFrame) -> DataFrame:
    """`a(k, a, a_order, root)` and `b(k, b, b_order, root)` of connected classes with the choices between them."""
    named_a = a.withColumn("x", _name("a", "a"))
    named_b = cut(b.withColumn("y", _name("b", "b")))
    names = cut(named_a.select("a", "x").distinct())
    no = F.lit(None).cast("string")
    # the a's of a component by order, a row per class; then the b's by order, a row for the class and one per choice
    none_a = F.lit(None).cast(a.schema["a_order"].dataType).alias("a_order")
    none_b = F.lit(None).cast(b.schema["b_order"].dataType).alias("b_order")
    rows_a = named_a.select("root", F.lit(0).alias("kind"), "a_order", none_b, "k", "x", no.alias("y"))
    own = named_b.select("root", F.lit(1).alias("kind"), none_a, "b_order", "k", no.alias("x"), "y")
    other = named_b.join(crossing.select("a", "b"), "b").join(names, "a").select("root", F.lit(1).alias("kind"), none_a, "b_order", no.alias("k"), "x", "y")
    rows = rows_a.unionByName(own).unionByName(other)
    ordered = rows.repartition("root").sortWithinPartitions("root", "kind", "a_order", "b_order", "k", "x").select("root", "kind", "k", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, root = None, None
        for batch in batches:
            made = []
            for r, kind, k, x, y in zip(*(batch.column(c).to_pylist() for c in ("root", "kind", "k", "x", "y"))):
                if r != root or walk is None:
                    made += walk.settle() if walk else []
                    walk, root = _Walk(), r
                if kind == 0:
                    walk.member(k, x)
                else:
                    made += walk.choice(y, k, x)
            yield pa.RecordBatch.from_pydict({"x": pa.array([m[0] for m in made], pa.string()), "y": pa.array([m[1] for m in made], pa.string())})
        if walk:
            last = walk.settle()
            yield pa.RecordBatch.from_pydict({"x": pa.array([m[0] for m in last], pa.string()), "y": pa.array([m[1] for m in last], pa.string())})

    matched = ordered.mapInArrow(run, "x string, y string")
    return matched.join(names, "x").join(named_b.select("y", "b"), "y").select("a", "b")


class _Walk:
    """A component as it streams past: members first, by order, then arrivals with their choices."""

    def __init__(self):
        self.place: dict[str, int] = {}  # of each a in the order of all
        self.names: list[str] = []
        self.lists: dict[str, list[int]] = {}  # places per class
        self.front: dict[str, int] = {}  # first place of a class that may be free
        self.taken: set[int] = set()
        self.now: str | None = None
        self.best: int | None = None

    def member(self, k: str, x: str) -> None:
        if x not in self.place:
            self.place[x] = len(self.names)
            self.names.append(x)
        self.lists.setdefault(k, []).append(self.place[x])

    def choice(self, y: str, k: str | None, x: str | None) -> list[tuple[str, str]]:
        out = self.settle() if y != self.now else []
        self.now = y
        at = self.place[x] if x is not None else self._first(k)
        if at is not None and at not in self.taken and (self.best is None or at < self.best):
            self.best = at
        return out

    def _first(self, k: str) -> int | None:
        own, i = self.lists.get(k, []), self.front.get(k, 0)
        while i < len(own) and own[i] in self.taken:
            i += 1
        self.front[k] = i
        return own[i] if i < len(own) else None

    def settle(self) -> list[tuple[str, str]]:
        """The arrival that has shown all its choices takes the first of them."""
        best, self.best = self.best, None
        if best is None:
            return []
        self.taken.add(best)
        return [(self.names[best], self.now)]
