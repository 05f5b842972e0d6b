"""Size-aware similarity join of word-shingle sets.

Sets are ordered by one global order of shingles: first a share with the
smallest hashes, rarest first, then the others, counted in the sets that need
them (those whose share is too short), rarest first. The share is 5/3 of what a
set may lack, so common shingles seldom come among the first. Two sets whose overlap
reaches the wanted Jaccard similarity share at least k of the first
n - ceil(t * n) + k shingles. Small sets enumerate all 2-subsets of those (k = 2),
large sets are listed under each of those (k = 1); sets near the boundary do
both, so no pair is missed. The boundary is chosen by the cost of both ways.

Equal sets are one node. Members of a subset or list first meet its most typical
member, the one with the fullest prefix of shared shingles, and for each of some
minima of their hashes a member chosen anew among those that share it: a group in
which many pairs link, but few with any one member, becomes one component by that.
Components are formed; then only members of different components meet. Pairs are
sifted by parity bits: their Hamming distance is never above the number of
shingles in one set only, so what it rejects cannot link. A pair is listed under
the least of its common sigs, so that near copies do not come once for each.
A group of near copies so costs a number of pairs in proportion to its size, and
every pair that could join two components is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.arrays import _ODD, Block, blocks, columns, grams, mix, per_block, sequence_hash
from turnloom.llm.tables import any_columns, stored
from turnloom.operators.components import components
from turnloom.operators.ordering import first_wins

MEETS = 4  # members of a list that one entry meets, at most, for the cost: most of a long list is one component after the first meeting
PARITY = 512  # bits
MINIMA = 16  # further meetings of a set before components are formed; what they link is checked like the rest
FIRST = 16  # sigs of a node by which a pair that has met is known
BLOCK = 1 << 19  # bytes of text whose sets are made at once: the arrays of words, shingles and tokens take about 50 times as much
_BITS = [f"__b{i}" for i in range(PARITY // 64)]


def shingle_sets(block: Block, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    texts, starts, ends = block.words()
    hashes = block.hashes(starts, ends, lower=True)
    at, h = grams(hashes, texts, k)
    cut = np.searchsorted(texts[at], np.arange(block.n + 1))
    words = np.searchsorted(texts, np.arange(block.n + 1))
    out = []
    for i in range(block.n):
        a, b = words[i], words[i + 1]
        out.append(np.unique(h[cut[i] : cut[i + 1]]) if b - a >= k else sequence_hash(hashes[a:b]) if b > a else h[:0])
    return out


def node_of(shingles: np.ndarray) -> int:
    """64-bit name of a set; equal sets share it, different ones with a chance of 2^-64."""
    return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).astype(np.int64)[0])


def least_overlap(n: int | np.ndarray, percent: int):
    """Shingles that a set of n must share with any set it links to."""
    return -(-percent * n // 100)


def low_hashes(percent: int) -> np.uint64:
    """Hashes below this bound are the share that is ordered first."""
    return np.uint64(min((1 << 64) - 1, (1 << 64) * (100 - percent) // 60))


def parity(shingles: np.ndarray) -> np.ndarray:
    """Is the number of shingles odd, by the last bits of the hash; as 64-bit words."""
    odd = np.bincount((shingles % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def minima(shingles: np.ndarray) -> list[int]:
    """The least shingle under each of some orders; equal for two sets with a chance of their similarity."""
    return [int(mix(shingles * odd).min().astype(np.int64)) for odd in _ODD[:MINIMA]]


def may_link(a: str, b: str, percent: int) -> Column:
    """False only for rows a and b (n, parity bits) that cannot reach the similarity."""
    apart = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in _BITS)
    return F.expr(f"least({a}.n, {b}.n) * 100 >= greatest({a}.n, {b}.n) * {percent} and ({apart}) * {100 + percent} <= ({a}.n + {b}.n) * {100 - percent}")


def nodes(docs: DataFrame, keep: list[str], k: int) -> DataFrame:
    """The named columns with `__n` (set size) and `__node`."""
    chosen = docs.select(*keep, *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))
    fields = [f for f in chosen.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["__n bigint", "__node bigint"])

    def work(block: Block) -> pa.RecordBatch:
        sets = shingle_sets(block, k)
        return columns(block, keep, __n=np.array([len(s) for s in sets], np.int64), __node=np.array([node_of(s) for s in sets], np.int64))

    return chosen.mapInArrow(per_block(work, limit=BLOCK), schema)


def _tokens(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, node, n, m, low): the share of smallest hashes of each set, and the whole set where a prefix needs more; m counts the share."""
    bound = low_hashes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for block in blocks(batches, limit=BLOCK):
            token, node, size, lows, low = [], [], [], [], []
            for s in shingle_sets(block, k):
                n = len(s)
                room = n - int(least_overlap(n, percent))
                if not room and 100 * n < percent * (n + 1):
                    continue  # links to equal sets only: not even one further shingle is allowed on the other side
                name = node_of(s)
                if name in done:
                    continue
                if len(done) > 1_000_000:
                    done.clear()
                done.add(name)
                m = int(np.searchsorted(s, bound))
                take = m if m >= room + 2 else n
                token.append(s[:take].astype(np.int64))
                low.append(np.arange(take) < m)
                for out, value in ((node, name), (size, n), (lows, m)):
                    out.append(np.full(take, value, np.int64))
            if token:
                fields = {"token": token, "node": node, "n": size, "m": lows, "low": low}
                yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v)) for c, v in fields.items()}).cast(
                    pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("low", pa.bool_())])
                )

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token bigint, node bigint, n bigint, m bigint, low boolean")
    return rows.select("token", "node", F.col("n").cast("int").alias("n"), F.col("m").cast("int").alias("m"), "low")


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, n, one, two, typical): shared tokens with their counts among the first shingles, for k = 1 and 2, and how full of them the first are."""
    counted = _tokens(docs, k, percent).groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = _tokens(docs, k, percent).join(counted, "token")
    per = shared.groupBy("node", "n", "m").agg(F.sort_array(F.collect_set(F.struct((~F.col("low")).alias("late"), "c", "token"))).alias("s"))
    room = F.expr(f"n - cast(ceil(n * {percent} / 100D - 1e-9) as int)")
    late = F.array_position("s.late", True).cast("int")
    listed = per.withColumn("room", room).withColumn("size", F.size("s")).withColumn("early", F.when(late > 0, late - 1).otherwise(F.size("s")))

    def among(first: int) -> list[Column]:
        """How many early and late tokens lie among the first `room + first`, behind those of their class that no other set has, which are not listed."""
        left = F.col("room") + first
        return [F.least("early", F.greatest(left - F.col("m") + F.col("early"), F.lit(0))), F.least(F.col("size") - F.col("early"), F.greatest(left - F.col("n") + F.col("size") - F.col("early"), F.lit(0)))]

    for k, names in ((1, ("e1", "l1")), (2, ("e2", "l2"))):
        for name, c in zip(names, among(k)):
            listed = listed.withColumn(name, c)
    taken = lambda e, l: F.concat(F.slice("s", F.lit(1), F.col(e)), F.slice("s", F.col("early") + 1, F.col(l)))  # noqa: E731, E741
    number = F.col("e2") + F.col("l2")
    full = F.shiftleft((number * 1000 / (F.col("room") + 2)).cast("bigint"), 40) + F.col("node").bitwiseAND((1 << 40) - 1)  # ties by name
    return listed.filter(number > 0).select("node", "n", taken("e2", "l2").alias("two"), taken("e1", "l1").alias("one"), full.alias("typical"))


def boundary(prefixes: DataFrame) -> int:
    """Largest size of a small set: the one with the least subsets enumerated below and list entries scanned above."""
    s = F.size("two").cast("double")
    scan = F.aggregate("one", F.lit(0.0), lambda t, x: t + F.least(x["c"], F.lit(MEETS)))
    rows = (
        prefixes.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("bin"))
        .agg(F.max("n").alias("top"), F.sum(s * (s - 1) / 2).alias("small"), F.sum(scan).alias("large")).orderBy("bin").collect()
    )  # four rows per doubling of the size
    best, cut = sum(r["large"] for r in rows), 0
    for i, r in enumerate(rows):
        cost = sum(x["small"] for x in rows[: i + 1]) + sum(x["large"] for x in rows[i + 1 :])
        if cost < best:
            best, cut = cost, int(r["top"])
    return cut


def _buckets(prefixes: DataFrame, small: int, percent: int) -> DataFrame:
    """(sig, node, n, center) for sigs of two nodes or more."""
    lists = prefixes.filter(F.col("n") * 100 > small * percent).select(F.explode("one.token").alias("sig"), "node", "n", "typical").withColumn("kind", F.lit(1))
    tokens = F.array_sort("two.token")
    subsets = F.flatten(F.transform(tokens, lambda a: F.transform(F.filter(tokens, lambda b: b > a), lambda b: F.xxhash64(a, b))))
    pairs = prefixes.filter(F.col("n") <= small).select(F.explode(subsets).alias("sig"), "node", "n", "typical").withColumn("kind", F.lit(2))
    rows = lists.unionByName(pairs)
    many = rows.groupBy("sig", "kind").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max_by("node", "typical").alias("center")).filter("lo < hi")
    return rows.join(many.select("sig", "kind", "center"), ["sig", "kind"]).select(F.xxhash64("sig", "kind").alias("sig"), "node", "n", "center")


def _sets(docs: DataFrame, named: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles, n, parity bits) of the wanted nodes, made again from one text each."""
    one = named.join(wanted, named["__node"] == wanted["node"], "left_semi").groupBy("__node").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("d"))
    ids = one.select(F.col("d.doc_id").alias("__id"), F.col("__node").alias("__want"))
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"])).select(F.col("text").cast("string").alias("text"), "__want")

    def work(block: Block) -> pa.RecordBatch:
        sets = shingle_sets(block, k)
        bits = np.array([parity(s) for s in sets], np.int64).reshape(-1, len(_BITS))
        return columns(
            block, ["__want"], node=np.array([node_of(s) for s in sets], np.int64), shingles=pa.array([s.tobytes() for s in sets], pa.binary()),
            n=np.array([len(s) for s in sets], np.int64), mins=pa.array([minima(s) if len(s) else [] for s in sets], pa.list_(pa.int64())), **dict(zip(_BITS, bits.T)),
        )

    made = rows.mapInArrow(per_block(work, limit=BLOCK), "__want bigint, node bigint, shingles binary, n bigint, mins array<bigint>, " + ", ".join(f"{c} bigint" for c in _BITS))
    return made.filter("node = __want").drop("__want").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(s, t)
                both = int((s[np.minimum(at, len(s) - 1)] == t).sum()) if len(s) else 0
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _meetings(sets: DataFrame) -> DataFrame:
    """(center, node): members that share a minimum with one of them, another one for each order."""
    shared = sets.select("node", F.posexplode("mins").alias("j", "least"))
    several = shared.groupBy("j", "least").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min_by("node", F.xxhash64("node", "j")).alias("center")).filter("lo < hi")
    return shared.join(several.select("j", "least", "center"), ["j", "least"]).filter("node <> center").select("center", "node")


def _across(rest: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: nodes of different roots that share a sig and may link. Every such pair comes under the least sig that both have;
    under a further one only if the least they share is not among the FIRST least sigs of either."""
    groups = rest.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c"))
    major = groups.groupBy("sig").agg(F.max_by("root", F.struct("c", "root")).alias("major"))
    first = rest.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, FIRST).alias("first"))
    marked = rest.join(marks, "node").join(first, "node").join(major, "sig").withColumn("is_major", F.col("root") == F.col("major")).drop("major")
    once = F.col("y.is_major") | (F.col("x.node") < F.col("y.node"))
    new = F.expr("coalesce(array_min(array_intersect(x.first, y.first)) >= x.sig, true)")
    across = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & once & may_link("x", "y", percent) & new
    met = marked.filter("not is_major").alias("x").join(marked.alias("y"), across)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def linked(docs: DataFrame, named: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of all nodes that link to a different node."""
    prefixes = stored(_prefixes(docs, k, percent))
    buckets = stored(_buckets(prefixes, boundary(prefixes), percent))
    sets = stored(_sets(docs, named, buckets.select("node").distinct(), k))
    marks = sets.select("node", "n", *_BITS)
    pairs = buckets.filter("node <> center").select("center", "node").union(_meetings(sets)).distinct()
    met = pairs.join(marks.alias("x"), pairs["center"] == F.col("x.node")).join(marks.alias("y"), pairs["node"] == F.col("y.node"))
    star = stored(met.filter(may_link("x", "y", percent)).select(F.col("center").alias("a"), F.col("y.node").alias("b")))
    edges = stored(_verified(star, sets, percent))
    roots = components(edges)

    labelled = buckets.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("sig")
    rest = stored(labelled.join(mixed, "sig"))
    cross = _across(rest, marks, percent).distinct()
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(_verified(stored(cross.join(tested, ["a", "b"], "left_anti")), sets, percent))
    return components(edges.union(more)) if not more.isEmpty() else roots


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Named documents (doc_id, __n, __node) and (__node, component_id) of every node.

    docs(doc_id, text). A document's set holds its distinct k-word shingles, A-Z
    folded; with fewer words its whole word sequence is the only one; without words
    it is empty and linked with nothing. Documents link at `percent` % similarity.
    The component is the smallest doc_id reachable; rows without a doc_id take part
    but give no name, so a group of them alone has a null one.
    """
    named = stored(nodes(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"], k))
    full = named.filter("__n > 0").groupBy("__node").agg(F.min("doc_id").alias("least"))
    roots = linked(docs, named, k, percent).select(F.col("node").alias("__node"), "root")
    placed = full.join(roots, "__node", "left").withColumn("root", F.coalesce("root", "__node"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return named, placed.join(names, "root").select("__node", "component_id")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; an empty set's component is its own doc_id."""
    named, names = groups(docs, k, percent)
    out = named.join(names, "__node", "left")
    return out.select("doc_id", F.col("__n").alias("n_shingles"), F.when(F.col("__n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@any_columns("doc_id", "text")
def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without the others of each group: the smallest doc_id stays, then the smallest text. Empty sets all stay."""
    named, names = groups(docs, k, percent)
    rows = nodes(docs, docs.columns, k).join(names.withColumnRenamed("component_id", "__component"), "__node", "left")
    full = first_wins(rows.filter("__n > 0").withColumn("__group", F.coalesce(F.col("__component").cast("string"), F.concat(F.lit("n"), F.col("__node")))), ["__group"], [F.col("doc_id").asc_nulls_last(), F.col("text")])
    return full.select(*docs.columns).unionByName(rows.filter("__n = 0").select(*docs.columns))
