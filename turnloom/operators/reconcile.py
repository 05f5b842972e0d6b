"""Merging the candidates of several extractors without losing evidence.

Candidates are rows with `item_id, doc_id, conv_pos, o1, o2, o3` (arrival order
inside an extractor), the item columns, `origin, assertion, evidence` and
`extractor, kind, ext_pos`. Extractors arrive one after the other; each of them
is matched one-to-one against the groups there are so far.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.functions import text as X
from turnloom.operators.matching import match_by_class
from turnloom.operators.ordering import first_wins
from turnloom.session import cut

SAME_ITEM_OVERLAP = 0.5
SAME_EVIDENCE_OVERLAP = 0.8
_BLOCK = 64


def content_key() -> Column:
    key = (
        F.when(F.col("type") == "code_artifact", X.strip(X.collapse(F.col("content"))))
        .when(F.col("type") == "reference", F.lower(F.regexp_replace("uri", "/+$", "")))
        .otherwise(X.dedupe_form(F.col("content")))
    )
    return F.md5(key)


def as_candidates(items: DataFrame, extractor: str, kind: str, ext_pos: int) -> DataFrame:
    """Items of one extractor as candidates. Rule items carry their own span as evidence."""
    own = F.array(F.struct(F.col("turn_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))
    ordered = (
        ("mpos", F.lit(0), F.lit(0)) if "mpos" in items.columns else ("idx", F.col("rank"), F.col("seq"))
    )
    return items.select(
        "item_id",
        "doc_id",
        "conv_id",
        "conv_pos",
        F.col(ordered[0]).cast("int").alias("o1"),
        ordered[1].cast("int").alias("o2"),
        ordered[2].cast("int").alias("o3"),
        "idx",
        "turn_id",
        "role",
        "type",
        "content",
        "start",
        "end",
        "strength",
        "status",
        "language",
        "filename",
        "uri",
        "title",
        "confidence",
        "method",
        "agent",
        "origin",
        "assertion",
        (F.col("evidence") if "evidence" in items.columns else own).alias("evidence"),
        F.lit(extractor).alias("extractor"),
        F.lit(kind).alias("kind"),
        F.lit(ext_pos).alias("ext_pos"),
    )


def _order() -> Column:
    return F.struct("ext_pos", "conv_pos", "o1", "o2", "o3", "item_id")


def _spans(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode("evidence").alias("e")).filter("e.start is not null").select(
        *keep, F.col("e.turn_id").alias("span_turn"), F.col("e.start").alias("s"), F.col("e.end").alias("t")
    )


def _overlap(left: str, right: str) -> Column:
    inter = F.least(f"{left}.t", f"{right}.t") - F.greatest(f"{left}.s", f"{right}.s")
    shorter = F.least(F.col(f"{left}.t") - F.col(f"{left}.s"), F.col(f"{right}.t") - F.col(f"{right}.s"))
    return F.when(inter > 0, inter / shorter).otherwise(F.lit(0.0))


def overlap_pairs(members: DataFrame, arriving: DataFrame) -> DataFrame:
    """(group, item) whose evidence shares at least half of the shorter span in one turn."""
    a = _spans(members, "doc_id", "type", "origin", "group_id", "g_order").alias("a")
    b = _spans(arriving, "doc_id", "type", "origin", "item_id", "b_order").alias("b")
    same = (
        (F.col("a.doc_id") == F.col("b.doc_id"))
        & (F.col("a.type") == F.col("b.type"))
        & (F.col("a.origin") == F.col("b.origin"))
        & (F.col("a.span_turn") == F.col("b.span_turn"))
    )
    return a.join(b, same).filter(_overlap("a", "b") >= SAME_ITEM_OVERLAP).select(
        F.col("a.group_id").alias("a"), F.col("a.g_order").alias("a_order"), F.col("b.item_id").alias("b"), F.col("b.b_order").alias("b_order")
    ).distinct()


CLASS = ["doc_id", "type", "origin", "key"]


def group_candidates(extractors: list[DataFrame]) -> DataFrame:
    """All candidates with `group_id` and `g_order` (the order of the group's first member)."""
    def founded(rows):
        return rows.withColumn("group_id", F.col("item_id")).withColumn("g_order", F.col("b_order"))

    # every candidate is read several times below: extraction runs once
    ready = [cut(e.withColumn("key", content_key()).withColumn("b_order", _order())) for e in extractors]
    members = founded(ready[0])
    for arriving in ready[1:]:
        overlaps = overlap_pairs(members, arriving)
        # a group holds a content key per member: it is in the class of each
        groups = members.select(*CLASS, F.col("group_id").alias("a"), F.col("g_order").alias("a_order"))
        groups = groups.withColumn("a_block", F.struct("a_order.ext_pos", F.floor(F.col("a_order.conv_pos") / F.lit(_BLOCK)).alias("c")))
        coming = arriving.select(*CLASS, F.col("item_id").alias("b"), "b_order", F.floor(F.col("conv_pos") / F.lit(_BLOCK)).alias("b_block"))
        matched = match_by_class(groups, coming, overlaps, CLASS)
        orders = members.select(F.col("group_id").alias("a"), "g_order").distinct()
        joined = (
            arriving.join(matched.withColumnRenamed("b", "item_id"), "item_id", "left")
            .join(orders, "a", "left")
            .withColumn("group_id", F.coalesce("a", "item_id"))
            .withColumn("g_order", F.coalesce("g_order", "b_order"))
            .drop("a")
        )
        members = cut(members.unionByName(joined))
    return members


def prefer_order() -> list[Column]:
    """Canonical member first: literal copies from rules, then confidence, then the model, then arrival."""
    literal = F.col("type").isin("code_artifact", "reference")
    return [
        F.when(literal & (F.col("kind") == "deterministic"), F.lit(0)).when(literal, F.lit(1)).otherwise(F.lit(0)),
        F.col("confidence").desc(),
        F.when(F.col("kind") == "semantic", F.lit(0)).otherwise(F.lit(1)),
        F.col("b_order"),
    ]


_SEP = "/"


def _within(doc: str, c: str) -> Column:
    """An id made unique over documents: the same chat may be saved in several."""
    return F.concat(F.col(doc), F.lit(_SEP), F.col(c)).alias(c)


def _bare(doc: str, c: str) -> Column:
    return F.substr(F.col(c), F.char_length(doc) + 2).alias(c)


def _rename(df: DataFrame, change, *names: str) -> DataFrame:
    return df.select(*[change("doc_id", c) if c in names else F.col(c) for c in df.columns])


def reconcile(extractors: list[DataFrame], relations: DataFrame | None = None) -> dict[str, DataFrame]:
    """items, merged members, evidence, relations and the report of a reconciliation, each document on its own."""
    wide = [_rename(e, _within, "item_id") for e in extractors]
    out = _reconciled(wide, _rename(relations, _within, "from", "to") if relations is not None else None)
    ids = {"items": ("item_id", "group_id"), "merged": ("canonical_id",), "relations": ("from", "to"), "members": ("item_id", "group_id")}
    return {name: _rename(df, _bare, *ids.get(name, ())) for name, df in out.items()}


def _reconciled(extractors: list[DataFrame], relations: DataFrame | None) -> dict[str, DataFrame]:
    members = group_candidates(extractors)
    # a group holds at most one member per extractor, so its lists are short
    canon = first_wins(members, ["group_id"], prefer_order())
    rest = members.join(canon.select("item_id"), "item_id", "left_anti")
    canon_of = members.select("item_id", "group_id").join(
        canon.select("group_id", F.col("item_id").alias("canonical_id")), "group_id"
    ).select("item_id", "canonical_id")
    merged = rest.join(canon_of, "item_id").select(
        "doc_id", "canonical_id", "b_order", "extractor", "type", "content", "confidence", "assertion", "evidence"
    )
    folded = merged.groupBy("canonical_id").agg(
        F.count(F.lit(1)).alias("merged"),
        F.max("confidence").alias("other_confidence"),
        F.array_sort(F.collect_list(F.struct("b_order", "assertion", "evidence", "extractor"))).alias("others"),
    )
    joined = canon.join(folded.withColumnRenamed("canonical_id", "item_id"), "item_id", "left")
    known = F.get(F.filter(F.transform("others", lambda o: o["assertion"]), lambda a: a != "unknown"), F.lit(0))
    items = joined.select(
        *[c for c in canon.columns if c not in ("confidence", "assertion", "evidence", "key", "b_order")],
        F.greatest("confidence", "other_confidence").alias("confidence"),
        F.when(F.col("assertion") == "unknown", F.coalesce(known, F.lit("unknown"))).otherwise(F.col("assertion")).alias("assertion"),
        F.array_distinct(
            F.when(F.col("others").isNull(), F.col("evidence")).otherwise(
                F.concat(F.col("evidence"), F.flatten(F.transform("others", lambda o: o["evidence"])))
            )
        ).alias("evidence"),
        F.array_distinct(
            F.when(F.col("others").isNull(), F.array("extractor")).otherwise(
                F.concat(F.array("extractor"), F.transform("others", lambda o: o["extractor"]))
            )
        ).alias("extractors"),
        F.coalesce("merged", F.lit(0)).cast("bigint").alias("merged"),
    )
    edges = same_evidence(items)
    if relations is not None:
        edges = repoint(relations, canon_of).unionByName(edges)
    return {"items": items, "merged": merged, "relations": edges, "members": members, "report": report(members, items)}


def repoint(relations: DataFrame, canon_of: DataFrame) -> DataFrame:
    """Relations moved to canonical items; loops and repeats go."""
    a = canon_of.select(F.col("item_id").alias("from"), F.col("canonical_id").alias("__from"))
    b = canon_of.select(F.col("item_id").alias("to"), F.col("canonical_id").alias("__to"))
    moved = relations.join(a, "from").join(b, "to").filter(F.col("__from") != F.col("__to"))
    out = moved.select("doc_id", "type", F.col("__from").alias("from"), F.col("__to").alias("to"), "source")
    return out.groupBy("doc_id", "type", "from", "to").agg(F.min("source").alias("source"))


def same_evidence(items: DataFrame) -> DataFrame:
    """Kept items of different type and extractor that cite the same text."""
    base = items.withColumn("founder", F.col("extractor"))
    a = _spans(base, "doc_id", "origin", "type", "founder", "item_id", "g_order").alias("a")
    b = _spans(base, "doc_id", "origin", "type", "founder", "item_id", "g_order").alias("b")
    cond = (
        (F.col("a.doc_id") == F.col("b.doc_id"))
        & (F.col("a.origin") == F.col("b.origin"))
        & (F.col("a.span_turn") == F.col("b.span_turn"))
        & (F.col("a.type") != F.col("b.type"))
        & (F.col("a.founder") != F.col("b.founder"))
        & (F.col("a.g_order") < F.col("b.g_order"))
    )
    return (
        a.join(b, cond)
        .filter(_overlap("a", "b") >= SAME_EVIDENCE_OVERLAP)
        .select(
            F.col("a.doc_id").alias("doc_id"),
            F.lit("same_evidence").alias("type"),
            F.col("a.item_id").alias("from"),
            F.col("b.item_id").alias("to"),
            F.lit(S.RECONCILE_AGENT).alias("source"),
        )
        .distinct()
    )


def report(members: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates by extractor beside the totals of each document."""
    by = members.groupBy("doc_id", "extractor").agg(F.count(F.lit(1)).alias("by_extractor"))
    total = items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("merged").alias("merged")
    ).withColumn("candidates", F.col("items") + F.col("merged"))
    return by.join(total, "doc_id")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union of extractor outputs by column name."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
