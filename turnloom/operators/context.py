"""Extraction end to end: rules, model, or both with fall-back per conversation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.functions import text as X

from turnloom.operators.extract import DEFAULT_EXTRACTORS, Extractor, annotate, extract_items
from turnloom.operators.items import dedupe_items
from turnloom.operators.reconcile import as_candidates, reconcile, union_all


def encode(turns: DataFrame, extractors: Sequence[Extractor] = DEFAULT_EXTRACTORS, dedupe: bool = True) -> DataFrame:
    """Turns -> attributed, de-duplicated items of each document."""
    return dedupe_items(annotate(extract_items(turns, extractors)), by_content=dedupe)


@dataclass(frozen=True)
class ContextExtractor:
    """Something that reads whole conversations: `extract(turns)` gives `items`, and may give `relations` and `failures(conv_id, code)`.

    Items need type, content, doc_id, conv_id and conv_pos; `complete` fills in the rest.
    The kind is deterministic or semantic and decides in which modes it runs.
    """

    name: str
    kind: str
    extract: Callable[[DataFrame], dict[str, DataFrame]]


_REGISTERED: dict[str, ContextExtractor] = {}


def register(extractor: ContextExtractor) -> ContextExtractor:
    """Makes an extractor known by its name; a later one of the same name replaces it."""
    if extractor.kind not in ("deterministic", "semantic"):
        raise ValueError(f"unknown kind {extractor.kind!r}")
    _REGISTERED[extractor.name] = extractor
    return extractor


def registered(*names: str) -> list[ContextExtractor]:
    return [_REGISTERED[n] for n in names or _REGISTERED]


def rule_extractor(extractors: Sequence[Extractor] = DEFAULT_EXTRACTORS, dedupe: bool = True) -> ContextExtractor:
    """The rules of `extract`; without `dedupe` a statement stays as often as it is made."""

    def extract(turns: DataFrame) -> dict[str, DataFrame]:
        return {"items": dedupe_items(annotate(extract_items(turns, extractors)), by_content=dedupe, scope=("doc_id", "conv_id"))}

    return ContextExtractor("rules", "deterministic", extract)


def model_extractor(items: DataFrame, relations: DataFrame | None = None, failures: DataFrame | None = None, name: str = "model") -> ContextExtractor:
    """Model rows that `semantic.normalize` has accepted, under the policy it was given."""
    found = {"items": items, "relations": relations, "failures": failures}
    return ContextExtractor(name, "semantic", lambda turns: {k: v for k, v in found.items() if v is not None})


_DEFAULTS = {"rank": "0", "seq": "0", "idx": "0", "confidence": "0.5", "origin": "'unknown'", "assertion": "'unknown'", "method": "'heuristic'"}


def complete(items: DataFrame, agent: str) -> DataFrame:
    """Items of an extractor of one's own with every column that candidates have."""
    kinds = {f.name: f.dataType for f in S.DRAFT.fields} | {c: "string" for c in ("turn_id", "role", "origin", "assertion", "agent")} | {"idx": "int"}
    out = items
    for name, kind in kinds.items():
        if name not in out.columns:
            out = out.withColumn(name, (F.lit(agent) if name == "agent" else F.expr(_DEFAULTS.get(name, "null"))).cast(kind))
    if "item_id" in out.columns:
        return out
    return out.withColumn("item_id", X.stable_id("itm", F.lit(agent), *[F.col(c) for c in ("conv_id", "turn_id", "type", "start", "end", "content")]))


def run_extractors(turns: DataFrame, extractors: Sequence[ContextExtractor], mode: str = "hybrid") -> dict[str, DataFrame]:
    """The results of several extractors, in their order, reconciled per document.

    The mode picks those of one kind, or all. In hybrid mode a conversation that a semantic
    extractor has failed for keeps what the others found and is flagged `fallback`; in
    semantic mode it is left out of that extractor's items and reported as an error.
    """
    if mode not in ("deterministic", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    wanted = [e for e in extractors if mode in ("hybrid", e.kind)]
    if not wanted:
        raise ValueError(f"no extractor for {mode} mode")
    parts, edges, failed = [], [], []
    for place, e in enumerate(wanted):
        found = e.extract(turns)
        items, relations = complete(found["items"], f"{e.name}@1"), found.get("relations")
        if "failures" in found:
            lost = found["failures"].select("conv_id").distinct()
            failed.append(found["failures"].select("conv_id", "code"))
            items = items.join(lost, "conv_id", "left_anti")
            relations = relations.join(lost, "conv_id", "left_anti") if relations is not None else None
        parts.append(as_candidates(items, e.name, e.kind, place))
        if relations is not None:
            edges.append(relations)
    out = reconcile(parts, union_all(edges) if edges else None)
    failures = union_all(failed) if failed else None
    flag = F.lit(False)
    if failures is not None and mode == "hybrid":
        lost = failures.select("conv_id").distinct().withColumn("__lost", F.lit(True))
        out["items"] = out["items"].join(lost, "conv_id", "left")
        flag = F.coalesce("__lost", F.lit(False))
    out["items"] = out["items"].withColumn("fallback", flag).drop("__lost")
    if failures is not None:
        level, code = ("warning", "semantic_fallback") if mode == "hybrid" else ("error", "semantic_failed")
        out["diagnostics"] = failures.select("conv_id", F.lit(level).alias("level"), F.lit(code).alias("code"), F.col("code").alias("cause"))
    return out


def extract_context(
    turns: DataFrame,
    mode: str = "deterministic",
    model_items: DataFrame | None = None,
    model_relations: DataFrame | None = None,
    failures: DataFrame | None = None,
    extractors: Sequence[Extractor] = DEFAULT_EXTRACTORS,
    dedupe: bool = True,
) -> dict[str, DataFrame]:
    """Items, relations and diagnostics of the selected turns, from the rules and one model.

    `failures(conv_id, code)` are conversations whose model call failed. Hybrid mode keeps
    their rule items with `fallback`; semantic mode leaves them out and reports them.
    """
    if mode == "deterministic":
        return {"items": encode(turns, extractors, dedupe).withColumn("fallback", F.lit(False))}
    if model_items is None:
        raise ValueError(f"{mode} mode needs model items")
    return run_extractors(turns, [rule_extractor(extractors, dedupe), model_extractor(model_items, model_relations, failures)], mode)
