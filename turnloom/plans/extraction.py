"""Queries over sources, extraction and items (S, X, W, J, A, P families)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.operators import extract as E
from turnloom.operators import items as I
from turnloom.plans import oracle as O
from turnloom.plans.seeded import CONVS, RAW, SEEDED, conversations, raw_turns, seeded_turns
from turnloom.session import cut
from turnloom.sources.turns import with_default_index


@lru_cache(maxsize=16)
def _items_of(spark, sf):
    return E.annotate(E.extract_items(seeded_turns(spark, sf)))


def items_of(spark, sf):
    """Items of the seeded view; the analysed plan is kept per session."""
    return _items_of(spark, sf)


def deduped_of(spark, sf):
    return I.dedupe_items(items_of(spark, sf))


@lru_cache(maxsize=16)
def stored_items(spark, sf):
    """The items table as the operators behind extraction read it: written once."""
    return cut(deduped_of(spark, sf))


ITEM_OUT = (
    "item_id doc_id conv_id turn_id role rank type content start_at end_at strength status language filename uri title"
    " confidence method"
).split()
_COLS = ", ".join(ITEM_OUT)


def out(df):
    return df.withColumnsRenamed({"start": "start_at", "end": "end_at"}).select(*ITEM_OUT)


def of_type(*types):
    return lambda spark, sf: out(items_of(spark, sf).filter(F.col("type").isin(*types) & (F.col("method") == "heuristic")))


def only(extractor):
    ex = [x for x in E.DEFAULT_EXTRACTORS if x.name == extractor]
    return lambda spark, sf: out(E.extract_items(seeded_turns(spark, sf), ex)).drop("rank")


_NO_RANK = ", ".join(c for c in ITEM_OUT if c != "rank")


def rule_sql(*types):
    names = ", ".join(f"'{t}'" for t in types)
    return f"with {O.ITEMS} select {_COLS} from items where type in ({names}) and method = 'heuristic'"


def s1_turns(spark, sf):
    t = raw_turns(spark, sf)
    return with_default_index(t.drop("turn_id").withColumn("pos", F.col("idx")).drop("idx"), "pos").select(
        "conv_id", "turn_id", F.col("idx").cast("bigint").alias("idx"), "role", "content"
    )


def x6_segments(spark, sf):
    return E.segment_rows(seeded_turns(spark, sf)).select(
        "turn_id", F.col("seq").cast("bigint").alias("seq"), "text", F.col("start").alias("start_at"), F.col("end").alias("end_at")
    )


def x1_fences(spark, sf):
    return E.fenced_rows(seeded_turns(spark, sf)).select(
        "turn_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "info", "body"
    )


def x3_mask(spark, sf):
    return seeded_turns(spark, sf).select("turn_id", E.mask_fences(F.col("content")).alias("prose"))


def x15_annotated(spark, sf):
    return items_of(spark, sf).select("item_id", "origin", "assertion")


def x16_encode(spark, sf):
    d = deduped_of(spark, sf)
    return d.groupBy("doc_id", "type", "method").agg(F.count(F.lit(1)).alias("n"))


def w1_dedupe(spark, sf):
    return out(deduped_of(spark, sf))


def w2_unique_ids(spark, sf):
    return I.dedupe_items(items_of(spark, sf), by_content=False).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def w5_last(spark, sf):
    return I.last_messages(seeded_turns(spark, sf), 2).select("conv_id", "turn_id", "role")


def w5_last_user(spark, sf):
    return I.last_user_message(seeded_turns(spark, sf)).select("conv_id", "turn_id", "content")


def j1_provenance(spark, sf):
    t = seeded_turns(spark, sf)
    r = I.resolve_provenance(items_of(spark, sf), conversations(t), t)
    return r.select(
        "item_id", "conv_title", "conv_url", "platform", "turn_index", "turn_role", "excerpt", I.describe_provenance().alias("description")
    )


_J1 = f"""with {O.ITEMS},{CONVS} select i.item_id, c.title as conv_title, c.url as conv_url, c.platform, t.idx as turn_index,
  t.role as turn_role, substr(t.content, i.start_at + 1, i.end_at - i.start_at) as excerpt,
  c.platform || ' · "' || c.title || '" · turn ' || t.idx || ' (' || t.role || ') · ' || i.method as description
  from items i left join convs c using (conv_id) left join seeded t on i.turn_id = t.turn_id"""


def j2_explain(spark, sf):
    t = seeded_turns(spark, sf)
    items = items_of(spark, sf)
    wanted = items.groupBy("doc_id").agg(F.min("item_id").alias("item_id"))
    return I.explain_item(items, conversations(t), t, wanted).select("item_id", "conv_title", "turn_index", "excerpt")


def j3_numbers(spark, sf):
    return I.message_numbers(items_of(spark, sf), seeded_turns(spark, sf)).select("item_id", "message_number")


def p6_origin(spark, sf):
    items = items_of(spark, sf)
    notes = items.filter(F.col("type") == "reference").select("item_id", F.lit("tool").alias("origin"))
    return I.with_origin(items, notes.dropDuplicates(["item_id"]), seeded_turns(spark, sf)).select("item_id", "origin")


def j9_annotations(spark, sf):
    items = items_of(spark, sf)
    notes = items.filter(F.col("method") == "heuristic").select("item_id", F.col("assertion").alias("said")).distinct()
    return I.with_annotations(items.select("item_id", "type"), notes)


FILTER = dict(types=("constraint", "decision", "code_artifact"), min_confidence=0.55, origins=("user", "system", "assistant"))
_FILTER_SQL = "type in ('constraint','decision','code_artifact') and confidence >= 0.55 and role in ('user','system','assistant')"


def p5_filter(spark, sf):
    return out(I.decode_filter(stored_items(spark, sf), **FILTER))


def a4_sections(spark, sf):
    d = stored_items(spark, sf)
    return I.sections(I.decode_filter(d, **FILTER), d)


def a3_methods(spark, sf):
    return I.methods(I.decode_filter(stored_items(spark, sf), **FILTER))


def a1_summary(spark, sf):
    t = seeded_turns(spark, sf)
    docs = t.select("doc_id").distinct()
    s = I.summarize(docs, conversations(t), stored_items(spark, sf))
    counts = F.array_join(
        F.transform(F.array_sort(F.map_entries("item_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )
    return s.select("doc_id", "conversation_count", "sources", "item_count", counts.alias("item_counts"))


def a2_counts(spark, sf):
    return I.type_counts(stored_items(spark, sf))


def w10_superseded(spark, sf):
    d = stored_items(spark, sf)
    old = d.filter(F.col("type") == "preference").select(F.lit("supersedes").alias("type"), F.col("item_id").alias("to"))
    return I.superseded(d, old).groupBy("type", "is_superseded").agg(F.count(F.lit(1)).alias("n"))


_SECTION = "list_position([" + ", ".join(f"'{t}'" for t in S.SECTION_ORDER) + "], type)"
_LABEL = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in S.SECTION_LABELS.items()) + " end"

QUERIES = {
    "s1_turns": (s1_turns, f"with {RAW} select conv_id, turn_id, idx::bigint as idx, role, content from raw_turns"),
    "x1_fenced_blocks": (
        x1_fences,
        f"with {SEEDED} select turn_id, strpos(content, w) - 1 as start_at, strpos(content, w) - 1 + length(w) as end_at, "
        "trim(regexp_extract(content, '```([^\\n`]*)\\n', 1)) as info, "
        "regexp_replace(regexp_extract(content, '(?s)```([^\\n`]*)\\n(.*?)```', 2), '\\n$', '') as body "
        "from (select *, regexp_extract(content, '(?s)```([^\\n`]*)\\n(.*?)```', 0) as w from seeded) where w <> ''",
    ),
    "x3_range_mask": (x3_mask, f"with {SEEDED},{O.MASKED} select turn_id, prose from masked"),
    "x4_code_items": (only("code"), f"with {SEEDED},{O.CODES}, coded as (select *, {O.stable_id('itm', 'turn_id', 'type', 'start_at', 'end_at', 'content')} as item_id from codes) select {_NO_RANK} from coded"),
    "x5_reference_items": (only("references"), f"with {O.ITEMS} select {_NO_RANK} from items where type = 'reference'"),
    "x6_segments": (x6_segments, f"with {SEEDED},{O.MASKED},{O.SEGMENTS} select turn_id, seq, text, start_at, end_at from segs"),
    "x7_questions": (of_type("question"), rule_sql("question")),
    "x8_constraints": (of_type("constraint"), rule_sql("constraint")),
    "x9_preferences": (of_type("preference"), rule_sql("preference")),
    "x10_decisions": (of_type("decision"), rule_sql("decision")),
    "x11_tasks": (of_type("task"), rule_sql("task")),
    "x12_facts": (of_type("fact"), rule_sql("fact")),
    "x13_statements": (only("statements"), f"with {O.ITEMS} select {_NO_RANK} from items where method = 'heuristic'"),
    "x14_items": (lambda spark, sf: out(items_of(spark, sf)), f"with {O.ITEMS} select {_COLS} from items"),
    "x15_annotations": (
        x15_annotated,
        f"with {O.ITEMS} select item_id, role as origin, case when method = 'deterministic' then 'explicit' "
        "when type = 'decision' and status = 'proposed' then 'suggested' else 'unknown' end as assertion from items",
    ),
    "x16_encode": (x16_encode, f"with {O.DEDUPED} select doc_id, type, method, count(*) as n from deduped group by all"),
    "w1_dedupe": (w1_dedupe, f"with {O.DEDUPED} select {_COLS} from deduped"),
    "w2_unique_ids": (w2_unique_ids, f"with {O.ITEMS} select doc_id, count(distinct item_id) as n from items group by doc_id"),
    "w5_last_messages": (
        w5_last,
        f"with {SEEDED} select conv_id, turn_id, role from seeded qualify row_number() over (partition by conv_id order by idx desc) <= 2",
    ),
    "w5_last_user_message": (
        w5_last_user,
        f"with {SEEDED} select conv_id, turn_id, content from seeded where role = 'user' "
        "qualify row_number() over (partition by conv_id order by idx desc) = 1",
    ),
    "w10_superseded": (
        w10_superseded,
        f"with {O.DEDUPED} select type, type = 'preference' as is_superseded, count(*) as n from deduped group by all",
    ),
    "j1_provenance": (j1_provenance, _J1),
    "j2_explain": (
        j2_explain,
        f"with {O.ITEMS},{CONVS} select i.item_id, c.title as conv_title, t.idx as turn_index, "
        "substr(t.content, i.start_at + 1, i.end_at - i.start_at) as excerpt from items i join convs c using (conv_id) "
        "join seeded t on i.turn_id = t.turn_id where i.item_id in (select min(item_id) from items group by doc_id)",
    ),
    "j3_message_numbers": (j3_numbers, f"with {O.ITEMS} select item_id, idx + 1 as message_number from items"),
    "j9_annotation_join": (
        j9_annotations,
        f"with {O.ITEMS} select item_id, type, case when method = 'heuristic' then case when type = 'decision' and status = 'proposed' "
        "then 'suggested' else 'unknown' end end as said from items",
    ),
    "p5_decode_filter": (p5_filter, f"with {O.DEDUPED} select {_COLS} from deduped where {_FILTER_SQL}"),
    "p6_origin": (
        p6_origin,
        f"with {O.ITEMS} select item_id, case when type = 'reference' then 'tool' else role end as origin from items",
    ),
    "a1_summary": (
        a1_summary,
        f"""with {O.DEDUPED},{CONVS},
per as (select doc_id, type, count(*) as n from deduped group by all)
select d.doc_id, (select count(*) from convs c where c.doc_id = d.doc_id) as conversation_count,
  (select string_agg(s, ',' order by s) from (select distinct kind || '/' || platform as s from convs c where c.doc_id = d.doc_id)) as sources,
  coalesce((select sum(n) from per where per.doc_id = d.doc_id), 0)::bigint as item_count,
  (select string_agg(type || '=' || n, ',' order by type) from per where per.doc_id = d.doc_id) as item_counts
from (select distinct doc_id from seeded) d""",
    ),
    "a2_type_origin_counts": (a2_counts, f"with {O.DEDUPED} select doc_id, type, role as origin, count(*) as items from deduped group by all"),
    "a3_methods": (a3_methods, f"with {O.DEDUPED} select distinct doc_id, method from deduped where {_FILTER_SQL}"),
    "a4_sections": (
        a4_sections,
        f"""with {O.DEDUPED}, sel as (select doc_id, type, count(*) as items from deduped where {_FILTER_SQL} group by all)
select doc_id, {_SECTION} as section, type, {_LABEL} as label, items, sum(items) over (partition by doc_id)::bigint as total_items,
  (select count(*) from deduped d where d.doc_id = sel.doc_id) as available_items from sel""",
    ),
}
