"""Queries over model output, reconciliation, validation and evaluation (H, J, U, V, A, X17, D families)."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.operators import archive as AR
from turnloom.operators import evaluate as EV
from turnloom.operators import reconcile as REC
from turnloom.operators import semantic as SEM
from turnloom.operators import validate as V
from turnloom.operators.context import ContextExtractor, extract_context, register, registered, rule_extractor, run_extractors
from turnloom.operators.documents import assemble
from turnloom.operators.ordering import number_rows
from turnloom.operators.selection import size_gate
from turnloom.plans import oracle as O
from turnloom.plans.extraction import stored_items, items_of
from turnloom.plans.seeded import CAPTURED, PHRASES, SEEDED, conversations, seeded_turns
from turnloom.session import checkpoint_dir, cut

# What the scripted model says about a turn with phrase k. Fields:
# ref suffix, type, content, claimed origin, assertion, confidence, strength, status, quote (null: the phrase itself)
SCRIPT = {
    0: ("q", "question", "Should we store seedlings in Porto?", "user", "explicit", 0.9, None, "open", None),
    1: ("c", "constraint", "The jar must be labelled", "user", "explicit", 0.95, "must", None, "jar MUST be  labelled"),
    2: ("c", "constraint", "No vinegar", "user", "inferred", 0.9, "must_not", None, "Do not use vinegar."),
    3: ("c", "constraint", "Never stack crates", "user", "explicit", 0.5, None, None, "We should not stack crates."),
    4: ("c", "constraint", "The oven should rest.", "assistant", "explicit", 0.3, "should", None, "The oven should rest."),
    6: ("p", "preference", "Prefers rye flour", "user", "explicit", 0.9, None, None, "“I prefer rye flour.”"),
    7: ("d", "decision", "Use sourdough", "user", "explicit", 0.9, None, "accepted", "decided to use sourdough"),
    8: ("t", "task", "Design a tasting menu", "user", "explicit", 0.8, None, "answered", "design a tasting menu"),
    9: ("t", "task", "Order salt", "user", "explicit", 0.8, None, "done", "not in the text"),
    10: ("f", "decision", "Plans a harvest feast", "user", "quoted", 0.7, None, None, "We're planning a harvest feast."),
    11: ("f", "fact", "Our stack is written in pencil.", "unknown", "explicit", 0.5, None, None, None),
    12: ("r", "reference", "https://b.example/x", "user", "explicit", 0.99, None, None, "https://b.example/x"),
    13: ("k", "code_artifact", "export const r = 1;", "assistant", "explicit", 0.99, None, None, "export const r = 1;"),
}
_FIELDS = ("suffix", "type", "content", "origin", "assertion", "confidence", "strength", "status", "quote")


def script_rows(spark, sf):
    """Model items made from the conversations by arithmetic: one per turn with a scripted phrase,
    referring to its own message, or (idx % 5 == 4) to one that does not exist, or (idx % 7 == 6) to none."""
    t = seeded_turns(spark, sf)
    k = ((F.col("conv_pos") * 7 + F.col("idx")) % 16).cast("int")
    table = F.create_map(
        *[
            x
            for i, row in SCRIPT.items()
            for x in (
                F.lit(i),
                F.struct(*[F.lit(v if v is not None or n != "quote" else PHRASES[i]).cast("double" if n == "confidence" else "string").alias(n) for n, v in zip(_FIELDS, row)]),
            )
        ]
    )
    rows = t.withColumn("s", F.try_element_at(table, k)).filter("s is not null")
    message = F.concat(F.lit("m"), F.when(F.col("idx") % 5 == 4, F.lit("99")).otherwise(F.col("idx").cast("string")))
    evidence = F.when(
        F.col("idx") % 7 == 6, F.array().cast("array<struct<message:string,quote:string>>")
    ).otherwise(F.array(F.struct(message.alias("message"), F.col("s.quote").alias("quote"))))
    # refs repeat within a conversation: an accepted one blocks its later copies
    ref = F.concat(F.col("s.suffix"), F.floor(F.col("idx") / 2).cast("string"))
    none = F.lit(None).cast("string")
    return rows.select(
        "conv_id", F.col("idx").alias("mpos"), ref.alias("ref"), F.col("s.type").alias("type"), F.col("s.content").alias("content"),
        F.col("s.origin").alias("origin"), F.col("s.assertion").alias("assertion"), F.col("s.confidence").alias("confidence"),
        F.col("s.strength").alias("strength"), F.col("s.status").alias("status"), F.lit("TS").alias("language"), none.alias("filename"),
        none.alias("uri"), F.lit("A title").alias("title"), evidence.alias("evidence"),
    )


def script_relations(spark, sf):
    """Each model item supersedes the one before it in its conversation."""
    rows = script_rows(spark, sf).select("conv_id", "mpos", "ref")
    placed = cut(number_rows(rows, ["conv_id"], F.floor(F.col("mpos") / F.lit(1024)), ["mpos", "ref"], "rpos"))  # met with itself
    before = placed.select("conv_id", (F.col("rpos") + 1).alias("rpos"), F.col("ref").alias("to"))
    return placed.join(before, ["conv_id", "rpos"]).select("conv_id", "rpos", F.lit("supersedes").alias("type"), F.col("ref").alias("from"), "to")


def end_relations(spark, sf):
    """The last model item of a conversation supersedes its first one."""
    rows = script_rows(spark, sf).select("conv_id", "mpos", "ref")
    prev = rows.groupBy("conv_id").agg(F.min(F.struct("mpos", "ref")).alias("a"), F.max(F.struct("mpos", "ref")).alias("b"))
    return prev.select("conv_id", F.lit(0).alias("rpos"), F.lit("supersedes").alias("type"), F.col("b.ref").alias("from"), F.col("a.ref").alias("to"))


@lru_cache(maxsize=16)
def normalised(spark, sf, policy="strict", relate=end_relations):
    items, relations, notes = SEM.normalize(script_rows(spark, sf), relate(spark, sf), seeded_turns(spark, sf), policy=policy)
    return cut(items), relations, notes


def _val(v):
    return "null" if v is None else (str(v) if isinstance(v, float) else O.lit(v))


_SCRIPT_SQL = "script(k, " + ", ".join(_FIELDS) + ") as (values " + ", ".join(
    f"({i}, " + ", ".join(_val(v if v is not None or n != "quote" else PHRASES[i]) for n, v in zip(_FIELDS, row)) + ")" for i, row in SCRIPT.items()
) + ")"

# Where the scripted quote starts in the content: quotes differ from it by case, spaces and quotation marks only.
_CLEAN = "replace(replace(lower(regexp_replace(quote, ' +', ' ', 'g')), '“', ''), '”', '')"
NORMAL = f"""{_SCRIPT_SQL},
said as (select s.doc_id, s.conv_id, s.conv_pos, s.idx, s.turn_id, s.role, s.content as turn_text, k.suffix || (s.idx // 2) as ref, k.type as m_type,
    k.content as m_content, k.origin as m_origin, k.assertion as m_assertion, k.confidence::double as m_conf, k.strength, k.status as m_status,
    case when s.idx % 7 = 6 then 'none' when s.idx % 5 = 4 then 'outside' else 'cited' end as cite,
    strpos(lower(s.content), {_CLEAN}) as q_at, length({_CLEAN}) as size
  from seeded s join script k on k.k = ((s.conv_pos * 7 + s.idx) % 16)),
supported as (select *, case when cite = 'none' then 'missing_evidence' when cite = 'outside' or q_at = 0 then 'unsupported_item' end as why from said),
said_ruled as (select *,
    case when role = 'assistant' and m_type in ('constraint','preference') then 'decision' else m_type end as type,
    case when role = 'assistant' and m_type in ('constraint','preference') then 'proposed'
         when role = 'assistant' and m_type = 'decision' and coalesce(m_status,'') not in ('proposed','rejected') then 'proposed' else m_status end as status,
    case when role = 'assistant' and m_type in ('constraint','preference') then 'suggested'
         when role = 'assistant' and m_type = 'decision' and coalesce(m_status,'') not in ('proposed','rejected')
           then case when m_assertion = 'quoted' then 'quoted' else 'suggested' end else m_assertion end as assertion,
    role = 'assistant' and (m_type in ('constraint','preference') or (m_type = 'decision' and coalesce(m_status,'') not in ('proposed','rejected'))) as by_rule
  from supported),
judged as (select *, coalesce(why, case when type = 'constraint' and strength is null then 'missing_field' end) as verdict from said_ruled),
firsts as (select conv_id, ref, min(idx) filter (where verdict is null) as first_ok from judged group by all),
fresh as (select j.*, coalesce(j.idx > f.first_ok, false) as is_copy from judged j join firsts f using (conv_id, ref)),
accepted as (select doc_id, conv_id, conv_pos, idx as mpos, ref, idx, turn_id, role, type, m_content as content, q_at - 1 as start_at, q_at - 1 + size as end_at,
    case when type = 'constraint' then strength end as strength,
    case when type = 'decision' then case when status in ('proposed','accepted','rejected','superseded') then status end
         when type = 'task' then case when status in ('open','in_progress','done','cancelled') then status else 'open' end
         when type = 'question' then case when status in ('open','answered') then status end end as status,
    case when type = 'code_artifact' then 'ts' end as language, case when type = 'reference' then m_content end as uri,
    case when type = 'reference' then 'A title' end as title, least(m_conf, case when assertion = 'inferred' then 0.8 else 1 end)::double as confidence,
    role as origin, assertion, {O.stable_id('itm', O.lit(S.MODEL_AGENT), 'turn_id', 'type', 'q_at - 1', 'q_at - 1 + size', 'm_content')} as item_id
  from fresh where verdict is null and not is_copy)"""
_NORMAL = f"with {SEEDED},{NORMAL} "
_MODEL_COLS = "item_id, conv_id, turn_id, mpos, type, content, start_at, end_at, strength, status, language, uri, title, confidence, origin, assertion"


def h9_items(spark, sf):
    items, _, _ = normalised(spark, sf)
    return items.withColumnsRenamed({"start": "start_at", "end": "end_at"}).select(*[c.strip() for c in _MODEL_COLS.split(",")])


def h9_diagnostics(spark, sf):
    return normalised(spark, sf)[2].select("conv_id", "ref", "level", "code", "n")


_ENDS = "rels as (select conv_id, arg_min(ref, idx) as a, arg_max(ref, idx) as b from said group by conv_id)"
_CHAIN = "rels as (select conv_id, lag(ref) over (partition by conv_id order by idx, ref) as a, ref as b from said qualify a is not null)"
_DIAG = f"""{_ENDS},
ids as (select conv_id, ref, item_id from accepted),
ends as (select r.*, x.item_id as from_id, y.item_id as to_id from rels r left join ids x on x.conv_id = r.conv_id and x.ref = r.b
  left join ids y on y.conv_id = r.conv_id and y.ref = r.a),
diag as (
  select conv_id, ref, 'warning' as level, 'duplicate_ref' as code, 1 as n from fresh where is_copy
  union all select conv_id, ref, 'warning', 'unknown_message_ref', 1 from fresh where not is_copy and cite = 'outside'
  union all select conv_id, ref, 'warning', verdict, 1 from fresh where not is_copy and verdict is not null
  union all select conv_id, ref, 'info', 'origin_corrected', 1 from fresh where not is_copy and why is null and m_origin <> role
  union all select conv_id, ref, 'info', 'attribution_rule', 1 from fresh where not is_copy and why is null and by_rule
  union all select conv_id, b || '→' || a, 'info', 'relation_dropped', 1 from ends where from_id is null or to_id is null or from_id = to_id)"""


def j5_relations(spark, sf):
    return normalised(spark, sf)[1].select("conv_id", "type", "from", "to")


def a13_summary(spark, sf):
    items, _, diags = normalised(spark, sf)
    return SEM.extraction_summary(script_rows(spark, sf), items, diags)


def j4_evidence(spark, sf):
    e = SEM.resolve_evidence(script_rows(spark, sf), seeded_turns(spark, sf))
    return e.select("conv_id", "mpos", "turn_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def h4_rules(spark, sf):
    """All type / origin / status / assertion combinations the conversations give rise to."""
    t = seeded_turns(spark, sf)
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), ((F.col("conv_pos") * n + F.col("idx")) % len(values)).cast("int"))
    base = t.select(
        "turn_id", pick(S.ITEM_TYPES, 3).alias("type"), pick(S.ORIGINS, 7).alias("origin"), pick((None, *S.DECISION_STATUS), 11).alias("status"),
        pick(S.ASSERTIONS, 13).alias("assertion"),
    )
    r = SEM.attribution(F.col("type"), F.col("origin"), F.col("status"), F.col("assertion"))
    return base.select("turn_id", r.alias("r")).select("turn_id", "r.type", "r.status", "r.assertion", "r.rule")


def _pick(values, n):
    return "[" + ", ".join(_val(v) for v in values) + f"][((conv_pos * {n} + idx) % {len(values)})::int + 1]"


_H4 = f"""with {SEEDED}, b as (select turn_id, {_pick(S.ITEM_TYPES, 3)} as t, {_pick(S.ORIGINS, 7)} as o, {_pick((None, *S.DECISION_STATUS), 11)} as s,
  {_pick(S.ASSERTIONS, 13)} as a from seeded),
r as (select *, case when o = 'assistant' and t in ('constraint','preference') then 'assistant_cannot_require'
  when o = 'tool' and t in ('constraint','preference','decision','task') then 'tool_output_is_a_fact'
  when o = 'assistant' and t = 'decision' and (s is null or s not in ('proposed','rejected')) then 'assistant_proposes'
  when t = 'decision' and s = 'accepted' and o not in ('user','system') then 'only_user_accepts' end as rule from b)
select turn_id, rule, case rule when 'assistant_cannot_require' then 'decision' when 'tool_output_is_a_fact' then 'fact' else t end as type,
  case rule when 'tool_output_is_a_fact' then null when 'assistant_cannot_require' then 'proposed' when 'assistant_proposes' then 'proposed'
    when 'only_user_accepts' then 'proposed' else s end as status,
  case rule when 'assistant_cannot_require' then 'suggested' when 'tool_output_is_a_fact' then 'quoted'
    when 'assistant_proposes' then case when a = 'quoted' then 'quoted' else 'suggested' end else a end as assertion from r"""


def h10_prompts(spark, sf):
    return SEM.prompt_rows(size_gate(seeded_turns(spark, sf))[0]).select("conv_id", F.md5("prompt").alias("h"), F.length("prompt").cast("bigint").alias("n"))


def h10_gate(spark, sf, most=1500):
    """Prompts under a size limit, and beside them what is refused and why."""
    fits, refused = size_gate(seeded_turns(spark, sf), most)
    kept = SEM.prompt_rows(fits).select("conv_id", F.lit(None).cast("string").alias("code"), F.md5("prompt").alias("h"))
    return kept.unionByName(refused.select("conv_id", "code", F.lit(None).cast("string").alias("h")))


# -- reconciliation ---------------------------------------------------------------


@lru_cache(maxsize=16)
def reconciled(spark, sf, relate=end_relations):
    """Rules (de-duplicated per conversation) and the scripted model, reconciled per document."""
    from turnloom.operators.items import dedupe_items

    rules = dedupe_items(items_of(spark, sf), scope=("doc_id", "conv_id"))
    model, relations, _ = normalised(spark, sf, relate=relate)
    return REC.reconcile(
        [REC.as_candidates(rules, "rules", "deterministic", 0), REC.as_candidates(model, "model", "semantic", 1)], relations
    )


RECON = f"""keyed2 as (select *, case when type = 'code_artifact' then 'code|' || language || '|' || {O.trim('content')}
    when type = 'reference' then 'ref|' || uri else type || '|' || {O.norm('content')} end as dk from items),
rules as (select * exclude (dk) from keyed2 qualify row_number() over (partition by doc_id, conv_id, dk order by conv_pos, idx, rank, seq) = 1),
cand as (
  select 0 as ext, doc_id, conv_pos, idx as o1, rank as o2, seq as o3, item_id, type, content, uri, role as origin, turn_id, start_at as s, end_at as t, confidence,
    case when method = 'deterministic' then 'explicit' when type = 'decision' and status = 'proposed' then 'suggested' else 'unknown' end as assertion from rules
  union all select 1, doc_id, conv_pos, mpos, 0, 0, item_id, type, content, uri, origin, turn_id, start_at, end_at, confidence, assertion from accepted),
placed_c as (select *, row_number() over (order by ext, conv_pos, o1, o2, o3, item_id) as pos,
    case when type = 'code_artifact' then {O.trim("regexp_replace(content, '\\s+', ' ', 'g')")} when type = 'reference' then lower(regexp_replace(uri, '/+$', ''))
      else {O.norm('content')} end as ck from cand),
pairs as (select b.doc_id, b.pos as b, a.pos as a from placed_c a join placed_c b on a.ext = 0 and b.ext = 1 and a.doc_id = b.doc_id and a.type = b.type and a.origin = b.origin
    and (a.ck = b.ck or (a.turn_id = b.turn_id and least(a.t, b.t) - greatest(a.s, b.s) > 0
      and (least(a.t, b.t) - greatest(a.s, b.s))::double / least(a.t - a.s, b.t - b.s) >= 0.5))),
bs as (select doc_id, b, row_number() over (partition by doc_id order by b) as n from (select distinct doc_id, b from pairs)),
walk(doc_id, n, b, a, used) as (
  select doc_id, 0::bigint, null::bigint, null::bigint, []::bigint[] from (select distinct doc_id from pairs)
  union all
  select doc_id, n, b, a, case when a is null then used else list_append(used, a) end from (
    select w.doc_id, bs.n, bs.b, (select min(p.a) from pairs p where p.b = bs.b and not list_contains(w.used, p.a)) as a, w.used
    from walk w join bs on bs.doc_id = w.doc_id and bs.n = w.n + 1)),
merges as (select a, b from walk where a is not null),
grouped as (select c.*, coalesce(m.a, c.pos) as grp from placed_c c left join merges m on m.b = c.pos),
canon as (select * from grouped qualify row_number() over (partition by grp order by
    case when type in ('code_artifact','reference') and ext = 1 then 1 else 0 end, confidence desc, ext desc, pos) = 1),
canon_map as (select g.item_id, c.item_id as canonical_id from grouped g join canon c using (grp))"""
_RECON = f"with recursive {O.ITEMS},{NORMAL},{RECON}"


def h1_items(spark, sf):
    r = reconciled(spark, sf)["items"]
    return r.select("item_id", "doc_id", "type", "content", "confidence", "assertion", "merged", F.size("evidence").cast("bigint").alias("evidence"),
                    F.array_join("extractors", ",").alias("extractors"))


_H1 = _RECON + """
select c.item_id, c.doc_id, c.type, c.content, greatest(c.confidence, coalesce(o.confidence, 0)) as confidence,
  case when c.assertion = 'unknown' then coalesce(o.assertion, 'unknown') else c.assertion end as assertion, (o.pos is not null)::bigint as merged,
  case when o.pos is null or (o.turn_id = c.turn_id and o.s = c.s and o.t = c.t) then 1 else 2 end as evidence,
  case when o.pos is null then case c.ext when 0 then 'rules' else 'model' end when c.ext = 0 then 'rules,model' else 'model,rules' end as extractors
from canon c left join grouped o on o.grp = c.grp and o.pos <> c.pos"""


def u2_evidence(spark, sf):
    """Evidence and extractors of merged items after the union, one row per piece of evidence."""
    items = reconciled(spark, sf)["items"].filter("merged > 0")
    return items.select("item_id", F.explode("evidence").alias("e"), F.size("extractors").cast("bigint").alias("extractors")).select(
        "item_id", "e.turn_id", F.col("e.start").alias("start_at"), F.col("e.end").alias("end_at"), "extractors"
    )


_U2 = _RECON + """ select distinct c.item_id, g.turn_id, g.s as start_at, g.t as end_at, 2 as extractors from canon c join grouped g using (grp)
where (select count(*) from grouped o where o.grp = c.grp) > 1"""


def h1_merged(spark, sf):
    return reconciled(spark, sf)["merged"].select("canonical_id", "extractor", "type", "content", "confidence")


_MERGED = _RECON + """ select c.item_id as canonical_id, case o.ext when 0 then 'rules' else 'model' end as extractor, o.type, o.content, o.confidence
from canon c join grouped o on o.grp = c.grp and o.pos <> c.pos"""


def j7_j8_relations(spark, sf):
    return reconciled(spark, sf)["relations"].select("doc_id", "type", "from", "to")


_REL = _RECON + f""", {_DIAG},
ev as (select c.grp, c.doc_id, c.item_id, c.type, c.origin, c.ext, g.turn_id, g.s, g.t from canon c join grouped g using (grp))
select distinct a.doc_id, 'same_evidence' as type, a.item_id as "from", b.item_id as "to" from ev a join ev b on a.doc_id = b.doc_id and a.origin = b.origin
  and a.turn_id = b.turn_id and a.type <> b.type and a.ext <> b.ext and a.grp < b.grp and least(a.t, b.t) > greatest(a.s, b.s)
  and (least(a.t, b.t) - greatest(a.s, b.s))::double / least(a.t - a.s, b.t - b.s) >= 0.8
union all
select distinct c.doc_id, 'supersedes', x.canonical_id, y.canonical_id from ends e join canon_map x on x.item_id = e.from_id join canon_map y on y.item_id = e.to_id
  join accepted c on c.item_id = e.from_id where e.from_id <> e.to_id and x.canonical_id <> y.canonical_id"""


@lru_cache(maxsize=16)
def hybrid_archive(spark, sf):
    """The reconciled documents of the seeded view, with a field of our own on every turn and item."""
    t, r = seeded_turns(spark, sf), reconciled(spark, sf, script_relations)
    conv = conversations(t)
    # numbered over a stored table, and stored: each step behind reads it several times
    items = cut(number_rows(cut(r["items"]), ["doc_id"], F.floor(F.col("conv_pos") / F.lit(64)), ["conv_pos", "o1", "o2", "o3", "item_id"], "i"))
    now = F.lit("2025-06-01T00:00:00Z")
    own = {
        "items": F.to_variant_object(F.struct(F.length("content").alias("letters"), F.struct(F.col("type").alias("of")).alias("kind"))),
        "turns": F.to_variant_object(F.struct(F.col("idx").alias("n"))),
    }
    return AR.from_tables(assemble(conv, items, now), conv, t, items, r["merged"], r["relations"], F.lit(CAPTURED), now, own)


@lru_cache(maxsize=16)
def read_back(spark, sf):
    """Written, half of the documents as lines and the longer ones as fragments, and read again."""
    path = f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    AR.write(hybrid_archive(spark, sf), path, whole=40_000)
    return AR.to_tables(AR.read(spark, path))


def k2_items(spark, sf):
    r = read_back(spark, sf)["items"]
    kept = (F.try_variant_get("open", "$.letters", "int") == F.length("content")) & (F.try_variant_get("open", "$.kind.of", "string") == F.col("type"))
    return r.select(
        "item_id", "doc_id", "type", "content", "confidence", "assertion", F.coalesce(F.size("merged_from"), F.lit(0)).cast("bigint").alias("merged"),
        F.size("evidence").cast("bigint").alias("evidence"), F.array_join("extractors", ",").alias("extractors"), kept.alias("own_fields"),
    )


def k2_turns(spark, sf):
    t = read_back(spark, sf)["turns"]
    return t.select("doc_id", "conv_id", "turn_id", F.col("idx").cast("int").alias("idx"), "role", F.md5("content").alias("h"), F.try_variant_get("open", "$.n", "int").alias("n"))


def a12_report(spark, sf):
    return reconciled(spark, sf)["report"]


_A12 = _RECON + """, tot as (select doc_id, count(*) as candidates, count(distinct grp) as items from grouped group by doc_id)
select g.doc_id, case g.ext when 0 then 'rules' else 'model' end as extractor, count(*) as by_extractor, any_value(t.items) as items,
  any_value(t.candidates - t.items) as merged, any_value(t.candidates) as candidates from grouped g join tot t using (doc_id) group by g.doc_id, g.ext"""


def j6_pairs(spark, sf):
    """Overlapping evidence between rules and model: the interval-overlap join alone."""
    from turnloom.operators.items import dedupe_items

    rules = REC.as_candidates(dedupe_items(items_of(spark, sf), scope=("doc_id", "conv_id")), "rules", "deterministic", 0)
    model = REC.as_candidates(normalised(spark, sf)[0], "model", "semantic", 1)
    members = rules.withColumn("group_id", F.col("item_id")).withColumn("g_order", REC._order())
    return REC.overlap_pairs(members, model.withColumn("b_order", REC._order())).select("a", "b")


_J6 = _RECON + """ select distinct a.item_id as a, b.item_id as b from placed_c a join placed_c b on a.ext = 0 and b.ext = 1 and a.doc_id = b.doc_id and a.type = b.type
  and a.origin = b.origin and a.turn_id = b.turn_id and least(a.t, b.t) - greatest(a.s, b.s) > 0
  and (least(a.t, b.t) - greatest(a.s, b.s))::double / least(a.t - a.s, b.t - b.s) >= 0.5"""


def u1_union(spark, sf):
    rules = REC.as_candidates(items_of(spark, sf), "rules", "deterministic", 0)
    model = REC.as_candidates(normalised(spark, sf)[0], "model", "semantic", 1)
    return REC.union_all([rules, model]).groupBy("extractor", "type").agg(F.count(F.lit(1)).alias("n"))


def x17_modes(spark, sf):
    """Hybrid extraction where the model failed for one conversation in four: those fall back to rules."""
    t = seeded_turns(spark, sf)
    failed = conversations(t).filter(F.col("conv_pos") % 4 == 0).select("conv_id", F.lit("provider_timeout").alias("code"))
    model, relations, _ = normalised(spark, sf)
    out = extract_context(t, "hybrid", model_items=model, model_relations=relations, failures=failed)
    return out["items"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.count_if("fallback").alias("fallback_items"))


_RECON4 = RECON.replace("mpos, 0, 0, item_id, type, content, uri, origin, turn_id, start_at, end_at, confidence, assertion from accepted)",
                        "mpos, 0, 0, item_id, type, content, uri, origin, turn_id, start_at, end_at, confidence, assertion from accepted where conv_pos % 4 <> 0)")
_X17 = f"""with recursive {O.ITEMS},{NORMAL},{_RECON4} select doc_id, count(*) as items, count(*) filter (where conv_pos % 4 = 0) as fallback_items
from canon group by doc_id"""


def sizes(turns):
    """A conversation-level extractor of our own: how long each chat is, as a fact."""
    per = turns.groupBy("doc_id", "conv_id", "conv_pos").agg(F.count(F.lit(1)).alias("n"))
    return {"items": per.select("doc_id", "conv_id", "conv_pos", F.lit("fact").alias("type"), F.concat("conv_id", F.lit(" has "), F.col("n").cast("string"), F.lit(" turns")).alias("content"))}


register(ContextExtractor("sizes", "deterministic", sizes))


def d2_extractors(spark, sf):
    out = run_extractors(seeded_turns(spark, sf), [rule_extractor(), *registered("sizes")], "deterministic")
    return out["items"].select("doc_id", "conv_id", "type", "content", F.array_join("extractors", ",").alias("extractors"))


def d7_repeats(spark, sf):
    """Rules without de-duplication by content: a repeated statement stays, an item id does not come twice."""
    return extract_context(seeded_turns(spark, sf), dedupe=False)["items"].select("doc_id", "item_id", "content")


def d7_lenient(spark, sf):
    """Under the lenient policy a quote that is not found still counts if its message is known."""
    return normalised(spark, sf, "lenient")[0].select("conv_id", "ref", "type", "content", F.col("start").isNotNull().alias("located"))


_LENIENT = NORMAL.replace("when cite = 'outside' or q_at = 0 then", "when cite = 'outside' then")

# -- validation -------------------------------------------------------------------


@lru_cache(maxsize=16)
def tampered(spark, sf):
    """Documents with faults put in by arithmetic, stored once as the tables a validation reads."""
    return V.stored(V.Tables(*_tampered(spark, sf)))


def _tampered(spark, sf):
    t = seeded_turns(spark, sf)
    n = F.substring("doc_id", 2, 9).cast("int")
    versions = F.get(F.array(*[F.lit(v) for v in ("0.1", "0.1", "0.2", "0.1", "1.0", "0.0", None, "x", "0.1", "0.1")]), n % 10)
    docs = t.select("doc_id").distinct().select(
        "doc_id", F.concat(F.lit("id-"), "doc_id").alias("id"), versions.alias("version"), (n % 23 != 21).alias("is_object"),
        F.lit("2025-01-02T00:00:00Z").alias("created_at"),
        F.when(n % 3 == 0, F.lit("2025-01-01T00:00:00Z")).when(n % 5 == 3, F.lit("2025-02-30T00:00:00Z")).otherwise(F.lit("2025-01-03T00:00:00+01:00")).alias("updated_at"),
    )
    conv = conversations(t).select(
        "doc_id", F.col("conv_pos").alias("ci"),
        F.when(F.col("conv_pos") % 10 == 9, F.concat(F.lit("id-"), "doc_id")).otherwise(F.col("conv_id")).alias("id"), "kind", "platform", "captured_at",
    )
    turns = t.select(
        "doc_id", F.col("conv_pos").alias("ci"), F.col("idx").alias("ti"), F.col("turn_id").alias("id"),
        F.when(F.col("idx") == 3, F.lit(2)).otherwise(F.col("idx")).alias("index"), "role", "content",
        F.when(F.col("idx") == 5, F.lit("2025-13-01T00:00:00Z")).alias("timestamp"),
    )
    it = items_of(spark, sf)
    i = F.col("conv_pos") * 100_000 + F.col("idx").cast("bigint") * 10_000 + F.col("start")  # bigint: beyond an int from chat 21,475 or turn 214,749 on
    k = (F.col("conv_pos") + F.col("idx")) % 9
    items = it.select(
        "doc_id", i.alias("i"), F.when(k == 8, F.col("turn_id")).otherwise(F.col("item_id")).alias("id"),
        F.when((k == 7) & (n % 10 != 0), F.lit("mood")).otherwise(F.col("type")).alias("type"), "content",
        F.when((k == 6) & (n % 10 == 1), F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence"), F.lit(None).cast("double").alias("importance"),
        "strength", "status", "language", "uri", F.lit("2025-01-02T00:00:00Z").alias("created_at"), F.lit("browser").alias("kind"),
        F.when(F.col("conv_pos") % 7 == 3, "elsewhere").when(F.col("conv_pos") % 2 == 0, "chatgpt").otherwise("claude").alias("platform"),
        F.when(k == 0, F.lit("nowhere")).when(k == 1, F.lit(None)).otherwise(F.col("conv_id")).alias("conversation_id"),
        F.when(k == 2, F.lit("c0_t0")).when(k == 3, F.lit("gone")).when(k == 4, F.lit(None)).otherwise(F.col("turn_id")).alias("turn_id"),
        F.col("start"), F.when(k == 5, F.lit(1_000_000)).otherwise(F.col("end")).alias("end"), "method", "agent", F.lit("2025-01-02T00:00:00Z").alias("captured_at"),
    )
    return docs, conv, turns, items


TAMPERED = f"""vdocs as (select doc_id, substr(doc_id, 2)::int as n, 'id-' || doc_id as id from (select distinct doc_id from seeded)),
vd as (select *, ['0.1','0.1','0.2','0.1','1.0','0.0',null,'x','0.1','0.1'][n % 10 + 1] as version, n % 23 <> 21 as is_object,
  case when n % 3 = 0 then 'order' when n % 5 = 3 then 'bad' else 'fine' end as upd from vdocs),
gate as (select doc_id, n, case when not is_object then 'not_an_object' when version is null then 'missing_version' when version = 'x' then 'invalid_version'
  when version = '1.0' then 'unsupported_major_version' when version = '0.0' then 'requires_upgrade' when version = '0.2' then 'newer_minor_version' end as code from vd),
passed as (select doc_id, n, code from gate where code is null or code = 'newer_minor_version'),
vi as (select i.*, p.n, p.code as gate_code, (conv_pos * 100000 + i.idx * 10000 + start_at)::int as i, (conv_pos + i.idx) % 9 as k
  from items i join passed p using (doc_id)),
bad_items as (select doc_id, i from vi where k = 6 and n % 10 = 1),
sound as (select * from passed where doc_id not in (select doc_id from bad_items)),
known as (select v.* from vi v join sound using (doc_id) where not (k = 7 and v.n % 10 <> 0)),
st as (select t.*, s.n from seeded t join sound s using (doc_id)),
claimed as (
  select doc_id, 'id-' || doc_id as id, [0, 0, -1] as c_at, '$.id' as path from sound
  union all select doc_id, case when conv_pos % 10 = 9 then 'id-' || doc_id else conv_id end, [1, conv_pos::int, -1], '$.conversations[' || conv_pos || '].id' from (select distinct doc_id, conv_id, conv_pos from st)
  union all select doc_id, turn_id, [1, conv_pos::int, idx], '$.conversations[' || conv_pos || '].turns[' || idx || '].id' from st
  union all select doc_id, case when k = 8 then turn_id else item_id end, [2, i, -1], '$.items[' || i || '].id' from known),
prov as (select *, case when k = 0 then 'nowhere' when k = 1 then null else conv_id end as p_conv,
  case when k = 2 then 'c0_t0' when k = 3 then 'gone' when k = 4 then null else turn_id end as p_turn,
  case when k = 5 then 1000000 else end_at end as p_end from known),
owners as (select doc_id, conv_pos, turn_id, case when conv_pos % 10 = 9 then 'id-' || doc_id else conv_id end as owner, {O.u16('content')} as size from st),
seen as (select p.*, exists (select 1 from owners o where o.doc_id = p.doc_id and o.owner = p.p_conv) as conv_known,
  (select max(o.size) from owners o where o.doc_id = p.doc_id and o.owner = p.p_conv and o.turn_id = p.p_turn) as turn_size,
  exists (select 1 from owners o where o.doc_id = p.doc_id and o.turn_id = p.p_turn) as turn_known from prov p),
issues as (
  select doc_id, case when code = 'newer_minor_version' then 'warning' else 'error' end as severity, code, case when code = 'not_an_object' then '$' else '$.context_version' end as path from gate where code is not null
  union all select doc_id, case when gate_code is null then 'error' else 'warning' end, 'unknown_item_type', '$.items[' || i || '].type' from vi where k = 7 and n % 10 <> 0
  union all select doc_id, 'error', 'schema', '$.items[' || i || '].confidence' from vi where k = 6 and n % 10 = 1
  union all select s.doc_id, case upd when 'order' then 'warning' else 'error' end, case upd when 'order' then 'timestamp_order' else 'invalid_timestamp' end, '$.metadata.updated_at'
    from sound s join vd using (doc_id) where upd <> 'fine'
  union all select doc_id, 'error', 'invalid_timestamp', '$.conversations[' || conv_pos || '].turns[' || idx || '].timestamp' from st where idx = 5
  union all select doc_id, 'error', 'duplicate_id', path from claimed qualify row_number() over (partition by doc_id, id order by c_at) > 1
  union all select doc_id, 'error', 'duplicate_turn_index', '$.conversations[' || conv_pos || '].turns[' || idx || '].index' from st where idx = 3
  union all select doc_id, 'error', 'unknown_conversation', '$.items[' || i || '].provenance.conversation_id' from seen where p_conv is not null and not conv_known
  union all select doc_id, 'warning', 'source_mismatch', '$.items[' || i || '].provenance.source' from seen where conv_known and conv_pos % 7 = 3
  union all select doc_id, 'error', 'turn_without_conversation', '$.items[' || i || '].provenance.turn_id' from seen where p_turn is not null and p_conv is null
  union all select doc_id, 'error', case when turn_known then 'turn_not_in_conversation' else 'unknown_turn' end, '$.items[' || i || '].provenance.turn_id' from seen
    where p_turn is not null and conv_known and turn_size is null
  union all select doc_id, 'error', 'span_without_turn', '$.items[' || i || '].provenance.span' from seen where p_turn is null
  union all select doc_id, 'error', 'invalid_span', '$.items[' || i || '].provenance.span' from seen where p_turn is not null and (p_end <= start_at or p_end > turn_size))"""
_V = f"with {O.ITEMS},{TAMPERED} "


def codes(*names):
    def run(spark, sf):
        return V.validate(tampered(spark, sf)).filter(F.col("code").isin(*names))

    return run, _V + "select doc_id, severity, code, path from issues where code in (" + ", ".join(f"'{n}'" for n in names) + ")"


def v14_format(spark, sf):
    return V.validate(tampered(spark, sf)).groupBy(V.format_issue().alias("line")).agg(F.count(F.lit(1)).alias("n"))


def v11_upgrade(spark, sf):
    docs = tampered(spark, sf).docs.filter("is_object and version is not null")
    chain = [V.Upgrade("0.0", "0.1", lambda d: d.withColumn("created_at", F.lit("2024-01-01T00:00:00Z")))]
    good, bad = V.upgrade(docs, chain)
    return good.select("doc_id", "version", F.array_join("applied", ",").alias("applied"), F.lit(None).cast("string").alias("code")).unionByName(
        bad.select("doc_id", "version", F.lit(None).cast("string").alias("applied"), "code")
    )


def _extension(spark, sf):
    d = stored_items(spark, sf)
    k = (F.col("conv_pos") + F.col("idx")) % 6
    notes = d.select(
        "doc_id", F.when(k == 0, F.concat(F.lit("x"), "item_id")).otherwise(F.col("item_id")).alias("item_id"),
        F.when(k == 1, F.lit("assistant")).when(k == 5, F.lit("robot")).otherwise(F.col("role")).alias("origin"), F.lit("explicit").alias("assertion"),
        F.array(F.struct(
            F.when(k == 2, F.lit("gone")).otherwise(F.col("turn_id")).alias("turn_id"), "start", F.when(k == 3, F.lit(9_999_999)).otherwise(F.col("end")).alias("end")
        )).alias("evidence"),
    )
    rels = d.groupBy("doc_id").agg(F.min("item_id").alias("from"), F.max(F.when(F.substring("doc_id", 2, 9).cast("int") % 2 == 0, F.col("item_id")).otherwise(F.lit("zz"))).alias("to"))
    return V.extension_issues(d, seeded_turns(spark, sf), notes, rels.withColumn("type", F.lit("supersedes")))


_V12 = f"""with {O.DEDUPED}, e as (select *, (conv_pos + idx) % 6 as k from deduped),
ext as (select doc_id, 'invalid_extension' as code, item_id as ref from e where k = 5 union all select doc_id, 'unknown_item', 'x' || item_id from e where k = 0
union all select doc_id, 'unknown_turn', item_id from e where k = 2 union all select doc_id, 'invalid_span', item_id from e where k = 3
union all select doc_id, 'origin_mismatch', item_id from e where (k = 1 and role <> 'assistant') or k = 5
union all select doc_id, 'unknown_relation_target', min(item_id) || '→zz' from deduped where substr(doc_id, 2)::int % 2 = 1 group by doc_id)"""


def v13_blocking(spark, sf):
    blocking, warn = V.split_blocking(_extension(spark, sf))
    tag = lambda d, b: d.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("blocking", F.lit(b))
    return tag(blocking, True).unionByName(tag(warn, False))


# -- evaluation -------------------------------------------------------------------
GOLD = (("constraint", "user", "jar"), ("constraint", "user", "labelled"), ("constraint", "user", "vinegar"), ("decision", "user", "sourdough"),
        ("preference", "user", "postgresql"), ("task", "user", "sync"), ("question", "user", "redis"), ("reference", "assistant", "guide"), ("fact", "user", "nothing like it"))
FORBID = (("constraint", "system", "retry", "unconfirmed"), ("constraint", "system", "the", "too broad"), ("decision", "assistant", "fastify", "assistant choice"))


def _gold(spark, sf):
    t = seeded_turns(spark, sf)
    docs = t.groupBy("doc_id").agg(F.min("conv_pos").alias("n"))
    rows = F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("origin"), F.lit(i % 8).alias("message"), F.array(F.lit(c.upper())).alias("match")) for i, (a, b, c) in enumerate(GOLD)])
    bad = F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("origin"), F.array(F.lit(c)).alias("match"), F.lit(r).alias("reason")) for a, b, c, r in FORBID])
    gold = docs.select("doc_id", F.posexplode(rows).alias("gpos", "g")).select("doc_id", "gpos", "g.*")
    forbidden = docs.select("doc_id", F.posexplode(bad).alias("fpos", "f")).select("doc_id", "fpos", "f.*")
    return gold, forbidden


_GOLD = "gold(gpos, type, origin, word) as (values " + ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(GOLD)) + "),\n" \
    "forb(fpos, type, origin, word, reason) as (values " + ", ".join(f"({i}, '{a}', '{b}', '{c}', '{r}')" for i, (a, b, c, r) in enumerate(FORBID)) + ")"
EVALSQL = f"""{_GOLD},
pred as (select *, row_number() over (partition by doc_id order by conv_pos, idx, rank, seq, item_id) as pos,
  lower(content || case when type = 'reference' then ' ' || uri || ' ' || coalesce(title, '') when type = 'code_artifact' then ' ' || coalesce(filename, '') else '' end) as txt from deduped),
docs as (select distinct doc_id from seeded),
walk(doc_id, gpos, a, used) as (
  select doc_id, -1, null::bigint, []::bigint[] from docs
  union all select doc_id, gpos, a, case when a is null then used else list_append(used, a) end from (
    select w.doc_id, g.gpos, (select min(p.pos) from pred p where p.doc_id = w.doc_id and p.type = g.type and contains(p.txt, g.word) and not list_contains(w.used, p.pos)) as a, w.used
    from walk w join gold g on g.gpos = w.gpos + 1)),
hits as (select w.doc_id, w.gpos, p.item_id, p.role = g.origin as origin_ok, p.idx = w.gpos % 8 as place_ok from walk w join gold g using (gpos) join pred p on p.doc_id = w.doc_id and p.pos = w.a),
banned as (select p.doc_id, p.item_id, f.fpos, f.reason from pred p join forb f on f.type = p.type and f.origin = p.role and contains(p.txt, f.word)
  qualify row_number() over (partition by p.doc_id, p.item_id order by fpos) = 1),
cnt as (select d.doc_id, {len(GOLD)} as gold, (select count(*) from pred p where p.doc_id = d.doc_id) as predicted,
  (select count(*) from hits h where h.doc_id = d.doc_id) as matched, (select count(*) filter (where origin_ok) from hits h where h.doc_id = d.doc_id) as origin_correct,
  (select count(*) filter (where place_ok) from hits h where h.doc_id = d.doc_id) as provenance_correct, 0 as unsupported,
  (select count(*) from banned b where b.doc_id = d.doc_id) as forbidden from docs d)"""
_EV = f"with recursive {O.DEDUPED},{EVALSQL} "


def h3_matches(spark, sf):
    gold, _ = _gold(spark, sf)
    return EV.match_gold(gold, stored_items(spark, sf)).select("doc_id", F.col("gpos").cast("bigint").alias("gpos"), "item_id")


def j10_candidates(spark, sf):
    gold, _ = _gold(spark, sf)
    return EV.gold_candidates(gold, stored_items(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def j11_forbidden(spark, sf):
    _, bad = _gold(spark, sf)
    return EV.forbidden_hits(bad, stored_items(spark, sf)).select("doc_id", "item_id", "reason")


def _counts(spark, sf):
    gold, bad = _gold(spark, sf)
    return EV.evaluation_counts(gold, bad, stored_items(spark, sf), seeded_turns(spark, sf))


_RATIO = "case when {d} = 0 then 1.0 else {n}::double / {d} end"
_A11 = _EV + f""", rep as (select coalesce(doc_id, 'TOTAL') as fixture, {', '.join(f'sum({c})::bigint as {c}' for c in EV.COUNTS)} from cnt group by grouping sets ((doc_id), ())),
m as (select *, {_RATIO.format(n='matched', d='predicted')} as precision, {_RATIO.format(n='matched', d='gold')} as recall,
  {_RATIO.format(n='origin_correct', d='matched')} as attribution_accuracy, {_RATIO.format(n='provenance_correct', d='matched')} as provenance_accuracy from rep)
select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from m"""

_MODEL_ITEMS_OF = lambda *cols: (lambda spark, sf: h9_items(spark, sf).select(*cols))

QUERIES = {
    "h4_attribution_rules": (h4_rules, _H4),
    "h5_origin_correction": (_MODEL_ITEMS_OF("item_id", "origin"), _NORMAL + "select item_id, origin from accepted"),
    "h6_evidence_policy": (
        lambda spark, sf: h9_diagnostics(spark, sf).filter(F.col("code").isin(*SEM.REJECTED)).select("conv_id", "ref", "code"),
        _NORMAL + "select conv_id, ref, verdict as code from fresh where not is_copy and verdict is not null",
    ),
    "h7_confidence_caps": (_MODEL_ITEMS_OF("item_id", "assertion", "confidence"), _NORMAL + "select item_id, assertion, confidence from accepted"),
    "h8_type_repair": (
        _MODEL_ITEMS_OF("item_id", "type", "strength", "status", "language", "uri", "title"),
        _NORMAL + "select item_id, type, strength, status, language, uri, title from accepted",
    ),
    "h9_normalise": (h9_items, _NORMAL + f"select {_MODEL_COLS} from accepted"),
    "h9_diagnostics": (h9_diagnostics, _NORMAL + f", {_DIAG} select * from diag"),
    "w3_duplicate_refs": (
        lambda spark, sf: h9_diagnostics(spark, sf).filter("code = 'duplicate_ref'").select("conv_id", "ref"),
        _NORMAL + "select conv_id, ref from fresh where is_copy",
    ),
    "h10_size_gate": (
        h10_gate,
        f"""with {SEEDED}, p as (select conv_id, '[' || string_agg('{{"ref":"m' || idx || '","role":"' || role || '","content":' || to_json(content)::varchar || '}}', ',' order by idx) || ']' as prompt,
  sum(length('{{"ref":"m","role":"' || role || '","content":' || to_json(content)::varchar || '}}') + 8) as chars from seeded group by conv_id)
select conv_id, case when chars > 1500 then 'input_too_large' end as code, case when chars <= 1500 then md5(prompt) end as h from p""",
    ),
    "h10_prompt_rows": (
        h10_prompts,
        f"""with {SEEDED}, p as (select conv_id, '[' || string_agg('{{"ref":"m' || idx || '","role":"' || role || '","content":' || to_json(content)::varchar || '}}', ',' order by idx) || ']' as prompt from seeded group by conv_id)
select conv_id, md5(prompt) as h, length(prompt) as n from p""",
    ),
    "j4_evidence": (
        j4_evidence,
        _NORMAL + "select conv_id, idx as mpos, case when cite = 'cited' then turn_id end as turn_id, case when cite = 'cited' and q_at > 0 then q_at - 1 end as start_at, "
        "case when cite = 'cited' and q_at > 0 then q_at - 1 + size end as end_at from said where cite <> 'none'",
    ),
    "j5_model_relations": (j5_relations, _NORMAL + f""", {_DIAG} select conv_id, 'supersedes' as type, from_id as "from", to_id as "to" from ends where from_id <> to_id"""),
    "a13_extraction_summary": (
        a13_summary,
        _NORMAL + "select conv_id, count(*) as candidates, (select count(*) from accepted a where a.conv_id = f.conv_id) as accepted, "
        "count(*) filter (where not is_copy and verdict is not null) as rejected from fresh f group by conv_id",
    ),
    "j6_overlap_pairs": (j6_pairs, _J6),
    "h1_reconcile": (h1_items, _H1),
    "h2_merged_from": (h1_merged, _MERGED),
    "u2_u3_evidence_union": (u2_evidence, _U2),
    "j7_j8_relations": (j7_j8_relations, _REL),
    "k2_s4_round_trip_items": (k2_items, f"select *, true as own_fields from ({_H1})"),
    "k2_s4_round_trip_relations": (lambda spark, sf: read_back(spark, sf)["relations"].select("doc_id", "type", "from", "to"), _REL.replace(_ENDS, _CHAIN)),
    "k2_s4_round_trip_turns": (k2_turns, f"with {SEEDED} select doc_id, conv_id, turn_id, idx, role, md5(content) as h, idx as n from seeded"),
    "a12_reconcile_report": (a12_report, _A12),
    "u1_union": (
        u1_union,
        f"with {O.ITEMS},{NORMAL} select 'rules' as extractor, type, count(*) as n from items group by all union all select 'model', type, count(*) from accepted group by all",
    ),
    "x17_hybrid_fallback": (x17_modes, _X17),
    "d2_conversation_extractor": (
        d2_extractors,
        _RECON + " select doc_id, (select s.conv_id from seeded s where s.turn_id = r.turn_id) as conv_id, type, content, 'rules' as extractors from rules r "
        "union all select doc_id, conv_id, 'fact', conv_id || ' has ' || count(*) || ' turns', 'sizes' from seeded group by doc_id, conv_id",
    ),
    "d7_without_dedupe": (d7_repeats, f"with {O.ITEMS} select doc_id, item_id, any_value(content) as content from items group by doc_id, item_id"),
    "d7_lenient_policy": (d7_lenient, f"with {SEEDED},{_LENIENT} select conv_id, ref, type, content, start_at >= 0 as located from accepted"),
    "v1_version_gate": codes("not_an_object", "missing_version", "invalid_version", "unsupported_major_version", "requires_upgrade", "newer_minor_version"),
    "v2_unknown_types": codes("unknown_item_type"),
    "v3_structure": codes("schema"),
    "v4_timestamps": codes("invalid_timestamp"),
    "v5_timestamp_order": codes("timestamp_order"),
    "v6_duplicate_ids": codes("duplicate_id"),
    "v7_duplicate_turn_index": codes("duplicate_turn_index"),
    "v8_references": codes("unknown_conversation", "unknown_turn", "turn_not_in_conversation", "turn_without_conversation"),
    "v9_source_mismatch": codes("source_mismatch"),
    "v10_spans": codes("span_without_turn", "invalid_span"),
    "v11_upgrade": (
        v11_upgrade,
        f"with {O.ITEMS},{TAMPERED} select doc_id, case when version = '0.0' then '0.1' else version end as version, case when version in ('0.1','0.2','x') then '' when version = '0.0' then '0.0→0.1' end as applied, "
        "case when version = '1.0' then 'unsupported_major_version' end as code from vd where is_object and version is not null",
    ),
    "v12_extension": (_extension, _V12 + " select * from ext"),
    "v13_blocking": (v13_blocking, _V12 + " select code, code in ('invalid_extension','unknown_item','unknown_turn') as blocking, count(*) as n from ext group by all"),
    "v14_issue_lines": (v14_format, _V + "select upper(severity) || ' ' || code || ' at ' || path as line, count(*) as n from issues group by all"),
    "h3_gold_matching": (h3_matches, _EV + "select doc_id, gpos, item_id from hits"),
    "j10_gold_candidates": (
        j10_candidates,
        _EV + """, c as (select p.doc_id, g.gpos, g.type, row_number() over (partition by p.doc_id, g.gpos order by p.pos) as place from pred p join gold g on g.type = p.type and contains(p.txt, g.word))
select doc_id, count(*) as n from c where place <= (select count(*) from gold g where g.type = c.type) group by doc_id""",
    ),
    "j11_forbidden": (j11_forbidden, _EV + "select doc_id, item_id, reason from banned"),
    "a9_evaluation_counts": (_counts, _EV + "select * from cnt"),
    "a10_metrics": (lambda spark, sf: EV.metrics(_counts(spark, sf)), _A11.replace("select *, case when precision + recall", "select * exclude (fixture), fixture as doc_id, case when precision + recall") + " where fixture <> 'TOTAL'"),
    "a11_report_with_total": (lambda spark, sf: EV.report(_counts(spark, sf)), _A11),
}
