"""Queries over documents, rendering, the store, versions, analytics and search (K, F11-F14, T, W6-W9, A5-A8, I, R, S6, S7)."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.functions import media
from turnloom.functions import platform as PF
from turnloom.functions import rules as R
from turnloom.functions import text as X
from turnloom.operators import analytics as AN
from turnloom.operators import compressors as CP
from turnloom.operators import documents as D
from turnloom.operators import items as I
from turnloom.operators import render as RN
from turnloom.operators import search as SE
from turnloom.operators import store as ST
from turnloom.plans import oracle as O
from turnloom.plans.extraction import FILTER, _FILTER_SQL, _LABEL, _SECTION, stored_items
from turnloom.plans.seeded import CAPTURED, CONVS, SEEDED, conversations, documents, seeded_turns
from turnloom.session import checkpoint_dir, cut, spread
from turnloom.sources import pages as PG
from turnloom.sources import tree as TR

NOW = "2025-06-01T00:00:00Z"


@lru_cache(maxsize=16)
def envelopes(spark, sf):
    return D.assemble(conversations(seeded_turns(spark, sf)), stored_items(spark, sf), F.lit(NOW))


_SETID = "sum(('0x' || left(md5(conv_id), 15))::ubigint::hugeint)"
ENV = f"""env as (select c.doc_id, {O.stable_id('doc', 'c.n', 'c.ids')} as context_id, '0.1' as version, case when c.n = 1 then c.t end as title, '{NOW}' as created_at,
  '{NOW}' as updated_at, 'turnloom@1' as created_by, c.n as conversation_count, coalesce(i.n, 0) as item_count
  from (select doc_id, count(*) as n, {_SETID} as ids, max(title) as t from convs group by doc_id) c left join (select doc_id, count(*) as n from deduped group by doc_id) i using (doc_id))"""


def k2_fragments(spark, sf):
    t = seeded_turns(spark, sf)
    conv = conversations(t)
    items = stored_items(spark, sf).join(conv.select("conv_id", "platform", "kind"), "conv_id")
    items = items.withColumn("created_at", F.lit(NOW)).withColumn("captured_at", F.lit(CAPTURED))
    return D.json_fragments(envelopes(spark, sf), conv, t, D.with_wire_spans(items, t))


_K2 = f"""with {O.DEDUPED},{CONVS},{ENV},
x as (select d.*, c.platform, s.content as turn_text, row_number() over (partition by d.doc_id order by d.conv_pos, d.idx, rank, seq) as rn,
  case when seq = 1000000 then 1000000 else row_number() over (partition by d.turn_id, rank order by seq) end as dummy from deduped d join convs c using (conv_id) join seeded s on s.turn_id = d.turn_id),
frag as (
 select doc_id, 0 as part, 0::bigint as p1, 0::bigint as p2, '{{"context_version":"0.1","id":"' || context_id || '","metadata":{{"created_at":"{NOW}","updated_at":"{NOW}","created_by":{{"agent":"turnloom@1"}}}},"conversations":[' as text from env
 union all select doc_id, 1, conv_pos, -1, case when row_number() over (partition by doc_id order by conv_pos) = 1 then '' else ',' end || '{{"id":"' || conv_id || '","source":{{"kind":"browser","platform":"' || platform || '"}},"title":"' || title || '","url":"' || url || '","captured_at":"' || captured_at || '","turns":[' from convs
 union all select doc_id, 1, conv_pos, idx, case when row_number() over (partition by conv_id order by idx) = 1 then '' else ',' end || '{{"id":"' || turn_id || '","index":' || idx || ',"role":"' || role || '","content":' || to_json(content)::varchar || '}}' from seeded
 union all select doc_id, 1, conv_pos, 2147483647, ']}}' from convs
 union all select doc_id, 2, 0, 0, '],"items":[' from env
 union all select doc_id, 3, conv_pos, idx, case when rn = 1 then '' else ',' end || '{{"id":"' || item_id || '","type":"' || type || '","content":' || to_json(content)::varchar || ',"confidence":' || case when confidence = 1 then '1.0' else confidence::varchar end
   || coalesce(',"strength":"' || strength || '"', '') || coalesce(',"status":"' || status || '"', '') || coalesce(',"language":"' || language || '"', '') || coalesce(',"filename":"' || filename || '"', '')
   || coalesce(',"uri":"' || uri || '"', '') || coalesce(',"title":"' || title || '"', '') || ',"provenance":{{"source":{{"kind":"browser","platform":"' || platform || '"}},"conversation_id":"' || conv_id || '","turn_id":"' || turn_id
   || '","span":{{"start":' || {O.u16('left(turn_text, start_at)')} || ',"end":' || {O.u16('left(turn_text, end_at)')} || '}},"captured_at":"{CAPTURED}","extracted_by":{{"method":"' || method || '","agent":"'
   || case rank when 0 then '{S.CODE_AGENT}' when 1 then '{S.LINK_AGENT}' else '{S.RULE_AGENT}' end || '"}}}},"created_at":"{NOW}"}}' from x
 union all select doc_id, 4, 0, 0, ']}}' from env)
select * from frag"""


@lru_cache(maxsize=16)
def resolved(spark, sf):
    t = seeded_turns(spark, sf)
    return I.resolve_provenance(I.decode_filter(stored_items(spark, sf), **FILTER), conversations(t), t)


def f11_markdown(spark, sf):
    t = seeded_turns(spark, sf)
    available = stored_items(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("available_items"))
    return RN.render_markdown(envelopes(spark, sf), conversations(t), resolved(spark, sf), available)


_DESC = "platform || ' · \"' || ctitle || '\" · turn ' || idx || ' (' || role || ') · ' || method"
_NOTE = f"' _(' || {_DESC} || case when method = 'heuristic' then printf(' %.2f', confidence) else '' end || ')_'"
_F11 = f"""with {O.DEDUPED},{CONVS},{ENV},
sel as (select d.*, c.platform, c.title as ctitle, {_SECTION} as section, {_LABEL} as label from deduped d join convs c using (conv_id) where {_FILTER_SQL}),
tot as (select d.doc_id, count(*) as avail, (select count(*) from sel s where s.doc_id = d.doc_id) as total,
  (select count(*) from sel s where s.doc_id = d.doc_id and method = 'deterministic') as det, (select count(*) from sel s where s.doc_id = d.doc_id and method = 'heuristic') as heu from deduped d group by d.doc_id),
shown as (select *, case type when 'constraint' then '- **' || upper(replace(strength, '_', ' ')) || ':** ' || content || {_NOTE}
   when 'decision' then '- ' || content || coalesce(' [' || status || ']', '') || {_NOTE}
   when 'code_artifact' then '**' || language || coalesce(' — `' || filename || '`', '') || '**' || {_NOTE} || chr(10) || chr(10) || '```' || language || chr(10) || content || chr(10) || '```' end
   || case when type = 'code_artifact' and row_number() over (partition by doc_id, type order by conv_pos desc, idx desc, rank desc, seq desc) > 1 then chr(10) || chr(10) else chr(10) end as line from sel)
select doc_id, -3 as section, 0 as conv_pos, -1 as block, '# Context' || chr(10) || chr(10) || 'Document `' || context_id || '` · v0.1 · updated {NOW}' || chr(10) || chr(10) || 'Sources:' || chr(10) as text from env
union all select doc_id, -2, conv_pos, -1, '- ' || platform || ' (browser) — "' || title || '", ' || turn_count || ' turns, captured ' || captured_at || ' — ' || url || chr(10) from convs
union all select doc_id, -1, 0, -1, chr(10) || '> Extraction: ' || case when det > 0 then '{RN.METHOD_NOTES['deterministic']}' || case when heu > 0 then '; ' else '' end else '' end
   || case when heu > 0 then '{RN.METHOD_NOTES['heuristic']}' else '' end || '.' || chr(10) || case when heu > 0 then '> The numbers rank patterns; no model has judged them. Look up the turn before you rely on an entry.' || chr(10) else '' end
   || case when total < avail then chr(10) || '_Showing ' || total || ' of ' || avail || ' items (filtered)._' || chr(10) else '' end from tot where total > 0
union all select distinct doc_id, section, -1, -1, chr(10) || '## ' || label || chr(10) || chr(10) from sel
union all select doc_id, section, conv_pos, idx // 64, string_agg(line, '' order by idx, rank, seq) from shown group by all"""


def f12_handoff(spark, sf):
    t = seeded_turns(spark, sf)
    head = conversations(t).groupBy("doc_id").agg(F.min("platform").alias("platform"), F.max("captured_at").alias("captured_at"))
    env = envelopes(spark, sf).join(head, "doc_id")
    chosen = t.groupBy("doc_id").agg(F.count_if(F.col("idx") < 3).alias("selected"), F.count(F.lit(1)).alias("total_messages"))
    return RN.handoff_items(env, I.decode_filter(stored_items(spark, sf), **FILTER), chosen, annotated=False)


_F12 = f"""with {O.DEDUPED},{CONVS},{ENV}, sel as (select *, {_SECTION} as section, {_LABEL} as label from deduped where {_FILTER_SQL}),
shown as (select *, case type when 'constraint' then '- ' || upper(replace(strength, '_', ' ')) || ': ' || content when 'decision' then '- ' || content
  when 'code_artifact' then coalesce(filename || ':' || chr(10), '') || '```' || language || chr(10) || content || chr(10) || '```' end || chr(10) as line from sel)
select e.doc_id, -3 as section, 0 as conv_pos, -1 as block, '# Context handoff from CHATGPT' || chr(10) || 'Captured: {CAPTURED}' || chr(10) || 'Selected: ' || (select count(*) from seeded s where s.doc_id = e.doc_id and idx < 3)
  || ' of ' || (select count(*) from seeded s where s.doc_id = e.doc_id) || ' messages, ' || (select count(*) from sel s where s.doc_id = e.doc_id) || ' context items' || chr(10) || chr(10)
  || 'This goes on from a chat held elsewhere.' || chr(10) || 'The user selected the context below. Treat it as your own prior memory of this project.' || chr(10) || chr(10) as text from env e
union all select distinct doc_id, section, -1, -1, '## ' || label || chr(10) from sel
union all select doc_id, section, conv_pos, idx // 64, string_agg(line, '' order by idx, rank, seq) from shown group by all
union all select distinct doc_id, section, 9223372036854775807, -1, chr(10) from sel
union all select doc_id, 100, 0, -1, '## Your job' || chr(10) || 'Acknowledge the handoff in one sentence, then continue helping from this context.' from env"""


def f25_notes(spark, sf):
    from turnloom.operators.extract import annotate

    d = annotate(stored_items(spark, sf))
    return d.select("item_id", RN.attribution_note(F.col("origin"), F.col("assertion")).alias("note"))


def t2_sentences(spark, sf):
    s = RN.summary_sentences(seeded_turns(spark, sf))
    return RN.top_sentences(s, R.CONTEXT_HINTS, 6).select("conv_id", F.col("place").cast("bigint").alias("place"), "sentence", F.col("score").cast("bigint").alias("score"))


def _score(hints):
    return " + ".join(f"{O.hit('sentence', h)}::int" for h in hints)


SENT = f"""tagged as (select conv_id, role, idx, regexp_replace(regexp_replace(content, '(?s)```([A-Za-z0-9_+-]+)\\n.*?```', '[code:\\1]', 'g'), '(?s)```\\n.*?```', '[code:text]', 'g') as c
  from seeded where role in ('user','assistant')),
cut1 as (select conv_id, role, idx, unnest(string_split(c, chr(10))) as line, generate_subscripts(string_split(c, chr(10)), 1) as ln from tagged),
cut2 as (select conv_id, role, idx, ln, unnest(string_split(regexp_replace(line, {O.lit('([.!?])' + O.WS + '+([A-Z0-9])')}, '\\1' || chr(1) || '\\2', 'g'), chr(1))) as raw,
  generate_subscripts(string_split(regexp_replace(line, {O.lit('([.!?])' + O.WS + '+([A-Z0-9])')}, '\\1' || chr(1) || '\\2', 'g'), chr(1)), 1) as pn from cut1),
sents as (select conv_id, role, row_number() over (partition by conv_id order by role <> 'user', idx, ln, pn) as rn, {O.trim('raw')} as sentence from cut2 where {O.trim('raw')} <> '')"""


def _top(name, hints, k, where="true"):
    return f"""{name}_t as (select *, {_score(hints)} as score from sents where {where}),
{name}_k as (select *, row_number() over (partition by conv_id order by score desc, rn) as place from {name}_t where score > 0),
{name} as (select * from {name}_k where place <= {k} qualify row_number() over (partition by conv_id, left(regexp_replace(lower(sentence), {O.lit(O.WS + '+')}, ' ', 'g'), 118) order by place) = 1)"""


def _short(spark, sf):
    """Turns whose fences carry a language only, as the summary reads them."""
    return seeded_turns(spark, sf).withColumn("content", F.replace("content", F.lit(" src/r.ts"), F.lit("")))


_SHORT = SEEDED.replace("seeded as (", "seeded0 as (") + ",\nseeded as (select * replace (replace(content, ' src/r.ts', '') as content) from seeded0)"


def t3_code(spark, sf):
    return RN.summary_code(_short(spark, sf)).select("conv_id", "language", "code", F.col("place").cast("bigint").alias("place"))


def f13_summary(spark, sf):
    t = _short(spark, sf)
    return RN.compress(conversations(t), t, max_chars=1500, keep_last=1).select("conv_id", "summary")


def d5_compressors(spark, sf):
    """A compressor of our own beside the one that keeps the last turns."""
    t = seeded_turns(spark, sf)
    conv = conversations(t)

    def openers(conversations, turns):
        return turns.groupBy("conv_id").agg(F.min_by("content", "idx").alias("summary"))

    own = CP.summarise(conv, t, CP.register("openers", openers) and "openers", max_chars=60)
    last = CP.summarise(conv, t, CP.last_turns(2, 50))
    return own.unionByName(last.withColumn("compressor", F.lit("last_turns")))


_D5 = f"""with {SEEDED}, f as (select conv_id, arg_min(content, idx) as s from seeded group by conv_id),
l as (select conv_id, idx, role || ': ' || left(content, 50) as t from seeded qualify row_number() over (partition by conv_id order by idx desc) <= 2)
select conv_id, left(s, 60) as summary, 'openers' as compressor, length(s) > 60 as cut from f
union all select conv_id, string_agg(t, chr(10) order by idx), 'last_turns', false from l group by conv_id"""


def i2_stored(spark, sf):
    """Three queries over written postings; each reads the part of the tokens it needs."""
    path = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    SE.write_search_tables(index_of(spark, sf), path)
    found = [SE.stored_matches(spark, path, q).withColumn("query_id", F.lit(i).cast("bigint")) for i, q in enumerate(STORED_QUERIES)]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("query_id", "field", "conv_id", "hits")


STORED_QUERIES = ("harv", "Tast th, a", "ch 1")

_FENCE_ANY = "(?s)```([A-Za-z0-9_+-]*)\\n(.*?)```"
_CODE3 = f"""codes3 as (select conv_id, language, code, row_number() over (partition by conv_id order by least(length(code), 4000) desc, idx desc) as place from (
  select conv_id, idx, case when regexp_extract(content, '{_FENCE_ANY}', 1) = '' then 'text' else regexp_extract(content, '{_FENCE_ANY}', 1) end as language,
  {O.trim(f"regexp_extract(content, '{_FENCE_ANY}', 2)")} as code from seeded where regexp_matches(content, '{_FENCE_ANY}')))"""
_F13 = f"""with {_SHORT},{CONVS},{SENT},{_top('ctxs', R.CONTEXT_HINTS, 6)},{_top('decs', R.DECISION_HINTS, 6)},{_top('tsks', R.TASK_HINTS, 4, "role = 'user'")},{_CODE3},
lastu as (select conv_id, left(content, 600) as l from seeded where role = 'user' qualify row_number() over (partition by conv_id order by idx desc) = 1),
lastm as (select conv_id, '**' || role || ':** ' || left(content, 400) || chr(10) || chr(10) as l from seeded qualify row_number() over (partition by conv_id order by idx desc) = 1),
whole as (select c.conv_id, '# Context handoff from ' || upper(platform) || chr(10) || 'Title: ' || title || chr(10) || 'Captured: ' || captured_at || chr(10) || chr(10)
  || 'This goes on from a chat held elsewhere.' || chr(10) || 'Take the points below as known.' || chr(10) || chr(10)
  || coalesce('## Project context' || chr(10) || (select string_agg('- ' || sentence, chr(10) order by place) from ctxs x where x.conv_id = c.conv_id) || chr(10) || chr(10), '')
  || coalesce('## Key decisions' || chr(10) || (select string_agg('- ' || sentence, chr(10) order by place) from decs x where x.conv_id = c.conv_id) || chr(10) || chr(10), '')
  || coalesce('## Open tasks / questions' || chr(10) || (select string_agg('- ' || sentence, chr(10) order by place) from tsks x where x.conv_id = c.conv_id) || chr(10) || chr(10), '')
  || coalesce('## Most recent user message' || chr(10) || (select l from lastu x where x.conv_id = c.conv_id) || chr(10) || chr(10), '')
  || coalesce('## Relevant code' || chr(10) || (select string_agg('```' || language || chr(10) || code || chr(10) || '```' || chr(10), chr(10) order by place) from codes3 x where x.conv_id = c.conv_id and place <= 3) || chr(10), '')
  || '## Recent messages (verbatim)' || chr(10) || (select l from lastm x where x.conv_id = c.conv_id)
  || '## Your job' || chr(10) || 'Acknowledge the handoff in one sentence, then continue helping with the most recent user message above.' as w from convs c)
select conv_id, case when length(w) > 1500 then left(w, 1480) || chr(10) || '...[truncated]' else w end as summary from whole"""


def f14_tag(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.md5(RN.context_tag(F.col("text"))).alias("h"))


def transcript(fmt):
    def run(spark, sf):
        t = seeded_turns(spark, sf)
        return RN.transcript(conversations(t), t, fmt)

    return run


_ESC = "replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"
_K6MD = f"""with {SEEDED},{CONVS} select conv_id, -1 as block, '# ' || title || chr(10) || '**Source:** ' || platform || ' | **URL:** ' || url || chr(10) || '**Captured:** ' || captured_at || ' | **Messages:** ' || turn_count || chr(10) || chr(10) as text from convs
union all select conv_id, idx // 64, string_agg('### ' || case role when 'user' then 'User' when 'assistant' then 'Assistant' else 'System' end || chr(10) || chr(10) || content || chr(10) || chr(10), '' order by idx) from seeded group by all"""
_K6HTML = f"""with {SEEDED},{CONVS} select conv_id, -1 as block, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10) || '<title>' || title || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
  || '<div class="container">' || chr(10) || '<div class="header">' || chr(10) || '<h1>' || title || '</h1>' || chr(10) || '<div class="meta">' || chr(10) || '<span>Platform: ' || platform || '</span>' || chr(10) || '<span>Captured: ' || captured_at
  || '</span>' || chr(10) || '<span>Messages: ' || turn_count || '</span>' || chr(10) || '</div>' || chr(10) || '</div>' || chr(10) as text from convs
union all select conv_id, idx // 64, string_agg('<div class="message ' || role || '">' || chr(10) || '<div class="role ' || role || '"><span class="label ' || role || '">' || role || '</span></div>' || chr(10) || '<div class="content">' || {_ESC} || '</div>' || chr(10) || '</div>' || chr(10), '' order by idx) from seeded group by all
union all select conv_id, 9223372036854775807, '</div>' || chr(10) || '</body>' || chr(10) || '</html>' from convs"""
_K6JSON = f"""with {SEEDED},{CONVS} select conv_id, -1 as block, '{{"title":"' || title || '","platform":"' || platform || '","url":"' || url || '","captured_at":"' || captured_at || '","message_count":' || turn_count || ',"messages":[' as text from convs
union all select conv_id, idx // 64, string_agg(case when idx > 0 then ',' else '' end || '{{"role":"' || role || '","content":' || to_json(content)::varchar || '}}', '' order by idx) from seeded group by all
union all select conv_id, 9223372036854775807, ']}}' from convs"""


def k7_bundle(spark, sf):
    t = seeded_turns(spark, sf)
    conv = conversations(t)
    entries, manifest = RN.bundle(conv, RN.transcript(conv, t, "md"), "md")
    per = entries.groupBy("path").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.octet_length("text")).alias("bytes"))
    total = manifest.select(F.lit("manifest").alias("path"), F.col("conversation_count").alias("parts"), "bytes")
    return per.unionByName(total)


_K7 = f"with k as ({_K6MD}), c as (select 'Chat_' || substr(conv_id, 2) || '-' || conv_id || '.md' as path, count(*) as parts, sum(strlen(text))::bigint as bytes from k group by all) " \
    "select * from c union all select 'manifest', count(*), sum(bytes)::bigint from c"

# -- store --------------------------------------------------------------------------


def _saves(spark, sf):
    """Events as saves of documents: a user's context is saved with every event."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("doc_id"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.col("event_type").alias("kind"), F.col("event_id"),
    )


def _stored(spark, sf):
    s = _saves(spark, sf)
    old, new = s.filter(F.col("kind") != "purchase"), s.filter(F.col("kind") == "purchase")
    return ST.upsert(old, new)


STORED = """saves as (select 'u' || user_id as doc_id, ts, event_type as kind, event_id, (event_type = 'purchase')::int as isnew from events),
born as (select doc_id, min(ts) as b from saves group by doc_id),
stored as (select doc_id, b as created_at, ts as updated_at, kind, event_id from saves join born using (doc_id) qualify row_number() over (partition by doc_id order by isnew desc, ts desc) = 1)"""


def k4_get(spark, sf):
    s = _stored(spark, sf)
    asked = s.select("doc_id").unionByName(s.select(F.concat("doc_id", F.lit("-x")).alias("doc_id")))
    return ST.get(s, asked).select("doc_id", "event_id")


def k4_delete(spark, sf):
    s = _stored(spark, sf)
    gone = s.filter(F.col("event_id") % 2 == 0).select("doc_id").unionByName(s.select(F.lit("nobody").alias("doc_id")).limit(1))
    rest, told = ST.delete(s, gone)
    return rest.select("doc_id", F.lit("kept").alias("state")).unionByName(told.select("doc_id", F.when(F.col("deleted"), "deleted").otherwise("unknown").alias("state")))


def w6_retention(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    return ST.keep_newest(e, 20, [F.col("ts").desc(), F.col("event_id").desc()], ["user_id"]).select("event_id", "user_id")


def w6_conversations(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("conv_id"), F.col("ts").alias("saved_at"), "event_id")
    return ST.keep_latest_conversations(e, 50)


def w7_age(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    return ST.keep_young(e, "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"), 7).select("event_id")


def _history(spark, sf):
    """Turns as versions of their conversation: the text as it grows is committed turn by turn."""
    t = seeded_turns(spark, sf)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("idx") * 3600)
    changes = t.select("conv_id", F.concat(F.lit("turn "), F.col("idx").cast("string")).alias("message"), at.alias("ts"), "content")
    empty = changes.filter(F.lit(False)).select("conv_id", F.lit(0).cast("bigint").alias("version"), "message", "ts", "content")
    return ST.commit(empty, changes)


def w8_history(spark, sf):
    return _history(spark, sf).select("conv_id", "version", "message", ST.is_checkpoint(F.col("version")).alias("is_checkpoint"))


def w8_as_of(spark, sf):
    return ST.as_of(_history(spark, sf), 3).select("conv_id", "version", F.md5("content").alias("h"))


def w8_rollback(spark, sf):
    h = ST.rollback(_history(spark, sf), 1, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return h.groupBy("conv_id").agg(F.max("version").alias("version"), F.md5(F.max_by("content", "version")).alias("h"))


def w8_changes(spark, sf):
    return ST.version_changes(_history(spark, sf))


_W8C = f"""with {SEEDED}, v as (select conv_id, row_number() over (partition by conv_id order by idx) as version, list_distinct(string_split(content, chr(10))) as l from seeded),
j as (select a.*, coalesce(b.l, ['']) as o from v a left join v b on a.conv_id = b.conv_id and a.version = b.version + 1)
select conv_id, version, version = 1 or version % 10 = 0 as is_checkpoint, len(list_filter(l, lambda x: not list_contains(o, x))) as lines_added,
  len(list_filter(o, lambda x: not list_contains(l, x))) as lines_removed from j"""


def f26_fingerprint(spark, sf):
    t = seeded_turns(spark, sf)
    before = t.withColumn("content", F.when((F.col("conv_pos") % 3 == 0) & (F.col("idx") == 0), F.lit("edited")).otherwise(F.col("content")))
    return ST.changed(ST.fingerprint(t), ST.fingerprint(before))


# -- analytics ------------------------------------------------------------------------


def _usage(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    props = F.concat(
        F.lit('{"source":"'), F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")), F.lit('","saved":'),
        F.when(F.col("event_id") % 5 == 0, F.lit('"many"')).otherwise(F.get_json_object("props", "$.k")), F.lit("}"),
    )
    return e.select("event_id", "ts", F.col("event_type").alias("event"), props.alias("properties"))


def a5_daily(spark, sf):
    return AN.daily_counts(_usage(spark, sf), "click", F.lit("2024-01-30 12:00:00").cast("timestamp"), 20)


def a6_sum(spark, sf):
    return AN.sum_property(_usage(spark, sf), "click", "saved")


def a7_top(spark, sf):
    return AN.top_property(_usage(spark, sf), "view", "source", 10)


def _relays(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").filter(F.col("event_type") == "purchase")
    return e.select(F.col("event_id").alias("relay_id"), F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("source"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("message_count"), F.col("ts").alias("at"))


def a8_dashboard(spark, sf):
    limits = spark.read.parquet(f"{sf}/events.parquet").filter(F.col("event_type") == "error")
    return AN.dashboard(_relays(spark, sf), limits)


def a8_by_source(spark, sf):
    return AN.relays_by_source(_relays(spark, sf))


def t5_recent(spark, sf):
    return AN.recent_relays(_relays(spark, sf)).select("relay_id", "source")


def w9_debounce(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    return AN.debounce(e, "user_id", "ts", "event_id", 12 * 3600, windows_per_block=8).select("event_id", "user_id")


_W9 = """with recursive walk(user_id, us, event_id) as (
  select user_id, arg_min(epoch_us(ts), epoch_us(ts)), arg_min(event_id, (epoch_us(ts), event_id)) from events group by user_id
  union all
  select user_id, us, event_id from (select w.user_id, epoch_us(e.ts) as us, e.event_id, row_number() over (partition by w.user_id order by e.ts, e.event_id) as rn
    from walk w join events e on e.user_id = w.user_id and epoch_us(e.ts) >= w.us + 43200000000) where rn = 1)
select event_id, user_id from walk"""

LIMITS = ("You've reached the current usage cap for GPT-4.", "Message limit reached. Try Pro.", "Too  many requests", "已达到今日上限", "quota exceeded, upgrade now", "All is well.")
PLATFORMS = ("chatgpt", "claude", "gemini", "deepseek", "kimi", "poe", "you", "nowhere")


def f22_limits(spark, sf):
    t = seeded_turns(spark, sf)
    said = F.concat("content", F.lit("\n"), F.get(F.array(*[F.lit(x) for x in LIMITS]), ((F.col("conv_pos") + F.col("idx")) % 6).cast("int")))
    on = F.get(F.array(*[F.lit(x) for x in PLATFORMS]), ((F.col("conv_pos") * 5 + F.col("idx")) % 8).cast("int"))
    rows = spread(t.select("turn_id", on.alias("platform"), said.alias("said")), "turn_id")
    return rows.select("turn_id", "platform", PF.limit_message(F.col("platform"), F.col("said")).alias("message")).filter("message is not null")


def _limit_sql():
    arms = []
    for name, patterns in list(PF.LIMIT_TEXTS.items()) + [(n, PF.GENERIC_LIMIT_TEXTS) for n in PF.GENERIC_PLATFORMS]:
        hits = ", ".join(f"nullif(regexp_extract(said, {O.lit('(?i)' + p)}), '')" for p in patterns)
        arms.append(f"when '{name}' then coalesce({hits})")
    return "case platform " + " ".join(arms) + " end"


_F22 = f"""with {SEEDED}, s as (select turn_id, content || chr(10) || [{', '.join(O.lit(x) for x in LIMITS)}][((conv_pos + idx) % 6)::int + 1] as said,
  [{', '.join(O.lit(x) for x in PLATFORMS)}][((conv_pos * 5 + idx) % 8)::int + 1] as platform from seeded)
select turn_id, platform, {_limit_sql()} as message from s where {_limit_sql()} is not null"""


def f23_responses(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    status = F.get(F.array(F.lit(200), F.lit(429), F.lit(403), F.lit(500)), (F.col("event_id") % 4).cast("int"))
    url = F.when(F.col("user_id") % 2 == 0, F.lit("https://x.example/api/chat")).otherwise(F.lit("https://x.example/page"))
    body = F.when(F.col("user_id") % 3 == 0, F.lit("Quota used up")).when(F.col("user_id") % 3 == 1, F.lit("sorry"))
    return e.filter(PF.is_limit_response(status, url, body, "api/|rest/")).select("event_id")


HEADERS = ("6m0s", "1h2m3s", "20ms", "2024-05-01T00:00:00Z", "1.5s", "junk")


def f24_headers(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    reset = F.get(F.array(*[F.lit(h) for h in HEADERS]), (F.col("event_id") % 6).cast("int"))
    left = F.when(F.col("event_id") % 7 == 0, F.lit("none")).otherwise(F.col("user_id").cast("string"))
    headers = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("x-ratelimit-remaining-requests"), left, F.lit("x-ratelimit-reset-requests"), reset)).otherwise(
        F.create_map(F.lit("anthropic-ratelimit-tokens-remaining"), left, F.lit("anthropic-ratelimit-requests-reset"), reset)
    )
    return e.select("event_id", *[c.alias(n) for n, c in PF.limit_headers(headers, F.lit("2024-06-01 00:00:00").cast("timestamp")).items()])


_F24 = """select event_id, case when event_id % 2 = 0 and event_id % 7 <> 0 then user_id end as requests_remaining, case when event_id % 2 = 1 and event_id % 7 <> 0 then user_id end as tokens_remaining,
  case when event_id % 6 = 3 then timestamptz '2024-05-01 00:00:00+00' when event_id % 2 = 1 then null
    when event_id % 6 = 0 then timestamptz '2024-06-01 00:06:00+00' when event_id % 6 = 2 then timestamptz '2024-06-01 00:00:00.02+00' when event_id % 6 = 4 then timestamptz '2024-06-01 00:00:01.5+00' end::timestamp as reset_at from events"""

# -- search -----------------------------------------------------------------------------


@lru_cache(maxsize=16)
def index_of(spark, sf):
    t = seeded_turns(spark, sf)
    return cut(SE.build_index(conversations(t), t))


def _searches(spark, sf):
    """A query per benchmark row: its first word's start, and the start of a seeded phrase's word."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    second = F.get(F.array(F.lit("harv"), F.lit("Tast"), F.lit("sour"), F.lit("")), (F.col("item_id") % 4).cast("int"))
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.lower(F.left("text", F.lit(2))), F.lit(" "), second).alias("query"))


_INDEX = f"""tok as (select distinct field, conv_id, token from (
  select 'title' as field, conv_id, unnest(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}_]+')) as token from convs
  union all select 'content', conv_id, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+')) from seeded) where token <> ''),
qs as (select item_id as query_id, lower(left(text, 2)) || ' ' || ['harv','tast','sour',''][(item_id % 4)::int + 1] as query from benchmark),
terms as (select distinct query_id, term from (select query_id, unnest(regexp_split_to_array(query, '[^\\p{{L}}\\p{{N}}_]+')) as term from qs) where term <> ''),
met as (select query_id, field, conv_id, count(distinct term) as n, count(*) as hits from terms join tok on starts_with(token, term) group by all),
found as (select m.* from met m where n = (select count(*) from terms t where t.query_id = m.query_id))"""


def i1_index(spark, sf):
    return index_of(spark, sf).groupBy("field", "token").agg(F.count(F.lit(1)).alias("n"))


def i2_prefix(spark, sf):
    return SE.prefix_matches(index_of(spark, sf), _searches(spark, sf))


def t6_search(spark, sf):
    return SE.search(index_of(spark, sf), _searches(spark, sf), 5)


def i3_incremental(spark, sf):
    t = seeded_turns(spark, sf)
    conv = conversations(t)
    some = conv.filter(F.col("conv_pos") % 3 == 0)
    gone = conv.filter(F.col("conv_pos") % 3 == 1)
    edited = t.join(some.select("conv_id"), "conv_id", "left_semi").withColumn("content", F.lit("replaced text"))
    now = SE.remove_from_index(SE.add_to_index(index_of(spark, sf), some, edited), gone)
    return now.groupBy("field").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("conv_id").alias("conversations"))


# -- trees and pages --------------------------------------------------------------------


def s6_tree(spark, sf):
    """Each conversation as a tree: every turn hangs below the one before, and every second one has a
    sibling that was regenerated away."""
    t = seeded_turns(spark, sf)
    base = t.select("conv_id", F.col("turn_id").alias("node_id"), F.when(F.col("idx") > 0, F.concat("conv_id", F.lit("_t"), (F.col("idx") - 1).cast("string"))).alias("parent_id"),
                    "role", F.when(F.col("idx") % 4 == 3, F.lit("  ")).otherwise(F.col("content")).alias("content"), "idx")
    spare = base.filter(F.col("idx") % 2 == 1).withColumn("node_id", F.concat("node_id", F.lit("b")))
    heads = base.groupBy("conv_id").agg(F.max_by("node_id", "idx").alias("node_id"))
    nodes = base.unionByName(spare).drop("idx")
    return TR.flatten(nodes, heads).select("conv_id", "node_id", F.col("idx").cast("bigint").alias("idx"), "role")


@lru_cache(maxsize=16)
def _pages(spark, sf):
    return PG.read_pages(spread(spark.read.parquet(f"{sf}/pages.parquet"), "page_id"))


def f20_markdown(spark, sf):
    return _pages(spark, sf).select("page_id", "title", "markdown")


def f20_links(spark, sf):
    """Links of the pages: the tree walk against plain patterns."""
    return _pages(spark, sf).select("page_id", F.explode("links").alias("l")).groupBy("page_id", "l.href").agg(F.count(F.lit(1)).alias("n"))


def f21_parts(spark, sf):
    """Pages with a table and a code block put in, so that both extractors have work."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    extra = F.concat(
        F.lit('<table><tr><th colspan="2">A</th><th>B|C</th></tr><tr><td rowspan="2">'), F.col("page_id").cast("string"),
        F.lit('</td><td>x</td><td>y</td></tr><tr><td>z</td></tr></table><pre><code class="language-py">n = '), F.col("page_id").cast("string"),
        F.lit("<br>m = 2\n</code></pre><p>Use <code>run()</code></p></body>"),
    )
    pages = p.withColumn("html", F.replace("html", F.lit("</body>"), extra))
    read = PG.read_pages(pages)
    tables = PG.page_tables(read).select("page_id", F.col("table").alias("part"))
    code = PG.page_code(read).select("page_id", F.concat_ws(":", "language", "code").alias("part"))
    inline = read.select("page_id", F.explode("inline").alias("part"))
    return tables.unionByName(code).unionByName(inline)


_F21 = """with p as (select page_id from pages where contains(html, '</body>'))
select page_id, '| A | A | B\\|C |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || page_id || ' | x | y |' || chr(10) || '| ' || page_id || ' | z |  |' as part from p
union all select page_id, 'py:n = ' || page_id || chr(10) || 'm = 2' from p union all select page_id, 'run()' from p"""


def s7_items(spark, sf):
    """Items extracted from pages read as turns; the page address ends the text."""
    from turnloom.operators.extract import extract_items

    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    turns = PG.page_turns(_pages(spark, sf)).join(p.withColumnRenamed("page_id", "conv_pos"), "conv_pos")
    turns = turns.withColumn("content", F.concat_ws("\n", "content", "url"))
    return extract_items(turns).filter("type = 'reference'").select(F.col("conv_pos").alias("page_id"), "uri")


def chat_pages(spark, sf):
    """The conversations as web pages of several speakers, marked in different ways; system turns are not marked."""
    t = seeded_turns(spark, sf)
    text = F.replace(F.replace(F.replace("content", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    kind = (F.col("idx") / 2).cast("int") % 2
    mark = (
        F.when((F.col("role") == "user") & (kind == 0), 'data-message-author-role="user"').when(F.col("role") == "user", 'class="row User-Message-7"')
        .when((F.col("role") == "assistant") & (kind == 0), 'data-role="model" class="user"').when(F.col("role") == "assistant", 'data-testid="turn-Assistant"')
        .otherwise('class="note"')
    )
    div = F.concat(F.lit("<section><nav>copy</nav><div "), mark, F.lit("><p>"), text, F.lit("</p><button>Retry</button></div></section>"))
    listed = t.groupBy("conv_pos").agg(F.array_sort(F.collect_list(F.struct("idx", div.alias("d")))).alias("d"))
    body = F.array_join(F.transform("d", lambda x: x["d"]), "\n")
    return listed.select(
        F.col("conv_pos").alias("page_id"), F.lit("https://chat.example/").alias("url"),
        F.concat(F.lit("<html><title>T</title><main class='assistant-message-list'>"), body, F.lit("</main></html>")).alias("html"),
    )


def s7_turns(spark, sf):
    turns = PG.page_turns(PG.read_pages(chat_pages(spark, sf)))
    return turns.select(F.col("conv_pos").alias("page_id"), "idx", "role", F.md5(F.regexp_replace("content", r"\s+", " ")).alias("h"))


_S7 = f"""with {SEEDED} select conv_pos as page_id, (row_number() over (partition by conv_pos order by idx) - 1)::int as idx, role,
  md5(regexp_replace(trim(content, ' ' || chr(10)), '\s+', ' ', 'g')) as h from seeded where role in ('user', 'assistant')"""


def s7_speaker_items(spark, sf):
    from turnloom.operators.extract import extract_items

    items = extract_items(PG.page_turns(PG.read_pages(chat_pages(spark, sf))))
    return items.select(F.col("conv_pos").alias("page_id"), "role", "type", "content")


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _page_sql():
    """The pages use few elements, so plain replacement gives the same text as the tree walk."""
    x = "regexp_replace(html, '(?s)<!DOCTYPE[^>]*>|<head>.*?</head>|<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '<li><a href=\"([^\"]*)\">(.*?)</a></li>', chr(10) || '- [\\2](\\1)', 'g')"
    x = f"replace(replace({x}, '<h1>', chr(10) || chr(10) || '# '), '</h1>', chr(10) || chr(10))"
    x = f"replace(replace(replace({x}, '</article>', repeat('**' || chr(10), open_b)), '<b>', '**'), '<br>', chr(10))"
    x = f"regexp_replace({x}, '</p>|</ul>|</div>', chr(10), 'g')"
    x = f"regexp_replace({x}, '</?(html|body|nav|ul|div|article|p|footer)[^>]*>', '', 'g')"
    for entity, char in _ENTITIES:
        x = f"replace({x}, {O.lit(entity)}, {O.lit(char)})"
    return O.trim(f"regexp_replace(regexp_replace({x}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


_F20 = f"""with b as (select *, (length(html) - length(replace(html, '<b>', ''))) // 3 as open_b from pages)
select page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) as title, {_page_sql()} as markdown from b"""


QUERIES = {
    "k1_assemble": (lambda spark, sf: envelopes(spark, sf), f"with {O.DEDUPED},{CONVS},{ENV} select * from env"),
    "k2_json_fragments": (lambda spark, sf: k2_fragments(spark, sf).select("doc_id", "part", "p1", "p2", "text"), _K2),
    "k3_upsert": (lambda spark, sf: _stored(spark, sf), f"with {STORED} select * from stored"),
    "k4_get": (k4_get, f"with {STORED} select doc_id, event_id from stored union all select doc_id || '-x', null from stored"),
    "k4_delete": (
        k4_delete,
        f"with {STORED} select doc_id, case when event_id % 2 = 0 then 'deleted' else 'kept' end as state from stored union all select 'nobody', 'unknown'",
    ),
    "k5_latest": (lambda spark, sf: ST.latest(_stored(spark, sf)), f"with {STORED} select * from stored order by updated_at desc, doc_id limit 1"),
    "t1_listing": (lambda spark, sf: ST.listing(_stored(spark, sf)).select("doc_id", "updated_at"), f"with {STORED} select doc_id, updated_at from stored"),
    "t4_first_ids": (lambda spark, sf: ST.first_ids(_stored(spark, sf)), f"with {STORED} select doc_id from stored order by updated_at desc, doc_id limit 20"),
    "k6_transcript_md": (transcript("md"), _K6MD),
    "k6_transcript_html": (transcript("html"), _K6HTML),
    "k6_transcript_json": (transcript("json"), _K6JSON),
    "k7_bundle": (k7_bundle, _K7),
    "f7_describe": (
        lambda spark, sf: resolved(spark, sf).select("item_id", I.describe_provenance(F.lit(CAPTURED)).alias("d")),
        f"with {O.DEDUPED},{CONVS} select item_id, c.platform || ' · \"' || c.title || '\" · turn ' || idx || ' (' || role || ') · captured {CAPTURED} · ' || method as d from deduped join convs c using (conv_id) where {_FILTER_SQL}",
    ),
    "f11_markdown": (f11_markdown, _F11),
    "f12_handoff": (f12_handoff, _F12),
    "f25_attribution_notes": (
        f25_notes,
        f"with {O.DEDUPED} select item_id, case when role = 'assistant' then case when type = 'decision' and status = 'proposed' then ' (assistant suggestion, not confirmed by the user)' else ' (stated by the assistant)' end else '' end as note from deduped",
    ),
    "t2_top_sentences": (t2_sentences, f"with {SEEDED},{SENT},{_top('ctxs', R.CONTEXT_HINTS, 6)} select conv_id, place, sentence, score from ctxs"),
    "t3_top_code": (t3_code, f"with {_SHORT},{_CODE3} select conv_id, language, code, place from codes3 where place <= 3"),
    "f13_rule_summary": (f13_summary, _F13),
    "d5_compressors": (d5_compressors, _D5),
    "i2_stored_search": (
        i2_stored,
        "with " + SEEDED + "," + CONVS + "," + _INDEX.replace("select item_id as query_id, lower(left(text, 2)) || ' ' || ['harv','tast','sour',''][(item_id % 4)::int + 1] as query from benchmark",
                                                             "select * from (values " + ", ".join(f"({i}::bigint, {O.lit(q.lower())})" for i, q in enumerate(STORED_QUERIES)) + ") v(query_id, query)")
        + " select query_id, field, conv_id, hits from found",
    ),
    "f14_context_tag": (
        f14_tag,
        "select doc_id, md5('<context>' || chr(10) || case when length(text) > 2000 then left(text, 2000) || chr(10) || '...[truncated]' else text end || chr(10) || '</context>') as h from documents",
    ),
    "w6_retention_per_key": (w6_retention, "select event_id, user_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 20"),
    "w6_latest_conversations": (
        w6_conversations,
        "select user_id as conv_id, ts as saved_at, event_id from (select * from events qualify row_number() over (partition by user_id order by ts desc) = 1) order by ts desc, user_id limit 50",
    ),
    "w7_retention_by_age": (w7_age, "select event_id from events where ts >= timestamp '2024-01-23 00:00:00'"),
    "w8_versions": (w8_history, f"with {SEEDED} select conv_id, row_number() over (partition by conv_id order by idx) as version, 'turn ' || idx as message, row_number() over (partition by conv_id order by idx) in (1, 10) as is_checkpoint from seeded"),
    "w8_as_of": (w8_as_of, f"with {SEEDED}, v as (select *, row_number() over (partition by conv_id order by idx) as version from seeded) select conv_id, version, md5(content) as h from v where version <= 3 qualify row_number() over (partition by conv_id order by version desc) = 1"),
    "w8_rollback": (w8_rollback, f"with {SEEDED} select conv_id, count(*) + 1 as version, md5(arg_min(content, idx)) as h from seeded group by conv_id"),
    "w8_changes": (w8_changes, _W8C),
    "w9_debounce": (w9_debounce, _W9),
    "f26_fingerprint": (f26_fingerprint, f"with {SEEDED} select distinct conv_id from seeded where conv_pos % 3 = 0"),
    "a5_daily_counts": (a5_daily, "select ts::date as day, count(*) as n from events where event_type = 'click' and ts >= timestamp '2024-01-11' group by 1"),
    "a6_property_sum": (a6_sum, "select sum(json_extract_string(props, '$.k')::double) as total from events where event_type = 'click' and event_id % 5 <> 0"),
    "a7_top_sources": (a7_top, "select 'p' || (user_id % 12) as source, count(*) as n from events where event_type = 'view' group by 1 order by n desc, source limit 10"),
    "a8_dashboard": (
        a8_dashboard,
        "select count(*) filter (where event_type = 'purchase') as total_relays, (sum(json_extract_string(props, '$.k')::bigint) filter (where event_type = 'purchase'))::bigint as total_messages, "
        "max(ts) filter (where event_type = 'purchase') as last_relay_at, count(*) filter (where event_type = 'error') as rate_limits, "
        "(100 * sum(json_extract_string(props, '$.k')::bigint) filter (where event_type = 'purchase'))::bigint as tokens_saved from events",
    ),
    "a8_relays_by_source": (a8_by_source, "select 'p' || (user_id % 12) as source, count(*) as relays from events where event_type = 'purchase' group by 1"),
    "t5_recent_relays": (t5_recent, "select event_id as relay_id, 'p' || (user_id % 12) as source from events where event_type = 'purchase' order by ts desc, event_id desc limit 5"),
    "f22_limit_texts": (f22_limits, _F22),
    "f23_limit_responses": (
        f23_responses,
        "select event_id from events where (event_id % 4 = 1 and user_id % 2 = 0) or (event_id % 4 in (1, 2) and user_id % 3 = 0)",
    ),
    "f24_limit_headers": (f24_headers, _F24),
    "i1_index": (i1_index, f"with {SEEDED},{CONVS},{_INDEX} select field, token, count(*) as n from tok group by all"),
    "i2_prefix_matches": (i2_prefix, f"with {SEEDED},{CONVS},{_INDEX} select query_id, field, conv_id, hits from found"),
    "t6_u4_search": (
        t6_search,
        f"with {SEEDED},{CONVS},{_INDEX} select distinct query_id, conv_id from (select * from found qualify row_number() over (partition by query_id, field order by hits desc, conv_id) <= 5)",
    ),
    "i3_incremental_index": (
        i3_incremental,
        f"with {SEEDED},{CONVS},{_INDEX}, n as (select t.* from tok t join convs c using (conv_id) where conv_pos % 3 = 2 union all "
        "select field, t.conv_id, token from tok t join convs c using (conv_id) where conv_pos % 3 = 0 and field = 'title' union all "
        "select 'content', conv_id, unnest(['replaced', 'text']) from convs where conv_pos % 3 = 0) select field, count(*) as postings, count(distinct conv_id) as conversations from n group by field",
    ),
    "s6_message_tree": (
        s6_tree,
        f"with {SEEDED} select conv_id, turn_id as node_id, row_number() over (partition by conv_id order by idx) - 1 as idx, role from seeded where role in ('user','assistant') and idx % 4 <> 3",
    ),
    "f20_page_markdown": (f20_markdown, _F20),
    "f20_page_links": (
        f20_links,
        "select page_id, href, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages) group by all",
    ),
    "f21_page_parts": (f21_parts, _F21),
    "s7_speaker_turns": (s7_turns, _S7),
    "s7_speaker_items": (s7_speaker_items, f"with {O.ITEMS} select conv_pos as page_id, role, type, content from items where role in ('user', 'assistant')"),
    "s7_page_items": (
        s7_items, f"select page_id, regexp_replace(regexp_extract(url, {O.lit(R.BARE_URL)}), '[.,;:!?]+$', '') as uri from pages"
    ),
}
