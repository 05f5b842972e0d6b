"""Queries over selection, platform, text and safety operators (P, F families, A14, J12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import media, platform as PF, secrets
from turnloom.functions import text as X
from turnloom.operators import safety, selection as SEL
from turnloom.plans import oracle as O
from turnloom.plans.extraction import stored_items, items_of
from turnloom.plans.seeded import CONVS, SEEDED, conversations, documents, seeded_turns
from turnloom.sources import turns as ST

# Selection texts picked by arithmetic: good, reversed, below one, malformed, empty, spaced.
EXPRS = ("1,3-4", "2", "4-2", "0,1", "x,1", " , ", "1-2, 2-3", "9-12")


def _selections(spark, sf):
    conv = conversations(seeded_turns(spark, sf))
    table = F.array(*[F.lit(e) for e in EXPRS])
    return conv.select("conv_id", F.get(table, (F.col("conv_pos") % 8).cast("int")).alias("selection"))


_SEL = f"""selections as (select conv_id, {'[' + ', '.join(O.lit(e) for e in EXPRS) + ']'}[(conv_pos % 8)::int + 1] as selection from convs),
parts as (select conv_id, unnest(string_split(selection, ',')) as raw, generate_subscripts(string_split(selection, ','), 1) - 1 as part from selections),
coded as (select conv_id, part, regexp_extract(trim(raw), '^([0-9]+)', 1) as lo,
    coalesce(nullif(regexp_extract(trim(raw), '-([0-9]+)$', 1), ''), regexp_extract(trim(raw), '^([0-9]+)', 1)) as hi,
    regexp_full_match(trim(raw), '[0-9]+(-[0-9]+)?') as ok from parts where trim(raw) <> ''),
judged as (select *, case when not ok then 'bad_part' when lo::int < 1 then 'below_one' when hi::int < lo::int then 'reversed' end as code from coded),
errs as (select conv_id, part, code from judged where code is not null
  union all select conv_id, 0, 'empty' from selections where conv_id not in (select conv_id from judged)),
chosen as (select distinct conv_id, unnest(range(lo::int - 1, hi::int)) as pos from judged where conv_id not in (select conv_id from errs))"""


def p1_parse(spark, sf):
    return SEL.positions(SEL.parse_selection(_selections(spark, sf))[0])


def p1_errors(spark, sf):
    return SEL.parse_selection(_selections(spark, sf))[1].select("conv_id", F.col("part").cast("bigint").alias("part"), "code")


def p2_strict(spark, sf):
    chosen, _ = SEL.parse_selection(_selections(spark, sf))
    return SEL.select_turns(seeded_turns(spark, sf), chosen)[0].select("conv_id", "turn_id", "idx", "content")


def p2_out_of_range(spark, sf):
    chosen, _ = SEL.parse_selection(_selections(spark, sf))
    return SEL.positions(SEL.select_turns(seeded_turns(spark, sf), chosen)[1]).select("conv_id", "pos")


def p3_lenient(spark, sf):
    chosen, _ = SEL.parse_selection(_selections(spark, sf))
    kept, empty = SEL.select_turns_lenient(seeded_turns(spark, sf), chosen)
    return kept.select("conv_id", "turn_id").unionByName(empty.select("conv_id", F.lit("EMPTY").alias("turn_id")))


def p4_items(spark, sf):
    """Every document asks for its constraints; one in three also for an id it does not have."""
    items = stored_items(spark, sf)
    wanted = items.filter(F.col("type") == "constraint").select("doc_id", "item_id")
    third = items.select("doc_id").distinct().filter(F.substring("doc_id", 2, 9).cast("int") % 3 == 0)
    wanted = wanted.unionByName(third.withColumn("item_id", F.lit("itm_missing")))
    notes = items.select("item_id", "origin", "assertion")
    edges = items.filter(F.col("type") == "constraint").groupBy("doc_id").agg(
        F.min("item_id").alias("from"), F.max("item_id").alias("to")
    ).withColumn("type", F.lit("conflicts_with"))
    kept, n, e, unknown = SEL.select_items(items, notes, edges, wanted)
    tag = lambda df, what: df.groupBy().agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(what))
    return tag(kept, "items").unionByName(tag(n, "annotations")).unionByName(tag(e, "relations")).unionByName(tag(unknown, "unknown"))


_P4 = f"""with {O.DEDUPED},
bad as (select distinct doc_id from deduped where substr(doc_id, 2)::int % 3 = 0),
kept as (select * from deduped where type = 'constraint' and doc_id not in (select doc_id from bad))
select 'items' as what, count(*) as n from kept union all select 'annotations', count(*) from kept
union all select 'relations', count(distinct doc_id) from kept union all select 'unknown', count(*) from bad"""


def u5_unknown_ids(spark, sf):
    """Asked ids a document does not have."""
    items = stored_items(spark, sf)
    asked = items.select("doc_id", F.when((F.col("conv_pos") + F.col("idx")) % 4 == 0, F.concat("item_id", F.lit("x"))).otherwise(F.col("item_id")).alias("item_id"))
    notes = items.select("item_id", "origin")
    none = items.select(F.lit("t").alias("type"), F.col("item_id").alias("from"), F.col("item_id").alias("to")).filter(F.lit(False))
    return SEL.select_items(items, notes, none, asked)[3]


_U5 = f"with {O.DEDUPED} select doc_id, item_id || 'x' as item_id from deduped where (conv_pos + idx) % 4 = 0"


def j12_review(spark, sf):
    t = seeded_turns(spark, sf)
    chosen = t.filter(F.col("idx") < 2).select("conv_id", F.col("idx").cast("bigint").alias("pos"))
    totals = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    # drafts drift by arithmetic: one conversation in three was reviewed with one more turn
    more = t.filter((F.col("idx") < 2) | ((F.col("idx") == 2) & (F.col("conv_pos") % 3 == 0)))
    size = F.col("total") + F.when(F.col("conv_pos") % 5 == 0, F.lit(1)).otherwise(F.lit(0))
    meta = more.join(totals, "conv_id").select("conv_id", F.col("idx").cast("bigint").alias("pos"), size.alias("total"))
    return SEL.review_mismatch(more.select("conv_id", "idx"), meta, chosen, totals)


_J12 = f"""with {SEEDED}, c as (select conv_id, conv_pos, count(*) as total from seeded group by all),
more as (select conv_id from c where conv_pos % 3 = 0 and total > 2)
select conv_id, 'selection_changed' as code from more union all select conv_id, 'stray_turn' from more
union all select conv_id, 'total_changed' from c where conv_pos % 5 = 0"""


def p7_search(spark, sf):
    return seeded_turns(spark, sf).filter(SEL.matches_query(F.col("content"), F.lit("  SERVICE sync "))).select("turn_id")


def p8_preview(spark, sf):
    t = seeded_turns(spark, sf)
    return t.select("turn_id", SEL.preview(F.col("content")).alias("preview"), SEL.is_long(F.col("content")).alias("long"))


_FLAT = O.trim(
    "regexp_replace(regexp_replace(regexp_replace(content, '(?s)```([A-Za-z0-9_+#-]+)[^\\n]*\\n.*?```', ' [\\1 block] ', 'g'), "
    "'(?s)```[^\\n]*\\n.*?```', ' [code block] ', 'g'), " + O.lit(O.WS + "+") + ", ' ', 'g')"
)

TIMES = ("2025-01-02T03:04:05Z", "2025-02-30T00:00:00Z", "2025-01-02 03:04:05", "soon", "2025-01-02T03:04:05+02:00", "")


def p9_timestamps(spark, sf):
    conv = conversations(seeded_turns(spark, sf))
    table = F.array(*[F.lit(t) for t in TIMES])
    given = conv.select("conv_id", F.get(table, (F.col("conv_pos") % 6).cast("int")).alias("given"))
    fixed, repaired = ST.repair_timestamp(F.col("given"), F.lit("2025-06-01T00:00:00.000Z"))
    return given.select("conv_id", fixed.alias("captured_at"), repaired.alias("repaired"))


_P9 = f"""with {SEEDED},{CONVS}, g as (select conv_id, [{', '.join(O.lit(t) for t in TIMES)}][(conv_pos % 6)::int + 1] as given from convs)
select conv_id, case when given in ('2025-01-02T03:04:05Z', '2025-01-02T03:04:05+02:00') then given
  when given = '2025-01-02 03:04:05' then '2025-01-02T03:04:05.000Z' else '2025-06-01T00:00:00.000Z' end as captured_at,
  given not in ('2025-01-02T03:04:05Z', '2025-01-02T03:04:05+02:00') as repaired from g"""


def p10_code(spark, sf):
    """Each turn is offered two copies of a block and the fence it may already hold."""
    t = seeded_turns(spark, sf)
    block = lambda lang, code: F.struct(F.lit(lang).alias("language"), F.lit(code).alias("code"))
    blocks = F.array(block("ts", "export const r = 1;\n"), block("py", "x = 1"), block("", "x = 1\n"), block("sh", " \n"))
    return t.select("turn_id", ST.append_missing_code(F.col("content"), blocks).alias("content"))


_P10 = f"""with {SEEDED}, a as (select turn_id, case when contains(content, 'export const r = 1;') then content
  else content || chr(10) || chr(10) || '```ts' || chr(10) || 'export const r = 1;' || chr(10) || '```' end as content from seeded)
select turn_id, case when contains(content, 'x = 1') then content
  else content || chr(10) || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || '```' end as content from a"""


def p11_attachments(spark, sf):
    t = seeded_turns(spark, sf)
    url = F.concat(F.element_at(F.array(F.lit("data:x,"), F.lit("https://f.example/"), F.lit("BLOB:")), (F.col("idx") % 3 + 1).cast("int")), "turn_id")
    one = F.struct(
        url.alias("url"), F.lit("image").alias("type"), F.concat("turn_id", F.lit(".png")).alias("name"), F.lit("image/png").alias("mimeType"),
        F.when(F.col("idx") % 2 == 0, F.lit("data:abc")).alias("dataUrl"),
    )
    rows = t.select("turn_id", F.array(one).alias("att"))
    return rows.select(
        "turn_id", ST.project_attachments(F.col("att"))[0].alias("a"), ST.dropped_inline(F.col("att")).cast("bigint").alias("dropped")
    ).select("turn_id", "a.kind", "a.name", "a.media_type", "a.uri", "dropped")


_P11 = f"""with {SEEDED} select turn_id, 'image' as kind, turn_id || '.png' as name, 'image/png' as media_type,
  case when idx % 3 = 1 then 'https://f.example/' || turn_id end as uri, (idx % 2 = 0)::bigint as dropped from seeded"""

HOSTS = [
    "https://chat.openai.com/c/", "https://claude.ai/chat/", "https://thankyou.com/", "https://x.com/i/grok/", "https://huggingface.co/chat/",
    "https://chat.mistral.ai/", "https://mistral.ai/", "https://www.poe.com/", "https://example.org/pi.ai/", "",
]


def _urls(spark, sf):
    """Page addresses re-hosted on chat sites by arithmetic."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    table = F.array(*[F.lit(h) for h in HOSTS])
    host = F.get(table, (F.col("page_id") % 10).cast("int"))
    return p.select("page_id", F.when(host == "", F.col("url")).otherwise(F.concat(host, F.col("page_id").cast("string"))).alias("url"))


_URLS = f"""urls as (select page_id, case when h = '' then url else h || page_id end as url
  from (select *, [{', '.join(O.lit(h) for h in HOSTS)}][(page_id % 10)::int + 1] as h from pages))"""
_SITE_CASE = "case " + " ".join(f"when regexp_matches(url, {O.lit(p)}) then '{n}'" for n, p in PF.SITES) + " else 'unknown' end"


def p12_platform(spark, sf):
    return _urls(spark, sf).select("page_id", PF.platform_of(F.col("url")).alias("platform"), PF.platform_of(F.col("url"), strict=True).alias("strict"))


_STRICT_CASE = (
    "case "
    + " ".join(f"when regexp_matches(url, {O.lit('^https?://([A-Za-z0-9-]+[.])*(' + p + ')([/?#:]|$)')}) then '{n}'" for n, p in PF.SITES)
    + " else 'unknown' end"
)


def p13_best(spark, sf):
    return _urls(spark, sf).select("page_id", PF.platform_by_score(F.col("url")).alias("platform"))


_SCORES = ", ".join(f"({i}, '{n}', {O.lit(p)}, {PF.pattern_score(p)})" for i, (n, ps) in enumerate(PF.SCORED_SITES) for p in ps)
_P13 = f"""with {_URLS}, pats(o, name, pat, score) as (values {_SCORES}),
hits as (select page_id, name from urls join pats on regexp_matches(url, replace(pat, '\\/', '/'))
  qualify row_number() over (partition by page_id order by score desc, o) = 1)
select page_id, coalesce(name, 'unknown') as platform from urls left join hits using (page_id)"""


def p14_targets(spark, sf):
    u = _urls(spark, sf).select("page_id", PF.platform_of(F.col("url")).alias("platform"))
    return u.select("page_id", F.explode(PF.other_targets(F.col("platform"))).alias("target"))


_P14 = f"""with {_URLS}, u as (select page_id, {_SITE_CASE} as platform from urls)
select page_id, target from u, (select unnest([{', '.join(O.lit(t) for t in PF.TARGETS)}]) as target) where target <> platform"""


def p15_key(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").withColumn("title", F.concat(F.lit("t"), F.col("page_id").cast("string")))
    return p.select("page_id", ST.conversation_key(F.lit("web"), F.col("url"), F.lit("2025-01-01T00:00:00Z"), F.col("title")).alias("conv_id"))


_P15 = f"""select page_id, case when length(regexp_replace(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')) > 0
  then {O.stable_id('conv', "'web'", "split_part(url, '#', 1)")}
  else {O.stable_id('conv', "'web'", 'url', "'2025-01-01T00:00:00Z'", "'t' || page_id")} end as conv_id from pages"""


def p16_title(spark, sf):
    t = seeded_turns(spark, sf)
    conv = conversations(t)
    raw = F.when(F.col("conv_pos") % 3 == 0, F.concat("title", F.lit(" - Some Site"))).when(F.col("conv_pos") % 3 == 1, F.col("title"))
    titles = conv.select("conv_id", ST.clean_title(raw).alias("title"))
    return SEL.title_or_first_message(t, titles).select("conv_id", "title")


_P16 = f"""with {SEEDED},{CONVS}, f as (select conv_id, left({O.trim('content')}, 80) as first from seeded where role = 'user'
  qualify row_number() over (partition by conv_id order by idx) = 1)
select conv_id, case when conv_pos % 3 < 2 then title else coalesce(nullif(first, ''), 'Conversation') end as title from convs left join f using (conv_id)"""


def _secret_turns(spark, sf):
    """Documents as one-turn conversations of their source, so that findings exist."""
    d = documents(spark, sf)
    return d.select(
        F.col("source").alias("doc_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("conv_id"), F.lit(0).alias("idx"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_t0")).alias("turn_id"), F.col("text").alias("content"),
    )


def f9_scan(spark, sf):
    return safety.scan_table(_secret_turns(spark, sf), ["turn_id"], "content").groupBy("turn_id", "type", "confidence", "preview").agg(
        F.count(F.lit(1)).alias("n")
    )


def _scan_sql():
    out = []
    for kind, conf, pattern, floor in secrets.PATTERNS:
        gate = ""
        if floor:
            gate = (
                f" where (select -sum(p * log2(p)) from (select count(*)::double / length(v) as p from "
                f"(select unnest(string_split(v, '')) as ch) group by ch)) >= {floor}"
            )
        out.append(
            f"select turn_id, source, v, '{kind}' as type, '{conf}' as confidence from (select turn_id, source, "
            f"unnest(regexp_extract_all(text, {O.lit(pattern)}, 1)) as v from doc_turns){gate}"
        )
    return "doc_turns as (select 'doc' || doc_id || '_t0' as turn_id, source, text from documents), found as (" + " union all ".join(out) + ")"


_PREVIEW = "case when length(v) >= 8 then left(v, 4) || '…' else '…' end"


def f10_redact(spark, sf):
    t = _secret_turns(spark, sf)
    return t.select("turn_id", F.md5(secrets.redact_text(F.col("content"))).alias("redacted"))


_ASSIGNED = r"(?i)((?:token|secret|password|passwd|api_?key)[\"']?[ \t]*[:=][ \t]*[\"'])([^\"'\n \t]{12,})([\"'])"


def a14_report(spark, sf):
    t = _secret_turns(spark, sf)
    loose = t.filter(F.lit(False)).select("doc_id", F.lit(None).cast("string").alias("item_id"), "turn_id", "content")
    return safety.safety_report(safety.scan_document(t, loose))


def p17_gate(spark, sf):
    t = _secret_turns(spark, sf)
    found = safety.scan_table(t, ["conv_id", "idx"], "content")
    sent, held = SEL.secret_gate(t, found, remote=True)
    a = sent.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("sent"))
    return a.unionByName(held.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("held")))


def p18_size(spark, sf):
    t = seeded_turns(spark, sf)
    return SEL.size_gate(t, 1500)[1].select("conv_id", "code")


def f1_normalise(spark, sf):
    return seeded_turns(spark, sf).select("turn_id", F.md5(X.dedupe_form(F.col("content"))).alias("h"))


def f2_ids(spark, sf):
    return items_of(spark, sf).select("turn_id", "item_id", "type")


def f3_tokens(spark, sf):
    return seeded_turns(spark, sf).select("turn_id", X.token_estimate(F.col("content")).alias("tokens"))


def f4_clean(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("h"))


def f5_quotes(spark, sf):
    t = seeded_turns(spark, sf)
    quoted = F.concat(F.lit(" “…"), F.left("content", F.lit(60)), F.lit("...”"))
    return t.select("turn_id", X.clean_quote(quoted).alias("clean"), X.fold(quoted).alias("folded"))


_Q_IN = "(' “…' || left(content, 60) || '...”')"
_CLEAN_Q = O.trim(
    f"regexp_replace(regexp_replace({O.trim(_Q_IN)}, {O.lit('^[' + X._QUOTE_MARKS + ']+|[' + X._QUOTE_MARKS + ']+$')}, '', 'g'), "
    + O.lit("^(?:\\.\\.\\.|…)" + O.WS + "*|" + O.WS + "*(?:\\.\\.\\.|…)$") + ", '', 'g')"
)


def f6_locate(spark, sf):
    """A quote with other case, spacing and quote marks is found at its original offsets."""
    t = seeded_turns(spark, sf)
    words = F.regexp_replace(F.substring("content", 11, 40), "\n", " ")
    quote = F.when(F.col("idx") % 3 == 0, words).when(F.col("idx") % 3 == 1, F.translate(F.regexp_replace(words, " ", "  "), "abcdefghij", "ABCDEFGHIJ")).otherwise(F.lit("not in here at all"))
    span = X.locate_quote(F.col("content"), quote)
    return t.select("turn_id", span.alias("s")).select("turn_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


_F6 = f"""with {SEEDED}, q as (select *, {O.trim("replace(substr(content, 11, 40), chr(10), ' ')")} as w from seeded),
f as (select *,
  case when idx % 3 = 0 then strpos(content, w) else 0 end as exact,
  strpos(lower(replace(content, chr(10), ' ')), lower(w)) as loose from q)
select turn_id, case when idx % 3 = 2 or length(w) < 2 then null when exact > 0 then exact - 1 when loose > 0 then loose - 1 end as start_at,
  case when idx % 3 = 2 or length(w) < 2 then null when exact > 0 then exact - 1 + length(w) when loose > 0 then loose - 1 + length(w) end as end_at from f"""


def f8_fence(spark, sf):
    t = seeded_turns(spark, sf)
    return t.select("turn_id", F.left(X.fence(F.col("content"), F.lit("md")), F.lit(8)).alias("head"))


def f17_latex(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.explode(media.latex(F.col("text"))).alias("m")).groupBy("doc_id", "m.display", "m.latex").agg(F.count(F.lit(1)).alias("n"))


_F17 = f"""with hits as (
  select doc_id, true as display, unnest(regexp_extract_all(text, '(?s)\\\\\\[(.*?)\\\\\\]', 1)) as m from documents
  union all select doc_id, false, unnest(regexp_extract_all(regexp_replace(text, '(?s)\\\\\\[(.*?)\\\\\\]', ' ', 'g'), '(?s)\\\\\\((.*?)\\\\\\)', 1)) from documents
  union all select doc_id, true, unnest(regexp_extract_all(text, '(?s)\\$\\$(.*?)\\$\\$', 1)) from documents
  union all select doc_id, false, unnest(regexp_extract_all(text, '\\$(\\\\[a-zA-Z]+.*?)\\$', 1)) from documents)
select doc_id, display, {O.trim('m')} as latex, count(*) as n from hits group by all"""

NAMES = ("a.PNG", "b.tar.zip", "c.tsx", "noext", "d.unknown", "e.md")
SIZES = ("2.3 MB", "12 kb", "7B", "about 1.5 GB", "none", "0.4 KB")


def f18_maps(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % len(values)).cast("int"))
    langs = F.get(F.array(*[F.lit(v) for v in ("Python", "c++", "Makefile", "brainf", "", "text")]), (F.col("page_id") % 6).cast("int"))
    return p.select(
        "page_id", media.mime_type(pick(NAMES)).alias("mime"), media.parse_size(pick(SIZES)).alias("bytes"), media.language_extension(langs).alias("extension")
    )


_F18 = """select page_id, ['image/png','application/zip','text/typescript',null,null,'text/markdown'][(page_id % 6)::int + 1] as mime,
  [2411725, 12288, 7, 1610612736, null, 410][(page_id % 6)::int + 1]::bigint as bytes, ['py','cpp','Makefile','txt','txt','txt'][(page_id % 6)::int + 1] as extension from pages"""


def f19_assets(spark, sf):
    d = documents(spark, sf)
    return d.groupBy(media.asset_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def a15_sizes(spark, sf):
    d = documents(spark, sf)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("assets"), F.sum(F.octet_length("text")).alias("bytes"))


BODY = "Hi {{name}}, {{ topic }} {{topic: chat about {x}}} in {{ name:x}} {{place:here}} {{name}}"


def _templates(spark, sf):
    t = conversations(seeded_turns(spark, sf))
    body = F.concat(F.lit("Hi {{name}}, {{topic: the weather}} in {{place:}}{{other}} "), F.col("title"))
    values = F.when(F.col("conv_pos") % 2 == 0, F.create_map(F.lit("name"), F.lit("{{topic}}"))).otherwise(F.create_map(F.lit("place"), F.col("title")))
    return t.select("conv_id", body.alias("body"), values.alias("v"))


def f15_templates(spark, sf):
    t = _templates(spark, sf)
    names = F.array_join(F.transform(media.template_variables(F.col("body")), lambda x: F.concat_ws("=", x["name"], x["default"])), ",")
    return t.select("conv_id", media.render_template(F.col("body"), F.col("v")).alias("text"), names.alias("variables"))


_F15 = f"""with {SEEDED},{CONVS} select conv_id, case when conv_pos % 2 = 0 then 'Hi {{{{topic}}}}, the weather in {{{{other}}}} ' || title
  else 'Hi {{{{name}}}}, the weather in ' || title || '{{{{other}}}} ' || title end as text, 'name,topic=the weather,place,other' as variables from convs"""


def f16_templates(spark, sf):
    t = seeded_turns(spark, sf)
    used = t.groupBy(F.col("role").alias("category"), F.concat(F.lit("tpl"), F.col("idx").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("usage_count"))
    return used.filter(F.col("category") == "user").orderBy(F.col("usage_count").desc(), "name")


QUERIES = {
    "p1_parse_selection": (p1_parse, f"with {SEEDED},{CONVS},{_SEL} select conv_id, pos from chosen"),
    "p1_selection_errors": (p1_errors, f"with {SEEDED},{CONVS},{_SEL} select conv_id, part, code from errs"),
    "p2_select_turns": (
        p2_strict,
        f"with {SEEDED},{CONVS},{_SEL}, miss as (select conv_id from chosen where (conv_id, pos) not in (select (conv_id, idx) from seeded)) "
        "select s.conv_id, turn_id, idx, content from seeded s join chosen c on c.conv_id = s.conv_id and c.pos = s.idx where s.conv_id not in (select conv_id from miss)",
    ),
    "p2_out_of_range": (
        p2_out_of_range, f"with {SEEDED},{CONVS},{_SEL} select conv_id, pos from chosen c where not exists (select 1 from seeded s where s.conv_id = c.conv_id and s.idx = c.pos)"
    ),
    "p3_select_lenient": (
        p3_lenient,
        f"with {SEEDED},{CONVS},{_SEL}, k as (select s.conv_id, turn_id from seeded s join chosen c on c.conv_id = s.conv_id and c.pos = s.idx) "
        "select * from k union all select distinct conv_id, 'EMPTY' from chosen where conv_id not in (select conv_id from k)",
    ),
    "p4_select_items": (p4_items, _P4),
    "p7_message_search": (
        p7_search, f"with {SEEDED} select turn_id from seeded where contains(lower(content), 'service') and contains(lower(content), 'sync')"
    ),
    "p8_preview": (
        p8_preview,
        f"""with {SEEDED}, f as (select *, {_FLAT} as flat from seeded) select turn_id, case when length(flat) > 220
  then regexp_replace(left(flat, 220), {O.lit(O.WS + '+$')}, '') || '…' else flat end as preview,
  length(flat) > 220 or length(content) - length(replace(content, chr(10), '')) > 3 or contains(content, '```') as long from f""",
    ),
    "p9_timestamp_repair": (p9_timestamps, _P9),
    "p10_missing_code": (p10_code, _P10),
    "p11_attachments": (p11_attachments, _P11),
    "p12_platform": (p12_platform, f"with {_URLS} select page_id, {_SITE_CASE} as platform, {_STRICT_CASE} as strict from urls"),
    "p13_platform_score": (p13_best, _P13),
    "p14_targets": (p14_targets, _P14),
    "p15_conversation_key": (p15_key, _P15),
    "p16_titles": (p16_title, _P16),
    "p17_secret_gate": (
        p17_gate,
        f"with {_scan_sql()} select 'held' as what, count(distinct turn_id) as n from found union all select 'sent', (select count(*) from documents) - count(distinct turn_id) from found",
    ),
    "p18_size_gate": (
        p18_size,
        f"""with {SEEDED}, s as (select conv_id, sum(length(json_object('ref', 'm', 'role', role, 'content', content)::varchar) + 8) as n from seeded group by conv_id)
select conv_id, 'input_too_large' as code from s where n > 1500""",
    ),
    "u5_unknown_ids": (u5_unknown_ids, _U5),
    "j12_review_check": (j12_review, _J12),
    "f1_dedupe_form": (f1_normalise, f"with {SEEDED} select turn_id, md5({O.norm('content')}) as h from seeded"),
    "f2_stable_ids": (f2_ids, f"with {O.ITEMS} select turn_id, item_id, type from items"),
    "f3_token_estimate": (f3_tokens, f"with {SEEDED} select turn_id, ceil(length(content) / 4.0)::bigint as tokens from seeded"),
    "f4_clean_text": (
        f4_clean,
        "select doc_id, md5(" + O.trim("regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')") + ") as h from documents",
    ),
    "f5_quote_folding": (
        f5_quotes,
        f"with {SEEDED} select turn_id, {_CLEAN_Q} as clean, "
        + O.trim(f"regexp_replace(lower(translate({_Q_IN}, {O.lit(X.FOLD_FROM)}, {O.lit(X.FOLD_TO)})), {O.lit(O.WS + '+')}, ' ', 'g')")
        + " as folded from seeded",
    ),
    "f6_locate_quote": (f6_locate, _F6),
    "f8_fence": (f8_fence, f"with {SEEDED} select turn_id, case when contains(content, '```') then '````md' || chr(10) || left(content, 1) else '```md' || chr(10) || left(content, 2) end as head from seeded"),
    "f9_secret_scan": (
        f9_scan, f"with {_scan_sql()} select turn_id, type, confidence, {_PREVIEW} as preview, count(*) as n from found group by all"
    ),
    "f10_redact": (
        f10_redact,
        "select 'doc' || doc_id || '_t0' as turn_id, md5(regexp_replace(text, " + O.lit(_ASSIGNED) + ", '\\1[REDACTED:Generic Secret]\\3', 'g')) as redacted from documents",
    ),
    "f15_templates": (f15_templates, _F15),
    "f16_template_usage": (
        f16_templates, f"with {SEEDED} select role as category, 'tpl' || idx as name, count(*) as usage_count from seeded where role = 'user' group by all"
    ),
    "f17_latex": (f17_latex, _F17),
    "f18_media_maps": (f18_maps, _F18),
    "f19_asset_keys": (
        f19_assets, "select md5(left(text, 50) || right(text, 50) || length(text)) as key, min(doc_id) as doc_id, count(*) as copies from documents group by 1"
    ),
    "a14_safety_report": (
        a14_report,
        f"with {_scan_sql()} select doc_id, type, confidence, findings, findings || ' possible ' || type || ' (' || confidence || ' confidence)' as warning from "
        "(select source as doc_id, type, confidence, count(*) as findings from found group by all)",
    ),
    "a15_asset_sizes": (a15_sizes, "select source, count(*) as assets, sum(strlen(text))::bigint as bytes from documents group by source"),
}
