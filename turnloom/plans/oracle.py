"""SQL fragments of the checking engine for the extraction chain.

Written independently of the operators: plain relational SQL over lines and
pieces, no arrays of structs and no folds.
"""

from __future__ import annotations

from turnloom.functions import rules as R
from turnloom.functions.text import WS, re2_words
from turnloom.plans.seeded import SEEDED


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit('(?i)' + re2_words(pattern))})"


def trim(column: str) -> str:
    return f"regexp_replace({column}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def norm(column: str) -> str:
    """Key of a statement for de-duplication."""
    inner = f"regexp_replace(replace(lower({column}), '’', ''''), {lit(WS + '+')}, ' ', 'g')"
    return trim(f"regexp_replace({inner}, '[.!?;:,]+$', '')")


def stable_id(prefix: str, *parts: str) -> str:
    joined = ", ".join(f"coalesce(({p})::varchar, '')" for p in parts)
    return f"'{prefix}_' || left(md5(concat_ws('␟', {joined})), 16)"


def u16(column: str) -> str:
    return f"(length({column}) + length(regexp_replace({column}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


MASKED = """masked as (
  select *, case when contains(content, '```') then
      replace(content, regexp_extract(content, '(?s)```([^\\n`]*)\\n(.*?)```', 0),
        regexp_replace(regexp_extract(content, '(?s)```([^\\n`]*)\\n(.*?)```', 0), '[^\\n]', ' ', 'g'))
    else content end as prose
  from seeded)"""

SEGMENTS = f"""lines as (
  select doc_id, conv_id, conv_pos, idx, turn_id, role,
    unnest(string_split(prose, chr(10))) as line, generate_subscripts(string_split(prose, chr(10)), 1) as ln
  from masked),
placed as (
  select *, coalesce(sum(length(line) + 1) over (partition by turn_id order by ln
    rows between unbounded preceding and 1 preceding), 0)::bigint as line_start from lines),
pieces as (
  select doc_id, conv_id, conv_pos, idx, turn_id, role, ln, line_start,
    unnest(string_split(marked, chr(1))) as piece, generate_subscripts(string_split(marked, chr(1)), 1) as pn
  from (select *, regexp_replace(line, {lit('([.!?])(' + WS + '+)')}, '\\1\\2' || chr(1), 'g') as marked from placed)),
bodies as (
  select * exclude (piece), {trim('piece')} as body,
    line_start + coalesce(sum(length(piece)) over (partition by turn_id, ln order by pn
      rows between unbounded preceding and 1 preceding), 0)
    + length(regexp_extract(piece, {lit('^' + WS + '*')})) as body_start
  from pieces),
segs as (
  select doc_id, conv_id, conv_pos, idx, turn_id, role,
    (row_number() over (partition by turn_id order by ln, pn) - 1)::bigint as seq, text,
    start_at::bigint as start_at, (start_at + length(text))::bigint as end_at
  from (select *, regexp_replace(body, {lit(R.LIST_MARKER)}, '') as text,
          body_start + length(body) - length(regexp_replace(body, {lit(R.LIST_MARKER)}, '')) as start_at from bodies)
  where {u16('text')} >= 6 and regexp_matches(text, {lit(R.LETTERS)}))"""

STATEMENTS = f"""ruled as (
  select *, case
      when role = 'tool' then null
      when role = 'assistant' then case when {hit('text', R.DECISION)} then 'decision|proposed||0.5' end
      when ends_with(text, '?') then 'question|||0.8'
      when not {hit('text', R.NEGATED_COGNITION)} and {hit('text', R.SHOULD_NOT)} then 'constraint||should_not|0.55'
      when not {hit('text', R.NEGATED_COGNITION)} and {hit('text', R.MUST_NOT)} then 'constraint||must_not|0.7'
      when not {hit('text', R.NEGATED_COGNITION)} and {hit('text', R.MUST)} then 'constraint||must|0.7'
      when not {hit('text', R.NEGATED_COGNITION)} and {hit('text', R.SHOULD)} then 'constraint||should|0.55'
      when {hit('text', R.PREFERENCE)} then 'preference|||0.6'
      when {hit('text', R.DECISION)} then 'decision|accepted||0.65'
      when {hit('text', R.TASK)} then 'task|open||0.5'
      when {hit('text', R.FACT)} then 'fact|||0.5' end as verdict
  from segs where {u16('text')} <= 500),
statements as (
  select doc_id, conv_id, conv_pos, idx, turn_id, role, 2 as rank, seq, split_part(verdict, '|', 1) as type,
    text as content, start_at, end_at, nullif(split_part(verdict, '|', 3), '') as strength,
    nullif(split_part(verdict, '|', 2), '') as status, null::varchar as language, null::varchar as filename,
    null::varchar as uri, null::varchar as title, split_part(verdict, '|', 4)::double as confidence,
    'heuristic' as method
  from ruled where verdict is not null)"""

CODES = """codes as (
  select doc_id, conv_id, conv_pos, idx, turn_id, role, 0 as rank, 0::bigint as seq, 'code_artifact' as type,
    regexp_replace(body, '\\n$', '') as content, strpos(content, whole)::bigint - 1 as start_at,
    strpos(content, whole)::bigint - 1 + length(whole) as end_at, null::varchar as strength, null::varchar as status,
    coalesce(nullif(lower(split_part(trim(info), ' ', 1)), ''), 'text') as language,
    nullif(split_part(trim(info), ' ', 2), '') as filename, null::varchar as uri, null::varchar as title,
    1.0::double as confidence, 'deterministic' as method
  from (select *, regexp_extract(content, '(?s)```([^\\n`]*)\\n(.*?)```', 0) as whole,
      regexp_extract(content, '(?s)```([^\\n`]*)\\n(.*?)```', 1) as info,
      regexp_extract(content, '(?s)```([^\\n`]*)\\n(.*?)```', 2) as body from seeded)
  where whole <> '')"""

LINKS = f"""link_hits as (
  select doc_id, conv_id, conv_pos, idx, turn_id, role, prose,
    unnest(regexp_extract_all(prose, {lit(R.LINK)}, 0)) as whole,
    unnest(regexp_extract_all(prose, {lit(R.LINK)}, 1)) as bang,
    unnest(regexp_extract_all(prose, {lit(R.LINK)}, 2)) as label,
    unnest(regexp_extract_all(prose, {lit(R.LINK)}, 3)) as url
  from masked),
url_hits as (
  select doc_id, conv_id, conv_pos, idx, turn_id, role, prose, unnest(regexp_extract_all(prose, {lit(R.BARE_URL)})) as url
  from masked),
refs as (
  select doc_id, conv_id, conv_pos, idx, turn_id, role, 1 as rank, 0::bigint as seq, 'reference' as type, url as content,
    strpos(prose, whole)::bigint - 1 as start_at, strpos(prose, whole)::bigint - 1 + length(whole) as end_at,
    null::varchar as strength, null::varchar as status, null::varchar as language, null::varchar as filename,
    url as uri, {trim('label')} as title, 1.0::double as confidence, 'deterministic' as method
  from link_hits where bang <> '!'
  union all
  select u.doc_id, u.conv_id, u.conv_pos, u.idx, u.turn_id, u.role, 1, 1000000, 'reference', u.uri, u.at, u.at + length(u.uri),
    null, null, null, null, u.uri, null, 1.0, 'deterministic'
  from (select *, strpos(prose, url)::bigint - 1 as at, regexp_replace(url, '[.,;:!?]+$', '') as uri from url_hits) u
  where not exists (select 1 from link_hits k where k.turn_id = u.turn_id
    and u.at >= strpos(k.prose, k.whole) - 1 and u.at < strpos(k.prose, k.whole) - 1 + length(k.whole)))"""

ITEMS = (
    ",\n".join((SEEDED, MASKED, SEGMENTS, STATEMENTS, CODES, LINKS))
    + f""",
items as (
  select *, {stable_id('itm', 'turn_id', 'type', 'start_at', 'end_at', 'content')} as item_id from (
    select * from codes union all select * from refs union all select * from statements))"""
)

DEDUPED = (
    ITEMS
    + f""",
keyed as (
  select *, case when type = 'code_artifact' then 'code|' || language || '|' || {trim('content')}
    when type = 'reference' then 'ref|' || uri else type || '|' || {norm('content')} end as dedupe_key from items),
deduped as (
  select * from keyed
  qualify row_number() over (partition by doc_id, dedupe_key order by conv_pos, idx, rank, seq) = 1)"""
)
