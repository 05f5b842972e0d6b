"""Queries over interchange formats and extension points: records, documents, outputs, own extractors, providers (S2-S5, S9, D)."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.operators import extract as E
from turnloom.operators import semantic as SEM
from turnloom.operators import validate as V
from turnloom.operators.selection import size_gate
from turnloom.plans import oracle as O
from turnloom.plans.modelled import NORMAL, script_rows
from turnloom.plans.seeded import CAPTURED, SEEDED, seeded_turns
from turnloom.session import checkpoint_dir, spread
from turnloom.sources import fixtures as FX
from turnloom.sources import turns as ST


def _records(spark, sf):
    """Each turn as a recorded one-message conversation in JSON: both variants, some broken by arithmetic."""
    t = seeded_turns(spark, sf)
    code = F.array(F.struct(F.lit("py").alias("language"), F.lit("x = 1\n").alias("code")))
    message = F.struct(
        F.when(F.col("idx") == 6, F.lit("wizard")).otherwise(F.col("role")).alias("role"), "content",
        F.when(F.col("idx") % 2 == 0, code).alias("code"), F.when(F.col("idx") % 2 == 1, code).alias("codeBlocks"),
    )
    record = F.to_json(F.struct(
        F.when(F.col("idx") % 2 == 0, F.lit("chatgpt")).otherwise(F.lit("unknown")).alias("source"), F.lit("kimi").alias("platform"),
        F.col("turn_id").alias("title"), F.concat(F.lit("https://c.example/"), "turn_id").alias("url"), F.lit(CAPTURED).alias("capturedAt"),
        F.array(message).alias("messages"),
    ))
    raw = F.when(F.col("idx") == 5, F.substring(record, 1, 40)).otherwise(record)
    return spread(t.select(F.col("turn_id").alias("file"), raw.alias("raw")), "file")


def s2_records(spark, sf):
    parsed = ST.parse_records(_records(spark, sf))
    return ST.record_turns(parsed, F.lit("2025-06-01T00:00:00.000Z")).select("file", "conv_id", "platform", "role", F.md5("content").alias("h"))


def s2_files(spark, sf):
    """The same records written as JSON arrays, an array per document, and read back by splits."""
    path = f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    rows = _records(spark, sf).filter("not endswith(file, '_t5')")
    doc = F.floor(F.regexp_extract("file", r"c(\d+)_", 1).cast("bigint") / 10)
    arrays = rows.groupBy(doc.alias("d")).agg(F.array_sort(F.collect_list("raw")).alias("r"))
    gap = F.when(F.col("d") % 2 == 0, F.lit(",")).otherwise(F.lit(" ,\n\t"))
    arrays.select(F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: F.concat(x, gap)), ""), F.lit("{}]")).alias("value")).write.text(path)
    parsed = ST.parse_records(ST.read_records(spark, path))
    turns = ST.record_turns(parsed, F.lit("2025-06-01T00:00:00.000Z"))
    return turns.select("conv_id", "platform", "role", F.md5("content").alias("h"))


def s2_rejected(spark, sf):
    return ST.parse_records(_records(spark, sf)).filter("reason is not null").select("file", "reason")


_S2 = f"""with {SEEDED} select turn_id as file, {O.stable_id('conv', "case when idx % 2 = 0 then 'chatgpt' else 'kimi' end", "'https://c.example/' || turn_id")} as conv_id,
  case when idx % 2 = 0 then 'chatgpt' else 'kimi' end as platform, role,
  md5(case when contains(content, 'x = 1') then content else content || chr(10) || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || '```' end) as h
from seeded where idx not in (5, 6)"""


def _documents(spark, sf):
    """Each turn as a stored JSON document with its items left out; every tenth position is cut short."""
    t = seeded_turns(spark, sf)
    source = F.struct(F.lit("browser").alias("kind"), F.lit("chatgpt").alias("platform"))
    turn = F.struct(F.col("turn_id").alias("id"), F.col("idx").alias("index"), "role", "content")
    conv = F.struct(F.col("conv_id").alias("id"), source.alias("source"), F.lit(CAPTURED).alias("captured_at"), F.array(turn).alias("turns"))
    doc = F.to_json(F.struct(
        F.when(F.col("idx") == 4, F.lit("9.0")).otherwise(F.lit("0.1")).alias(V.VERSION_FIELD), F.concat(F.lit("doc-"), "turn_id").alias("id"),
        F.struct(F.lit(CAPTURED).alias("created_at"), F.lit(CAPTURED).alias("updated_at")).alias("metadata"), F.array(conv).alias("conversations"),
        F.array().cast("array<string>").alias("items"),
    ))
    raw = F.when(F.col("idx") == 5, F.substring(doc, 1, 60)).otherwise(doc)
    return spread(t.select(F.col("turn_id").alias("doc_id"), raw.alias("raw")), "doc_id")


@lru_cache(maxsize=8)
def _fixtures(spark, sf):
    """A fixture per conversation, an array of them per file; every other one selects two turns."""
    t = seeded_turns(spark, sf)
    said = F.array_sort(F.collect_list(F.struct("idx", F.struct("role", "content").alias("m"))))
    per = t.groupBy("conv_id", "conv_pos").agg(F.transform(said, lambda x: x["m"]).alias("messages"))
    gold = F.array(F.struct(F.lit("question").alias("type"), F.lit("user").alias("origin"), F.lit(0).alias("message"), F.array(F.lit("porto")).alias("match")))
    bad = F.array(F.struct(F.lit("decision").alias("type"), F.lit("user").alias("origin"), F.array(F.col("conv_id")).alias("match"), F.lit("names a chat").alias("reason")))
    fixture = F.to_json(F.struct(
        F.col("conv_id").alias("id"), F.struct(F.lit("chatgpt").alias("source"), F.lit(CAPTURED).alias("capturedAt"), "messages").alias("conversation"),
        F.when(F.col("conv_pos") % 2 == 0, F.array(F.lit(0), F.lit(2))).alias("selection"), gold.alias("expected"), bad.alias("forbidden"),
    ))
    path = f"{checkpoint_dir(spark)}/fixtures-{uuid.uuid4().hex}"
    files = per.groupBy(F.floor(F.col("conv_pos") / 10).alias("d")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(fixture), ",\n"), F.lit("]")).alias("value"))
    files.write.partitionBy("d").text(path)
    return FX.read_fixtures(spark, path, "*.txt")


def s8_turns(spark, sf):
    return FX.fixture_turns(_fixtures(spark, sf)).select("conv_id", "idx", "turn_id", "role", F.md5("content").alias("h"))


def s8_specs(spark, sf):
    gold, bad = FX.fixture_gold(_fixtures(spark, sf))
    one = gold.select("doc_id", F.lit("expected").alias("kind"), "type", "origin", F.array_join("match", ",").alias("words"))
    return one.unionByName(bad.select("doc_id", F.lit("forbidden").alias("kind"), "type", "origin", F.array_join("match", ",").alias("words")))


def s4_documents(spark, sf):
    return V.validate(V.stored(V.parse_documents(_documents(spark, sf)))).select("doc_id", "severity", "code", "path")


def s5_reextract(spark, sf):
    """Conversations of stored documents are extractor input again, ids and indexes kept."""
    items = E.extract_items(V.document_turns(V.parse_documents(_documents(spark, sf))))
    return items.select("turn_id", "idx", "type", "content", "item_id")


def _outputs(spark, sf):
    """Model items as provider texts, one per turn: fenced, plain, broken or breaking the contract."""
    rows = script_rows(spark, sf)
    item = F.struct(*[F.col(f.name) for f in S.MODEL_ITEM.fields])
    body = F.to_json(F.struct(F.array(item).alias("items"), F.array().cast("array<struct<type:string,from:string,to:string>>").alias("relations")))
    text = (
        F.when(F.col("mpos") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("mpos") == 2, F.concat(body, F.lit(" and more")))
        .when(F.col("mpos") == 3, F.regexp_replace(body, '"type":"[a-z_]+"', '"type":"mood"'))
        .otherwise(body)
    )
    return rows.select("conv_id", "mpos", text.alias("output"))


def s9_outputs(spark, sf):
    good, bad = SEM.parse_outputs(_outputs(spark, sf).withColumn("mpos", F.col("mpos").cast("bigint")))
    items, _ = SEM.output_rows(good.withColumnRenamed("mpos", "call"))
    return items.select("conv_id", F.col("call").alias("call"), "ref", F.lit(None).cast("string").alias("code")).unionByName(
        bad.select("conv_id", F.col("mpos").alias("call"), F.lit(None).cast("string").alias("ref"), "code")
    )


_S9 = f"""with {SEEDED},{NORMAL} select conv_id, idx::bigint as call, case when idx not in (2, 3) then ref end as ref,
  case idx when 2 then 'invalid_json' when 3 then 'schema' end as code from said"""


def _names(t: E.TurnColumns):
    """An extractor of our own: product names as references."""
    return F.transform(
        E.X.matches(t.prose, "Porto|vinegar|rye flour|sourdough"),
        lambda x, i: E._draft(seq=i, type="reference", content=x["text"], start=x["start"], end=x["start"] + F.length(x["text"]), uri=x["text"],
                              confidence=1.0, method="deterministic", agent="names@1"),
    )


NAMES = E.Extractor("names", _names)


def d1_extractor(spark, sf):
    items = E.extract_items(seeded_turns(spark, sf), (*E.DEFAULT_EXTRACTORS, NAMES))
    return items.filter("rank = 3").select("turn_id", "content", F.col("start").alias("start_at"))


def d3_provider(spark, sf):
    """A model call is any function of the prompt; here it answers with the prompt's size or fails."""

    def generate(prompt: str) -> str:
        if "Porto" in prompt:
            raise ValueError
        return str(len(prompt))

    t = seeded_turns(spark, sf)
    out = SEM.call_provider(SEM.prompt_rows(size_gate(t)[0]), generate)
    return out.select("conv_id", F.col("output").isNotNull().alias("answered"), "code")


def d4_replay(spark, sf):
    t = seeded_turns(spark, sf)
    recorded = t.filter((F.col("idx") == 0) & (F.col("conv_pos") % 3 > 0)).select("conv_id", F.left("content", F.lit(20)).alias("output"))
    return SEM.replay_provider(SEM.prompt_rows(size_gate(t)[0]), recorded)


QUERIES = {
    "s2_s3_records": (s2_records, _S2),
    "s2_record_files": (s2_files, f"select conv_id, platform, role, h from ({_S2})"),
    "s2_rejected_records": (
        s2_rejected, f"with {SEEDED} select turn_id as file, case idx when 5 then 'not_a_conversation' else 'bad_role' end as reason from seeded where idx in (5, 6)"
    ),
    "s8_fixture_turns": (
        s8_turns, f"with {SEEDED} select conv_id, idx, turn_id, role, md5(content) as h from seeded where conv_pos % 2 = 1 or idx in (0, 2)"
    ),
    "s8_fixture_specs": (
        s8_specs,
        f"with {SEEDED}, c as (select distinct conv_id as doc_id from seeded) select doc_id, 'expected' as kind, 'question' as type, 'user' as origin, 'porto' as words from c "
        "union all select doc_id, 'forbidden', 'decision', 'user', doc_id from c",
    ),
    "s4_documents": (
        s4_documents,
        f"with {SEEDED} select turn_id as doc_id, 'error' as severity, case idx when 5 then 'not_an_object' else 'unsupported_major_version' end as code, "
        "case idx when 5 then '$' else '$.context_version' end as path from seeded where idx in (4, 5)",
    ),
    "s5_reextraction": (s5_reextract, f"with {O.ITEMS} select turn_id, idx, type, content, item_id from items where idx <> 5"),
    "s9_model_outputs": (s9_outputs, _S9),
    "d1_own_extractor": (
        d1_extractor,
        f"with {SEEDED}, n as (select turn_id, content, unnest(['Porto','vinegar','rye flour','sourdough']) as name from seeded) "
        "select turn_id, name as content, strpos(content, name) - 1 as start_at from n where contains(content, name)",
    ),
    "d3_provider": (
        d3_provider,
        f"with {SEEDED} select conv_id, not bool_or(contains(content, 'Porto')) as answered, case when bool_or(contains(content, 'Porto')) then 'provider_ValueError' end as code from seeded group by conv_id",
    ),
    "d4_replay": (
        d4_replay,
        f"with {SEEDED} select conv_id, max(case when idx = 0 and conv_pos % 3 > 0 then left(content, 20) end) as output, case when any_value(conv_pos) % 3 = 0 then 'provider_no_recording' end as code from seeded group by conv_id",
    ),
}
