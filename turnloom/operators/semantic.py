"""Model output: parsing, evidence resolution, attribution rules, normalisation.

One row per model item. A call returns at most 200 items with at most 8 quotes
each (enforced by `parse_outputs`), so per-item arrays are small by contract.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.functions import text as X
from turnloom.operators.ordering import first_wins
from turnloom.session import cut

MAX_ITEMS, MAX_RELATIONS, MAX_EVIDENCE = 200, 200, 8
STATUSES = S.DECISION_STATUS + S.TASK_STATUS + ("answered",)


def parse_outputs(outputs: DataFrame, raw: str = "output") -> tuple[DataFrame, DataFrame]:
    """Raw provider texts -> parsed outputs, and keys with the reason of a rejection. An output
    that breaks the contract anywhere is rejected as a whole; reasons carry no text."""
    keys = [c for c in outputs.columns if c != raw]
    body = F.regexp_replace(X.strip(F.col(raw)), r"^```(?:json)?\s*|\s*```$", "")
    parsed = outputs.select(*keys, body.alias("__t")).withColumn("out", F.from_json("__t", S.MODEL_OUTPUT))
    items, rels = F.col("out.items"), F.col("out.relations")

    def oneof(c, values):
        return F.coalesce(c.isin(*values), F.lit(False))

    def between(c, low, high):
        return F.coalesce(F.length(c).between(low, high), F.lit(False))

    def good(i):
        quotes = i["evidence"]
        return (
            F.coalesce(i["ref"].rlike("^[A-Za-z0-9_-]{1,32}$"), F.lit(False))
            & oneof(i["type"], S.ITEM_TYPES)
            & between(i["content"], 1, 2000)
            & oneof(i["origin"], S.ORIGINS)
            & oneof(i["assertion"], S.ASSERTIONS)
            & F.coalesce(i["confidence"].between(0, 1), F.lit(False))
            & (i["strength"].isNull() | i["strength"].isin(*S.STRENGTHS))
            & (i["status"].isNull() | i["status"].isin(*STATUSES))
            & F.coalesce(F.size(quotes) <= MAX_EVIDENCE, F.lit(False))
            & F.coalesce(
                F.forall(quotes, lambda e: between(e["message"], 1, 16) & between(e["quote"], 1, 2000)), F.lit(False)
            )
        )

    reason = (
        F.when(X.strict_json(F.col("__t")).isNull(), F.lit("invalid_json"))
        .when(items.isNull() | rels.isNull(), F.lit("schema"))
        .when((F.size(items) > MAX_ITEMS) | (F.size(rels) > MAX_RELATIONS), F.lit("too_many"))
        .when(~F.forall(items, good), F.lit("schema"))
        .when(
            ~F.forall(
                rels,
                lambda r: oneof(r["type"], ("supersedes", "conflicts_with"))
                & between(r["from"], 1, 32)
                & between(r["to"], 1, 32),
            ),
            F.lit("schema"),
        )
    )
    coded = parsed.withColumn("code", reason)
    return coded.filter("code is null").select(*keys, "out"), coded.filter("code is not null").select(*keys, "code")


def output_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed outputs as item rows (`mpos` is the position in the output) and relation rows."""
    keys = [c for c in parsed.columns if c != "out"]
    items = parsed.select(*keys, F.posexplode("out.items").alias("mpos", "i")).select(*keys, "mpos", "i.*")
    rels = parsed.select(*keys, F.posexplode("out.relations").alias("rpos", "r")).select(*keys, "rpos", "r.*")
    return items, rels


def prompt_rows(turns: DataFrame) -> DataFrame:
    """Per conversation the JSON array sent to a provider: selected turns only, in order.

    Run `selection.size_gate` first: it bounds what one row can hold.
    """
    message = F.struct(F.concat(F.lit("m"), F.col("idx").cast("string")).alias("ref"), "role", "content")
    ordered = F.array_sort(F.collect_list(F.struct("idx", message.alias("m"))))
    return turns.groupBy("conv_id").agg(F.to_json(F.transform(ordered, lambda x: x["m"])).alias("prompt"))


def call_provider(prompts: DataFrame, generate: Callable[[str], str], concurrency: int | None = None) -> DataFrame:
    """Run a user-supplied model call over prompts, Arrow batch by batch. A failure is a row."""
    rows = prompts.repartition(concurrency) if concurrency else prompts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, codes = [], []
            for prompt in batch["prompt"]:
                try:
                    texts.append(generate(prompt))
                    codes.append(None)
                except Exception as error:  # the call is foreign code
                    texts.append(None)
                    codes.append("provider_" + type(error).__name__)
            yield pd.DataFrame({"conv_id": batch["conv_id"], "output": texts, "code": codes})

    return rows.mapInPandas(run, "conv_id string, output string, code string")


def replay_provider(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """The scripted provider: recorded outputs joined on the conversation."""
    return prompts.select("conv_id").join(recorded.select("conv_id", "output"), "conv_id", "left").withColumn(
        "code", F.when(F.col("output").isNull(), F.lit("provider_no_recording"))
    )


def attribution(kind: Column, origin: Column, status: Column, assertion: Column) -> Column:
    """Who may assert what, as struct(type, status, assertion, rule). Ordered rules, first wins."""

    def result(k, s, a, rule):
        return F.struct(
            k.alias("type"), s.cast("string").alias("status"), a.alias("assertion"), F.lit(rule).cast("string").alias("rule")
        )

    bound = kind.isin("constraint", "preference")
    quoted = F.when(assertion == "quoted", F.lit("quoted")).otherwise(F.lit("suggested"))
    return (
        F.when(
            bound & (origin == "assistant"),
            result(F.lit("decision"), F.lit("proposed"), F.lit("suggested"), "assistant_cannot_require"),
        )
        .when(
            (bound | kind.isin("decision", "task")) & (origin == "tool"),
            result(F.lit("fact"), F.lit(None), F.lit("quoted"), "tool_output_is_a_fact"),
        )
        .when(
            (kind == "decision")
            & (origin == "assistant")
            & ~F.coalesce(status.isin("proposed", "rejected"), F.lit(False)),
            result(kind, F.lit("proposed"), quoted, "assistant_proposes"),
        )
        .when(
            (kind == "decision") & F.coalesce(status == "accepted", F.lit(False)) & ~origin.isin("user", "system"),
            result(kind, F.lit("proposed"), assertion, "only_user_accepts"),
        )
        .otherwise(result(kind, status, assertion, None))
    )


def resolve_evidence(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Each quote of each item with the turn it names and, where found, its span.

    The turn side is the selected turns only, so a quote outside the selection has no turn.
    """
    quotes = items.select("conv_id", "mpos", F.posexplode("evidence").alias("epos", "e")).select(
        "conv_id", "mpos", "epos", X.strip(F.col("e.message")).alias("message"), F.col("e.quote").alias("quote")
    )
    named = turns.select(
        "conv_id", F.concat(F.lit("m"), F.col("idx").cast("string")).alias("message"), "turn_id", "idx", "role", "content"
    )
    return (
        quotes.join(named, ["conv_id", "message"], "left")
        .withColumn("span", X.locate_quote(F.col("content"), F.col("quote")))
        .select("conv_id", "mpos", "epos", "turn_id", "idx", "role", F.col("span.start"), F.col("span.end"))
    )


def normalize(
    items: DataFrame, relations: DataFrame, turns: DataFrame, policy: str = "strict", agent: str = S.MODEL_AGENT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model rows -> (accepted items with attribution, relations on item ids, diagnostics)."""
    evidence = resolve_evidence(items, turns)
    gathered = evidence.groupBy("conv_id", "mpos").agg(
        F.array_sort(F.collect_list(F.struct("epos", "turn_id", "idx", "role", "start", "end"))).alias("cited")
    )
    conv = turns.select("conv_id", "doc_id", "conv_pos").distinct()
    none = F.array().cast("array<struct<epos:int,turn_id:string,idx:int,role:string,start:int,end:int>>")
    base = (
        items.join(gathered, ["conv_id", "mpos"], "left")
        .join(conv, "conv_id")
        .withColumn("cited", F.coalesce("cited", none))
        .withColumn("located", F.filter("cited", lambda e: e["turn_id"].isNotNull()))
        .withColumn("verified", F.filter("located", lambda e: e["start"].isNotNull()))
    )
    used = F.when(F.size("verified") > 0, F.col("verified")).otherwise(F.col("located"))
    no_quotes = F.coalesce(F.size("evidence"), F.lit(0)) == 0
    unsupported = (F.size("verified") == 0) & (F.lit(policy == "strict") | (F.size("located") == 0))
    judged = (
        base.withColumn("used", used)
        .withColumn("primary", F.get("used", F.lit(0)))
        .withColumn("speaker", F.coalesce(F.col("primary.role"), F.lit("unknown")))
        .withColumn("ruled", attribution(F.col("type"), F.col("speaker"), F.col("status"), F.col("assertion")))
        .withColumn("content", X.strip(F.col("content")))
        .withColumn(
            "link",
            F.coalesce("uri", F.when(F.col("content").rlike(f"^https?://{X.NOT_WS}+$"), F.col("content"))),
        )
    )
    kind, status = F.col("ruled.type"), F.col("ruled.status")
    lacking = ((kind == "constraint") & F.col("strength").isNull()) | (
        (kind == "reference") & (F.coalesce("link", F.lit("")) == "")
    )
    verdict = (
        F.when(no_quotes, F.lit("missing_evidence"))
        .when(unsupported, F.lit("unsupported_item"))
        .when(lacking, F.lit("missing_field"))
    )
    per_ref = W.partitionBy("conv_id", "ref")  # a call holds at most 200 rows
    coded = judged.withColumn("verdict", verdict)
    coded = coded.withColumn(
        "first_ok", F.min(F.when(F.col("verdict").isNull(), F.col("mpos"))).over(per_ref)
    ).withColumn("copy", F.coalesce(F.col("mpos") > F.col("first_ok"), F.lit(False)))
    coded = cut(coded)  # items, relations and notes each read it

    confidence = F.least(
        F.col("confidence"),
        F.when(F.col("ruled.assertion") == "inferred", F.lit(0.8)).otherwise(F.lit(1.0)),
        F.when(F.size("verified") == 0, F.lit(0.4)).otherwise(F.lit(1.0)),
    )
    legal = (
        F.when(kind == "decision", F.when(status.isin(*S.DECISION_STATUS), status))
        .when(kind == "task", F.when(status.isin(*S.TASK_STATUS), status).otherwise(F.lit("open")))
        .when(kind == "question", F.when(status.isin(*S.QUESTION_STATUS), status))
    )
    language = F.lower(F.coalesce("language", F.lit("text")))
    is_code, is_link = kind == "code_artifact", kind == "reference"
    shaped = coded.filter(F.col("verdict").isNull() & ~F.col("copy")).select(
        "doc_id",
        "conv_id",
        "conv_pos",
        "mpos",
        "ref",
        F.col("primary.idx").alias("idx"),
        F.col("primary.turn_id").alias("turn_id"),
        F.col("primary.role").alias("role"),
        kind.alias("type"),
        "content",
        F.col("primary.start").alias("start"),
        F.col("primary.end").alias("end"),
        F.when(kind == "constraint", F.col("strength")).alias("strength"),
        legal.alias("status"),
        F.when(is_code, F.when(language == "", F.lit("text")).otherwise(language)).alias("language"),
        F.when(is_code, F.nullif("filename", F.lit(""))).alias("filename"),
        F.when(is_link, F.col("link")).alias("uri"),
        F.when(is_link, F.nullif("title", F.lit(""))).alias("title"),
        confidence.alias("confidence"),
        F.lit("model").alias("method"),
        F.lit(agent).alias("agent"),
        F.col("speaker").alias("origin"),
        F.col("ruled.assertion").alias("assertion"),
        F.transform("used", lambda e: F.struct(e["turn_id"].alias("turn_id"), e["start"].alias("start"), e["end"].alias("end"))).alias("evidence"),
    )
    keyed = shaped.withColumn(
        "item_id", X.stable_id("itm", F.lit(agent), *[F.col(c) for c in ("turn_id", "type", "start", "end", "content")])
    )
    accepted = first_wins(keyed, ["conv_id", "item_id"], ["mpos"])
    repeats = keyed.join(accepted.select("conv_id", "mpos"), ["conv_id", "mpos"], "left_anti")

    ids = keyed.select("conv_id", "ref", "item_id")
    ends = (
        relations.join(ids.select("conv_id", F.col("ref").alias("from"), F.col("item_id").alias("from_id")), ["conv_id", "from"], "left")
        .join(ids.select("conv_id", F.col("ref").alias("to"), F.col("item_id").alias("to_id")), ["conv_id", "to"], "left")
        .join(conv, "conv_id")
    )
    sound = F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("from_id") != F.col("to_id"))
    linked = ends.filter(sound).select(
        "doc_id", "conv_id", "rpos", "type", F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.lit(agent).alias("source")
    )

    def note(df, level, code, n=None):
        return df.select(
            "conv_id", "ref", F.lit(level).alias("level"), code.alias("code"), (n if n is not None else F.lit(1)).cast("bigint").alias("n")
        )

    outside = F.size("cited") - F.size("located")
    fresh = coded.filter(~F.col("copy"))
    supported = fresh.filter(F.coalesce(~F.col("verdict").isin("missing_evidence", "unsupported_item"), F.lit(True)))
    diagnostics = (
        note(coded.filter("copy"), "warning", F.lit("duplicate_ref"))
        .unionByName(note(fresh.filter(outside > 0), "warning", F.lit("unknown_message_ref"), outside))
        .unionByName(note(fresh.filter("verdict is not null"), "warning", F.col("verdict")))
        .unionByName(note(supported.filter(F.col("origin") != F.col("speaker")), "info", F.lit("origin_corrected")))
        .unionByName(note(supported.filter(F.col("ruled.rule").isNotNull()), "info", F.lit("attribution_rule")))
        .unionByName(note(repeats, "info", F.lit("duplicate_item")))
        .unionByName(
            note(ends.filter(~sound).withColumn("ref", F.concat_ws("→", "from", "to")), "info", F.lit("relation_dropped"))
        )
    )
    return accepted, linked, diagnostics


REJECTED = ("missing_evidence", "unsupported_item", "missing_field")


def extraction_summary(items: DataFrame, accepted: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Candidates, accepted and rejected counts of each conversation."""
    c = items.groupBy("conv_id").agg(F.count(F.lit(1)).alias("candidates"))
    a = accepted.groupBy("conv_id").agg(F.count(F.lit(1)).alias("accepted"))
    r = diagnostics.groupBy("conv_id").agg(F.count_if(F.col("code").isin(*REJECTED)).alias("rejected"))
    zero = F.lit(0).cast("bigint")
    return c.join(a, "conv_id", "left").join(r, "conv_id", "left").select(
        "conv_id", "candidates", F.coalesce("accepted", zero).alias("accepted"), F.coalesce("rejected", zero).alias("rejected")
    )
