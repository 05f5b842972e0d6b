"""Turn tables and recorded conversations as turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.functions import text as X
from turnloom.operators.ordering import number_rows, sums_before
from turnloom.session import cut

ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$"


def with_default_index(turns: DataFrame, position: str, block: int = 4096) -> DataFrame:
    """`idx` where given, else the position inside the conversation. `position` orders the turns."""
    numbered = number_rows(
        turns, ["conv_id"], F.floor(F.col(position) / F.lit(block)), [position], "__position"
    )
    given = F.col("idx") if "idx" in turns.columns else F.lit(None)
    index = F.coalesce(given.cast("int"), F.col("__position").cast("int"))
    return (
        numbered.withColumn("idx", index)
        .withColumn("turn_id", F.concat(F.col("conv_id"), F.lit("_t"), index.cast("string")))
        .drop("__position")
    )


def iso_timestamp(c: Column) -> Column:
    """Calendar-valid ISO 8601 with offset, or null (rejects 2026-02-30 and texts without offset)."""
    minutes = F.regexp_extract(c, r"T\d{2}:(\d{2})", 1).try_cast("int")
    hours = F.regexp_extract(c, r"T(\d{2})", 1).try_cast("int")
    return F.when(c.rlike(ISO) & (hours <= 23) & (minutes <= 59), c.try_cast("timestamp"))


def repair_timestamp(c: Column, now: Column) -> tuple[Column, Column]:
    """(usable timestamp, was repaired). Valid texts pass; other readable dates are rewritten; else `now`."""
    valid = iso_timestamp(c).isNotNull()
    reread = c.try_cast("timestamp")
    rewritten = F.date_format(reread, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(valid, c).otherwise(F.coalesce(rewritten, now)), ~valid


def append_missing_code(content: Column, blocks: Column) -> Column:
    """Code blocks the text does not hold yet, appended as fences; later blocks see earlier ones."""

    def step(acc, b):
        code = F.regexp_replace(b["code"], r"\n\z", "")
        body = X.strip(code)
        have = (body == "") | F.contains(acc, body)
        gap = F.when(acc == "", F.lit("")).otherwise(F.lit("\n\n"))
        block = F.concat(
            acc, gap, F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"), code, F.lit("\n```")
        )
        return F.when(have, acc).otherwise(block)

    return F.aggregate(F.coalesce(blocks, F.array().cast(f"array<{S.CODE_BLOCK.simpleString()}>")), content, step)


def project_attachments(attachments: Column) -> Column:
    """Names, types and usable links; inline data is dropped."""
    uri = lambda a: F.when(~a["url"].rlike("(?i)^(data|blob):") & (a["url"] != ""), a["url"])
    return F.transform(
        attachments,
        lambda a: F.struct(
            a["type"].alias("kind"), a["name"].alias("name"), a["mimeType"].alias("media_type"), uri(a).alias("uri")
        ),
    )


def dropped_inline(attachments: Column) -> Column:
    return F.coalesce(F.size(F.filter(attachments, lambda a: F.coalesce(a["dataUrl"], F.lit("")) != "")), F.lit(0))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def conversation_key(platform: Column, url: Column, captured_at: Column, title: Column) -> Column:
    """Stable per URL, so capturing a chat again updates it; else time and title decide."""
    by_url = X.stable_id("conv", platform, F.split_part(url, F.lit("#"), F.lit(1)))
    by_time = X.stable_id("conv", platform, url, captured_at, title)
    return F.when(F.coalesce(F.length(url_path(url)), F.lit(0)) > 0, by_url).otherwise(by_time)


def clean_title(c: Column) -> Column:
    """Title without the trailing site name."""
    short = X.strip(F.regexp_replace(c, rf"{X.WS}*[-|·–—]{X.WS}*[A-Za-z .]+$", ""))
    return F.when(short == "", F.lit("Conversation")).otherwise(short)


_STRING = r'(?s)"(?:[^"\\]|\\.)*+(?:"|$)'
_REST = r'(?s)^(?:[^"\\]|\\.)*+(?:"|$)'


def _opened(text: Column) -> Column:
    """Braces opened outside of strings, for a text that starts outside of one."""
    bare = F.regexp_replace(text, _STRING, "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, raw): the JSON objects of files that hold one, an array of them, or one after the other.

    Files are read in splits and cut at closing braces, wherever these lie, so an array of
    many gigabytes on one line is read by many tasks. Whether a piece starts inside a
    string, and how deep, follows from sums over the pieces before it; a record ends where
    the depth is 0 again. Nothing longer than a record is held. What is left of a file that
    breaks off is a record that can't be parsed.
    """
    pieces = cut(
        spark.read.option("lineSep", "}").text(path).select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"),
        )
    )
    quotes = F.regexp_replace("value", r"(?s)\\.", "")
    odd = ((F.length(quotes) - F.length(F.replace(quotes, F.lit('"'), F.lit("")))) % 2).cast("bigint")
    slim = pieces.select(
        "file", "split", "n", "size", odd.alias("odd"), (F.octet_length("value") + 1).cast("bigint").alias("bytes"),
        _opened(F.col("value")).alias("outside"), _opened(F.regexp_replace("value", _REST, "")).alias("inside"),
    )
    stated = sums_before(slim, ["file"], "split", ["n"], quoted=F.col("odd"), at=F.col("bytes"))
    closes = ((F.col("quoted") + F.col("odd")) % 2 == 0) & (F.col("at") + F.col("bytes") <= F.col("size"))
    moved = F.when(F.col("quoted") % 2 == 0, F.col("outside")).otherwise(F.col("inside")) - closes.cast("int")
    deep = sums_before(stated.select("file", "split", "n", closes.alias("closes"), moved.alias("moved"), (F.col("at") + F.col("bytes") <= F.col("size")).alias("brace")),
                       ["file"], "split", ["n"], depth=F.col("moved"))
    ends = F.col("closes") & (F.col("depth") + F.col("moved") <= 0)
    numbered = sums_before(deep, ["file"], "split", ["n"], pos=ends.cast("bigint"))
    text = F.concat("value", F.when(F.col("brace"), "}").otherwise(""))
    parts = numbered.select("file", "n", "split", "pos", "brace").join(pieces.select("file", "n", "value"), ["file", "n"])
    whole = parts.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("split", "n", text.alias("t")))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["t"]), "")
    records = whole.select("file", "pos", F.regexp_replace(joined, r"^[\s,\[\]\x{feff}]+", "").alias("raw"))
    return records.filter("raw <> ''")


def parse_records(records: DataFrame, raw: str = "raw") -> DataFrame:
    """The parsed record beside the reason it is unusable (null when usable)."""
    parsed = records.withColumn("rec", F.from_json(raw, S.RECORD_V0, {"mode": "PERMISSIVE"}))
    roles = F.array(*[F.lit(r) for r in S.ROLES])
    m = F.col("rec.messages")
    reason = (
        F.when(F.col("rec").isNull() | m.isNull(), F.lit("not_a_conversation"))
        .when(F.exists(m, lambda x: x["content"].isNull() | x["role"].isNull()), F.lit("bad_message"))
        .when(F.exists(m, lambda x: ~F.array_contains(roles, x["role"])), F.lit("bad_role"))
        .when(F.col("rec.source").isNull(), F.lit("missing_source"))
    )
    return parsed.withColumn("reason", reason)


def record_turns(parsed: DataFrame, now: Column, kind: str = "browser") -> DataFrame:
    """Usable records as turns with conversation attributes; both record variants."""
    rec = F.col("rec")
    platform = F.when(
        (rec["source"] == "unknown") & (F.coalesce(rec["platform"], F.lit("")) != ""), rec["platform"]
    ).otherwise(rec["source"])
    captured, repaired = repair_timestamp(rec["capturedAt"], now)
    url, title = F.nullif(rec["url"], F.lit("")), F.nullif(rec["title"], F.lit(""))
    carried = [c for c in parsed.columns if c not in ("rec", "raw", "reason")]
    head = parsed.filter(F.col("reason").isNull()).select(
        *carried,
        platform.alias("platform"),
        F.lit(kind).alias("kind"),
        url.alias("url"),
        title.alias("title"),
        captured.alias("captured_at"),
        F.coalesce(repaired, F.lit(True)).alias("captured_repaired"),
        rec["messages"].alias("__messages"),
    )
    keyed = head.withColumn(
        "conv_id", conversation_key(F.col("platform"), F.col("url"), F.col("captured_at"), F.col("title"))
    )
    rows = keyed.select(
        *[c for c in keyed.columns if c != "__messages"], F.posexplode("__messages").alias("idx", "__m")
    )
    none = F.array().cast(f"array<{S.CODE_BLOCK.simpleString()}>")
    blocks = F.concat(F.coalesce(F.col("__m.code"), none), F.coalesce(F.col("__m.codeBlocks"), none))
    return rows.select(
        *[c for c in rows.columns if c != "__m"],
        F.concat(F.col("conv_id"), F.lit("_t"), F.col("idx").cast("string")).alias("turn_id"),
        F.col("__m.role").alias("role"),
        append_missing_code(F.col("__m.content"), blocks).alias("content"),
        project_attachments(F.col("__m.attachments")).alias("attachments"),
        dropped_inline(F.col("__m.attachments")).alias("dropped_inline"),
    )


def record_warnings(turns: DataFrame) -> DataFrame:
    """Codes and counts only, no text."""
    per = turns.groupBy("conv_id").agg(
        F.max(F.col("captured_repaired").cast("int")).alias("repaired"), F.sum("dropped_inline").alias("dropped")
    )
    return per.select(
        "conv_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("repaired") == 1, F.struct(F.lit("captured_at_repaired").alias("code"), F.lit(1).cast("bigint").alias("n"))),
                    F.when(F.col("dropped") > 0, F.struct(F.lit("inline_data_dropped").alias("code"), F.col("dropped").cast("bigint").alias("n"))),
                )
            )
        ).alias("w"),
    ).select("conv_id", "w.*")
