"""Turn -> typed items. One pass, one generate, no Python at run time.

Each extractor is a column expression giving an array of drafts; the arrays of
all extractors are concatenated and exploded once, so a turn is read once
however many extractors are registered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.functions import rules as R
from turnloom.functions import text as X

_DRAFTS = f"array<{S.DRAFT.simpleString()}>"


def _draft(**values) -> Column:
    fields = [
        values[f.name].cast(f.dataType).alias(f.name)
        if isinstance(values.get(f.name), Column)
        else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name)
        for f in S.DRAFT.fields
    ]
    return F.struct(*fields)


# -- structure ---------------------------------------------------------------


def _has_fence(content: Column) -> Column:
    return F.contains(content, F.lit("```"))


def fenced_blocks(content: Column) -> Column:
    """array<struct<start, end, info, body>> of the fenced blocks of a text."""
    blocks = F.transform(
        X.matches(content, R.FENCE),
        lambda m: F.struct(
            m["start"].alias("start"),
            (m["start"] + F.length(m["text"])).cast("int").alias("end"),
            X.strip(F.regexp_extract(m["text"], R.FENCE, 1)).alias("info"),
            F.regexp_replace(F.regexp_extract(m["text"], R.FENCE, 2), r"\n\z", "").alias("body"),
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int,info:string,body:string>>")
    return F.when(_has_fence(content), blocks).otherwise(empty)


def mask_fences(content: Column) -> Column:
    """The text with fenced blocks blanked and every offset unchanged."""
    blanked = F.transform(
        X.tiles(content, R.FENCE), lambda t: F.when(t["hit"], F.regexp_replace(t["text"], r"[^\n]", " ")).otherwise(t["text"])
    )
    return F.when(_has_fence(content), F.array_join(blanked, "")).otherwise(content)


def segments(prose: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Sentence-like pieces with offsets: array<struct<text, start, end>>.

    `keep` may drop pieces early; it sees the raw piece.
    """
    placed = X.cut_behind(prose, R.CUT)
    if keep:
        placed = F.filter(placed, lambda p: keep(p["text"]))

    def shape(p):
        body = X.strip(p["text"])
        marker = F.length(F.regexp_extract(body, R.LIST_MARKER, 0))
        lead = F.length(F.regexp_extract(p["text"], f"^{X.WS}*", 0))
        text = F.substring(body, marker + 1, F.length(body))
        start = (p["start"] + lead + marker).cast("int")
        return F.struct(
            text.alias("text"), start.alias("start"), (start + F.length(text)).cast("int").alias("end")
        )

    return F.filter(
        F.transform(placed, shape),
        lambda s: (X.u16_length(s["text"]) >= R.MIN_SEGMENT) & s["text"].rlike(R.LETTERS),
    )


# -- extractors --------------------------------------------------------------


def code_drafts(t: "TurnColumns") -> Column:
    """A code item per non-blank fenced block."""
    blocks = F.filter(fenced_blocks(t.content), lambda b: X.strip(b["body"]) != "")

    def one(b, i):
        words = F.filter(F.split(b["info"], f"{X.WS}+"), lambda w: w != "")
        language = F.lower(F.coalesce(F.get(words, F.lit(0)), F.lit("")))
        rest = F.when(F.size(words) > 1, F.slice(words, F.lit(2), F.size(words))).otherwise(
            F.array().cast("array<string>")
        )
        return _draft(
            rank=0,
            seq=i,
            type="code_artifact",
            content=b["body"],
            start=b["start"],
            end=b["end"],
            language=F.when(language == "", F.lit("text")).otherwise(language),
            filename=F.get(F.filter(rest, lambda w: w.rlike("[./]")), F.lit(0)),
            confidence=1.0,
            method="deterministic",
            agent=S.CODE_AGENT,
        )

    return F.transform(blocks, one)


def reference_drafts(t: "TurnColumns") -> Column:
    """Markdown links first, then bare URLs that do not start inside a link or image."""
    prose = t.prose

    def link(m):
        part = lambda i: F.regexp_extract(m["text"], R.LINK, i)
        return F.struct(
            part(1).alias("bang"), part(2).alias("label"), part(3).alias("url"), m["start"].alias("start"),
            (m["start"] + F.length(m["text"])).cast("int").alias("end"),
        )

    # links blanked but for the "!" in front, which may end a bare URL: no URL starts inside a link then
    blank = lambda s: F.concat(F.regexp_extract(s, "^!?", 0), F.repeat(F.lit(" "), F.length(F.regexp_replace(s, "^!", ""))))
    cut = X.tiles(prose, R.LINK)
    links = F.transform(F.filter(cut, lambda m: m["hit"]), link)
    unlinked = F.array_join(F.transform(cut, lambda m: F.when(m["hit"], blank(m["text"])).otherwise(m["text"])), "")
    free = X.matches(unlinked, R.BARE_URL)
    linked = F.transform(
        F.filter(links, lambda k: k["bang"] != "!"),
        lambda k, i: _draft(
            rank=1,
            seq=i,
            type="reference",
            content=k["url"],
            start=k["start"],
            end=k["end"],
            uri=k["url"],
            title=X.strip(k["label"]),
            confidence=1.0,
            method="deterministic",
            agent=S.LINK_AGENT,
        ),
    )

    def plain(u, i):
        uri = F.regexp_replace(u["text"], r"[.,;:!?]+$", "")
        return _draft(
            rank=1,
            seq=i + F.lit(1_000_000),
            type="reference",
            content=uri,
            start=u["start"],
            end=(u["start"] + F.length(uri)).cast("int"),
            uri=uri,
            confidence=1.0,
            method="deterministic",
            agent=S.LINK_AGENT,
        )

    drafts = F.concat(linked, F.transform(free, plain))
    has_url = F.contains(prose, F.lit("http://")) | F.contains(prose, F.lit("https://"))
    return F.when(has_url, drafts).otherwise(F.array().cast(_DRAFTS))


def _hit(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + X.ascii_words(pattern))



def classify(text: Column, role: Column) -> Column:
    """The first matching rule of a segment as struct(type, strength, status, confidence), or null."""

    def hit(kind, confidence, strength=None, status=None):
        return F.struct(
            F.lit(kind).alias("type"),
            F.lit(strength).cast("string").alias("strength"),
            F.lit(status).cast("string").alias("status"),
            F.lit(R.CONFIDENCE[confidence]).alias("confidence"),
        )

    proposals = F.when(_hit(text, R.DECISION), hit("decision", "decision_proposed", status="proposed"))
    binding = (
        F.when(_hit(text, R.SHOULD_NOT), hit("constraint", "constraint_soft", strength="should_not"))
        .when(_hit(text, R.MUST_NOT), hit("constraint", "constraint_strong", strength="must_not"))
        .when(_hit(text, R.MUST), hit("constraint", "constraint_strong", strength="must"))
        .when(_hit(text, R.SHOULD), hit("constraint", "constraint_soft", strength="should"))
    )
    rest = (
        F.when(_hit(text, R.PREFERENCE), hit("preference", "preference"))
        .when(_hit(text, R.DECISION), hit("decision", "decision", status="accepted"))
        .when(_hit(text, R.TASK), hit("task", "task", status="open"))
        .when(_hit(text, R.FACT), hit("fact", "fact"))
    )
    ruled = F.when(_hit(text, R.NEGATED_COGNITION), rest).otherwise(F.coalesce(binding, rest))
    return (
        F.when(role == "tool", F.lit(None))
        .when(role == "assistant", proposals)
        .when(F.endswith(text, F.lit("?")), hit("question", "question"))
        .otherwise(ruled)
    )


def statement_drafts(t: "TurnColumns") -> Column:
    """At most one item per segment, by the rule chain."""

    found = F.filter(
        segments(t.prose, lambda piece: _hit(piece, R.QUICK)), lambda s: X.u16_length(s["text"]) <= R.MAX_SEGMENT
    )
    ruled = F.filter(
        F.transform(found, lambda s: F.struct(s.alias("s"), classify(s["text"], t.role).alias("r"))),
        lambda x: x["r"].isNotNull(),
    )
    drafts = F.transform(
        ruled,
        lambda x, i: _draft(
            rank=2,
            seq=i,
            type=x["r"]["type"],
            content=x["s"]["text"],
            start=x["s"]["start"],
            end=x["s"]["end"],
            strength=x["r"]["strength"],
            status=x["r"]["status"],
            confidence=x["r"]["confidence"],
            method="heuristic",
            agent=S.RULE_AGENT,
        ),
    )
    return F.when((t.role == "tool") | ~_hit(t.prose, R.QUICK), F.array().cast(_DRAFTS)).otherwise(drafts)


@dataclass(frozen=True)
class TurnColumns:
    """What an extractor sees of a turn: column expressions, not values."""

    content: Column
    prose: Column
    role: Column


@dataclass(frozen=True)
class Extractor:
    """A registered per-turn rule. The order in the list is the order of "first wins"."""

    name: str
    drafts: Callable[[TurnColumns], Column]


DEFAULT_EXTRACTORS: tuple[Extractor, ...] = (
    Extractor("code", code_drafts),
    Extractor("references", reference_drafts),
    Extractor("statements", statement_drafts),
)


@lru_cache(maxsize=32)
def _all_drafts(extractors: tuple["Extractor", ...], jvm: int) -> Column:
    """One array of the drafts of all extractors. The expression names columns only,
    so it is built once per JVM and reused by every plan."""
    cols = TurnColumns(F.col("content"), F.col("__prose"), F.col("role"))
    arrays = [_ranked(ex.drafts(cols), position) for position, ex in enumerate(extractors)]
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def _ranked(drafts: Column, position: int) -> Column:
    return F.transform(drafts, lambda d: d.withField("rank", F.lit(position)))


TURN_KEYS = ("doc_id", "conv_id", "conv_pos", "idx", "turn_id", "role")


def extract_items(
    turns: DataFrame, extractors: Sequence[Extractor] = DEFAULT_EXTRACTORS, keep: Sequence[str] = ()
) -> DataFrame:
    """All items of all turns with provenance, before de-duplication.

    The turn text is projected away before the explode: only ids and the
    pieces themselves travel on.
    """
    keys = [c for c in (*TURN_KEYS, *keep) if c in turns.columns]
    prepared = turns.select(*keys, "content", mask_fences(F.col("content")).alias("__prose"))
    drafts = _all_drafts(tuple(extractors), id(SparkContext._jvm))
    rows = prepared.select(*keys, F.explode(drafts).alias("d")).select(*keys, "d.*")
    return rows.withColumn(
        "item_id", X.stable_id("itm", *[F.col(c) for c in ("turn_id", "type", "start", "end", "content")])
    )


def segment_rows(turns: DataFrame) -> DataFrame:
    """The segment splitter as a table: one row per segment of each turn."""
    keys = [c for c in TURN_KEYS if c in turns.columns]
    return turns.select(
        *keys, F.posexplode(segments(mask_fences(F.col("content")))).alias("seq", "s")
    ).select(*keys, "seq", "s.*")


def fenced_rows(turns: DataFrame) -> DataFrame:
    keys = [c for c in TURN_KEYS if c in turns.columns]
    return turns.select(*keys, F.posexplode(fenced_blocks(F.col("content"))).alias("seq", "b")).select(
        *keys, "seq", "b.*"
    )


def annotate(items: DataFrame) -> DataFrame:
    """Attribution of rule items: origin is the role of the turn, assertion what rules can know."""
    return items.withColumn("origin", F.coalesce(F.col("role"), F.lit("unknown"))).withColumn(
        "assertion",
        F.when(F.col("method") == "deterministic", F.lit("explicit"))
        .when((F.col("type") == "decision") & (F.col("status") == "proposed"), F.lit("suggested"))
        .otherwise(F.lit("unknown")),
    )
