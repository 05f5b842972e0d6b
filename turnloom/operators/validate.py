"""Data-quality checks of documents as one issues table: (doc_id, severity, code, path).

Works on flat tables, one row per document / conversation / turn / item, so a
document of any size is checked by joins on its ids. Nothing here throws: bad
input becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.functions import text as X
from turnloom.session import cut
from turnloom.sources.turns import ISO, iso_timestamp

ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
VERSION = r"^\d{1,4}\.\d{1,4}$"
VERSION_FIELD = "context_version"
BLOCKING = ("invalid_extension", "unknown_item", "unknown_turn")


@dataclass(frozen=True)
class Tables:
    """docs(doc_id, id, version, is_object, created_at, updated_at; has_conversations, has_items)
    conversations(doc_id, ci, id, kind, platform, captured_at; has_turns)
    turns(doc_id, ci, ti, id, index, role, content, timestamp)
    items(doc_id, i, id, type, content, confidence, importance, strength, status, language, uri, created_at,
          kind, platform, conversation_id, turn_id, start, end, method, agent, captured_at)"""

    docs: DataFrame
    conversations: DataFrame
    turns: DataFrame
    items: DataFrame


def parse_documents(raw: DataFrame, text: str = "raw") -> Tables:
    """Untrusted JSON documents as flat tables. `extras` keeps every item as VARIANT, unknown fields included."""
    head = "struct<{v}:string,id:string,metadata:struct<title:string,created_at:string,updated_at:string>," \
        "conversations:array<string>,items:array<string>,extensions:string>".format(v=VERSION_FIELD)
    body = raw.select("doc_id", F.col(text).alias("__t")).select(
        "doc_id",
        F.from_json("__t", head).alias("d"),
        F.coalesce(F.startswith(F.schema_of_variant(X.strict_json(F.col("__t"))), F.lit("OBJECT")), F.lit(False)).alias("is_object"),
        "__t",
    )
    listed = lambda json, path: F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant")), F.lit("ARRAY")), F.lit(False))
    source = "source:struct<kind:string,platform:string,client:string>"
    conv = f"struct<id:string,{source},title:string,url:string,captured_at:string,turns:array<string>>"
    turn = "struct<id:string,index:int,role:string,content:string,timestamp:string>"
    item = (
        "struct<id:string,type:string,content:string,confidence:double,importance:double,strength:string,status:string,"
        f"language:string,uri:string,created_at:string,provenance:struct<{source},conversation_id:string,turn_id:string,"
        "span:struct<start:int,end:int>,captured_at:string,extracted_by:struct<method:string,agent:string>>>"
    )
    docs = body.select(
        "doc_id",
        "d.id",
        F.col(f"d.{VERSION_FIELD}").alias("version"),
        "is_object",
        F.col("d.metadata.created_at").alias("created_at"),
        F.col("d.metadata.updated_at").alias("updated_at"),
        listed("__t", "$.conversations").alias("has_conversations"),
        listed("__t", "$.items").alias("has_items"),
    )
    convs = body.select("doc_id", F.posexplode("d.conversations").alias("ci", "j")).select(
        "doc_id", "ci", F.from_json("j", conv).alias("c"), listed("j", "$.turns").alias("has_turns")
    )
    turns = convs.select("doc_id", "ci", F.posexplode("c.turns").alias("ti", "j")).select(
        "doc_id", "ci", "ti", F.from_json("j", turn).alias("t")
    )
    items = body.select("doc_id", F.posexplode("d.items").alias("i", "j")).select(
        "doc_id", "i", F.from_json("j", item).alias("x"), F.try_parse_json("j").alias("extras")
    )
    p = F.col("x.provenance")
    return Tables(
        docs,
        convs.select(
            "doc_id", "ci", "c.id", F.col("c.source.kind").alias("kind"), F.col("c.source.platform").alias("platform"), "c.captured_at", "has_turns"
        ),
        turns.select("doc_id", "ci", "ti", "t.*"),
        items.select(
            "doc_id",
            "i",
            *[f"x.{c}" for c in "id type content confidence importance strength status language uri created_at".split()],
            p["source"]["kind"].alias("kind"),
            p["source"]["platform"].alias("platform"),
            p["conversation_id"].alias("conversation_id"),
            p["turn_id"].alias("turn_id"),
            p["span"]["start"].alias("start"),
            p["span"]["end"].alias("end"),
            p["extracted_by"]["method"].alias("method"),
            p["extracted_by"]["agent"].alias("agent"),
            p["captured_at"].alias("captured_at"),
            "extras",
        ),
    )


def stored(t: Tables) -> Tables:
    """The tables written once: a validation joins them many times and must not parse again each time."""
    return Tables(*[cut(x) for x in (t.docs, t.conversations, t.turns, t.items)])


def document_turns(t: Tables) -> DataFrame:
    """Turns of parsed documents in the extractors' layout; ids and indexes are kept."""
    conv = t.conversations.select("doc_id", "ci", F.col("id").alias("conv_id"))
    return t.turns.join(conv, ["doc_id", "ci"]).select(
        "doc_id", "conv_id", F.col("ci").cast("bigint").alias("conv_pos"), F.col("index").alias("idx"), F.col("id").alias("turn_id"), "role", "content"
    )


def _issue(severity: str, code: str, path: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.alias("path"))


def _when(cond: Column, code: str, path: Column, severity: str = "error") -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), _issue(severity, code, path))


def _emit(df: DataFrame, *checks: Column) -> DataFrame:
    return df.select("doc_id", F.explode(F.array_compact(F.array(*checks))).alias("x")).select("doc_id", "x.*")


def _path(pattern: str, *cols: str) -> Column:
    return F.format_string(pattern, *[F.col(c).cast("bigint") for c in cols])


def version_state(version: Column, is_object: Column, current: str = S.FORMAT_VERSION) -> Column:
    """Outcome of the version gate; `current` and `newer_minor_version` may pass."""
    major, minor = (int(x) for x in current.split("."))
    mj = F.split_part(version, F.lit("."), F.lit(1)).try_cast("int")
    mn = F.split_part(version, F.lit("."), F.lit(2)).try_cast("int")
    return (
        F.when(~is_object, F.lit("not_an_object"))
        .when(version.isNull(), F.lit("missing_version"))
        .when(~version.rlike(VERSION), F.lit("invalid_version"))
        .when(mj != major, F.lit("unsupported_major_version"))
        .when(mn < minor, F.lit("requires_upgrade"))
        .when(mn > minor, F.lit("newer_minor_version"))
        .otherwise(F.lit("current"))
    )


def version_issues(docs: DataFrame) -> DataFrame:
    state = version_state(F.col("version"), F.col("is_object"))
    path = F.when(F.col("state") == "not_an_object", F.lit("$")).otherwise(F.lit(f"$.{VERSION_FIELD}"))
    level = F.when(F.col("state") == "newer_minor_version", F.lit("warning")).otherwise(F.lit("error"))
    return docs.withColumn("state", state).filter("state <> 'current'").select(
        "doc_id", level.alias("severity"), F.col("state").alias("code"), path.alias("path")
    )


def structural_issues(t: Tables) -> DataFrame:
    """Required fields, vocabularies, ranges and formats; the checks of a row are one array."""

    def ts(c, path, optional=False):
        bad = ~c.rlike(ISO) if optional else (c.isNull() | ~c.rlike(ISO))
        return _when(bad, "invalid_timestamp", path)

    def ident(c, path):
        return _when(c.isNull() | ~c.rlike(ID), "schema", path)

    def among(c, values, path, optional=False):
        bad = c.isNotNull() & ~c.isin(*values) if optional else (c.isNull() | ~c.isin(*values))
        return _when(bad, "schema", path)

    col = F.col
    doc = _emit(
        t.docs,
        ident(col("id"), F.lit("$.id")),
        ts(col("created_at"), F.lit("$.metadata.created_at")),
        ts(col("updated_at"), F.lit("$.metadata.updated_at")),
        *[_when(~col(c), "schema", F.lit(f"$.{c[4:]}")) for c in ("has_conversations", "has_items") if c in t.docs.columns],
    )
    cp = lambda f: _path(f"$.conversations[%d].{f}", "ci")
    conv = _emit(
        t.conversations,
        ident(col("id"), cp("id")),
        among(col("kind"), S.SOURCE_KINDS, cp("source.kind")),
        _when(F.coalesce(F.length("platform"), F.lit(0)) == 0, "schema", cp("source.platform")),
        ts(col("captured_at"), cp("captured_at")),
        *([_when(~col("has_turns"), "schema", cp("turns"))] if "has_turns" in t.conversations.columns else []),
    )
    tp = lambda f: _path(f"$.conversations[%d].turns[%d].{f}", "ci", "ti")
    turn = _emit(
        t.turns,
        ident(col("id"), tp("id")),
        _when(col("index").isNull() | (col("index") < 0), "schema", tp("index")),
        among(col("role"), S.ROLES, tp("role")),
        _when(col("content").isNull(), "schema", tp("content")),
        ts(col("timestamp"), tp("timestamp"), optional=True),
    )
    ip = lambda f: _path(f"$.items[%d].{f}", "i")
    kind = col("type")
    item = _emit(
        t.items.filter(col("type").isNull() | col("type").isin(*S.ITEM_TYPES)),
        ident(col("id"), ip("id")),
        _when(kind.isNull(), "schema", ip("type")),
        _when(F.coalesce(F.length("content"), F.lit(0)) == 0, "schema", ip("content")),
        _when(col("confidence").isNull() | ~col("confidence").between(0, 1), "schema", ip("confidence")),
        _when(~col("importance").between(0, 1), "schema", ip("importance")),
        _when((kind == "constraint") & (col("strength").isNull() | ~col("strength").isin(*S.STRENGTHS)), "schema", ip("strength")),
        _when((kind == "decision") & ~col("status").isin(*S.DECISION_STATUS), "schema", ip("status")),
        _when((kind == "task") & (col("status").isNull() | ~col("status").isin(*S.TASK_STATUS)), "schema", ip("status")),
        _when((kind == "question") & ~col("status").isin(*S.QUESTION_STATUS), "schema", ip("status")),
        _when((kind == "code_artifact") & col("language").isNull(), "schema", ip("language")),
        _when((kind == "reference") & (F.coalesce(F.length("uri"), F.lit(0)) == 0), "schema", ip("uri")),
        ts(col("created_at"), ip("created_at")),
        among(col("kind"), S.SOURCE_KINDS, ip("provenance.source.kind")),
        among(col("method"), S.METHODS, ip("provenance.extracted_by.method")),
        _when(F.coalesce(F.length("agent"), F.lit(0)) == 0, "schema", ip("provenance.extracted_by.agent")),
        ts(col("captured_at"), ip("provenance.captured_at")),
        _when((col("start") < 0) | (col("start").isNull() != col("end").isNull()), "schema", ip("provenance.span")),
    )
    return reduce(DataFrame.unionByName, (doc, conv, turn, item))


def unknown_types(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Error at the current version; a warning, and the item is left out, at a newer minor one."""
    state = docs.select("doc_id", version_state(F.col("version"), F.col("is_object")).alias("state"))
    odd = items.filter(F.col("type").isNotNull() & ~F.col("type").isin(*S.ITEM_TYPES)).join(state, "doc_id")
    level = F.when(F.col("state") == "newer_minor_version", F.lit("warning")).otherwise(F.lit("error"))
    return odd.select("doc_id", level.alias("severity"), F.lit("unknown_item_type").alias("code"), _path("$.items[%d].type", "i").alias("path"))


def calendar_issues(t: Tables) -> DataFrame:
    def bad(c, path):
        return _when(c.isNotNull() & iso_timestamp(c).isNull(), "invalid_timestamp", path)

    created, updated = F.col("created_at"), F.col("updated_at")
    doc = _emit(
        t.docs,
        bad(created, F.lit("$.metadata.created_at")),
        bad(updated, F.lit("$.metadata.updated_at")),
        _when(iso_timestamp(updated) < iso_timestamp(created), "timestamp_order", F.lit("$.metadata.updated_at"), "warning"),
    )
    conv = _emit(t.conversations, bad(F.col("captured_at"), _path("$.conversations[%d].captured_at", "ci")))
    turn = _emit(t.turns, bad(F.col("timestamp"), _path("$.conversations[%d].turns[%d].timestamp", "ci", "ti")))
    item = _emit(
        t.items,
        bad(created, _path("$.items[%d].created_at", "i")),
        bad(F.col("captured_at"), _path("$.items[%d].provenance.captured_at", "i")),
    )
    return reduce(DataFrame.unionByName, (doc, conv, turn, item))


def claims(t: Tables) -> DataFrame:
    """Every id a document uses, in claim order (one namespace)."""
    rank = F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("x"), F.lit(-1).alias("y"))
    d = t.docs.select("doc_id", "id", rank.alias("at"), F.lit("id").alias("path"))
    c = t.conversations.select(
        "doc_id", "id", F.struct(F.lit(1).alias("k"), F.col("ci").cast("bigint").alias("x"), F.lit(-1).alias("y")).alias("at"),
        _path("conversations.%d", "ci").alias("path"),
    )
    u = t.turns.select(
        "doc_id", "id", F.struct(F.lit(1).alias("k"), F.col("ci").cast("bigint").alias("x"), F.col("ti").cast("int").alias("y")).alias("at"),
        _path("conversations.%d.turns.%d", "ci", "ti").alias("path"),
    )
    i = t.items.select(
        "doc_id", "id", F.struct(F.lit(2).alias("k"), F.col("i").cast("bigint").alias("x"), F.lit(-1).alias("y")).alias("at"),
        _path("items.%d", "i").alias("path"),
    )
    return reduce(DataFrame.unionByName, (d, c, u, i))


def duplicate_ids(t: Tables) -> DataFrame:
    """Second and later uses of an id. The first use is a map-side minimum, joined back."""
    used = claims(t)
    first = used.groupBy("doc_id", "id").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    late = used.join(first, ["doc_id", "id"]).filter(F.col("at") != F.col("first_at"))
    path = F.regexp_replace(F.concat(F.lit("$."), "path", F.lit(".id")), r"\.(\d+)", "[$1]")
    return late.select("doc_id", F.lit("error").alias("severity"), F.lit("duplicate_id").alias("code"), path.alias("path"))


def duplicate_turn_indexes(turns: DataFrame) -> DataFrame:
    first = turns.groupBy("doc_id", "ci", "index").agg(F.min("ti").alias("first_ti"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    late = turns.join(first, ["doc_id", "ci", "index"]).filter(F.col("ti") > F.col("first_ti"))
    return late.select(
        "doc_id", F.lit("error").alias("severity"), F.lit("duplicate_turn_index").alias("code"),
        _path("$.conversations[%d].turns[%d].index", "ci", "ti").alias("path"),
    )


def reference_issues(t: Tables) -> DataFrame:
    """Provenance against the conversations and turns of the document, and span bounds."""
    conv = t.conversations.groupBy("doc_id", F.col("id").alias("conversation_id")).agg(
        F.max_by("kind", "ci").alias("c_kind"), F.max_by("platform", "ci").alias("c_platform")
    )
    # one owner per turn id, and the turn inside the named conversation
    named = t.conversations.select("doc_id", "ci", F.col("id").alias("owner"))
    owned = t.turns.select("doc_id", "ci", F.col("id").alias("turn_id"), X.u16_length(F.col("content")).alias("size")).join(
        named, ["doc_id", "ci"]
    )
    inside = owned.groupBy("doc_id", F.col("owner").alias("conversation_id"), "turn_id").agg(F.max("size").alias("turn_size"))
    anywhere = owned.groupBy("doc_id", "turn_id").agg(F.max("owner").alias("owner"))
    joined = (
        t.items.filter(F.col("type").isin(*S.ITEM_TYPES))
        .join(conv, ["doc_id", "conversation_id"], "left")
        .join(inside, ["doc_id", "conversation_id", "turn_id"], "left")
        .join(anywhere, ["doc_id", "turn_id"], "left")
    )
    ip = lambda f: _path(f"$.items[%d].provenance.{f}", "i")
    col = F.col
    known, has_turn = col("c_kind").isNotNull(), col("turn_id").isNotNull()
    cited = col("conversation_id").isNotNull()
    spanned = col("start").isNotNull()
    return _emit(
        joined,
        _when(cited & ~known, "unknown_conversation", ip("conversation_id")),
        _when(known & ((col("c_kind") != col("kind")) | (col("c_platform") != col("platform"))), "source_mismatch", ip("source"), "warning"),
        _when(has_turn & ~cited, "turn_without_conversation", ip("turn_id")),
        _when(has_turn & known & col("turn_size").isNull() & col("owner").isNotNull(), "turn_not_in_conversation", ip("turn_id")),
        _when(has_turn & known & col("turn_size").isNull() & col("owner").isNull(), "unknown_turn", ip("turn_id")),
        _when(spanned & ~has_turn, "span_without_turn", ip("span")),
        _when(spanned & has_turn & ((col("end") <= col("start")) | (col("end") > col("turn_size"))), "invalid_span", ip("span")),
    )


def validate(t: Tables) -> DataFrame:
    """All issues. The version gate stops a document; structural errors stop its cross checks.

    Every check runs once over its whole table and carries its stage; what a document was
    stopped before is dropped at the end, with one join on a small table of stops.
    """
    known = Tables(t.docs, t.conversations, t.turns, t.items.filter(F.col("type").isin(*S.ITEM_TYPES)))
    gate, structure = version_issues(t.docs), structural_issues(t)
    stages = (
        (0, gate),
        (1, unknown_types(t.items, t.docs)),
        (2, structure),
        (3, calendar_issues(known)),
        (3, duplicate_ids(known)),
        (3, duplicate_turn_indexes(known.turns)),
        (3, reference_issues(known)),
    )
    found = reduce(DataFrame.unionByName, (x.withColumn("stage", F.lit(n)) for n, x in stages))
    stops = (
        gate.filter("severity = 'error'").select("doc_id", F.lit(0).alias("last"))
        .unionByName(structure.select("doc_id", F.lit(2).alias("last")))
        .groupBy("doc_id").agg(F.min("last").alias("last"))
    )
    return found.join(stops, "doc_id", "left").filter(F.col("stage") <= F.coalesce("last", F.lit(9))).select(
        "doc_id", "severity", "code", "path"
    )


def extension_issues(items: DataFrame, turns: DataFrame, annotations: DataFrame, relations: DataFrame) -> DataFrame:
    """Checks of annotations(item_id, origin, assertion, evidence) and relations against their document."""
    vocab = annotations.filter(
        ~F.coalesce(F.col("origin").isin(*S.ORIGINS), F.lit(False)) | ~F.coalesce(F.col("assertion").isin(*S.ASSERTIONS), F.lit(False))
    ).select("doc_id", F.lit("invalid_extension").alias("code"), F.col("item_id").alias("ref"))
    ids = items.select("doc_id", "item_id")
    lost = annotations.join(ids, ["doc_id", "item_id"], "left_anti").select(
        "doc_id", F.lit("unknown_item").alias("code"), F.col("item_id").alias("ref")
    )
    cited = annotations.select(
        "doc_id", "item_id", "origin", "assertion", F.posexplode("evidence").alias("epos", "e")
    ).select("doc_id", "item_id", "origin", "assertion", "epos", "e.turn_id", "e.start", "e.end")
    placed = cited.join(
        turns.select("doc_id", "turn_id", F.col("role").alias("t_role"), X.u16_length(F.col("content")).alias("size")),
        ["doc_id", "turn_id"], "left",
    )
    code = (
        F.when(F.col("t_role").isNull(), F.lit("unknown_turn"))
        .when(F.col("start").isNotNull() & ((F.col("end") <= F.col("start")) | (F.col("end") > F.col("size"))), F.lit("invalid_span"))
    )
    wrong = placed.select("doc_id", code.alias("code"), F.col("item_id").alias("ref")).filter("code is not null")
    swapped = placed.filter(
        (F.col("epos") == 0) & F.col("t_role").isNotNull() & (F.col("origin") != "unknown")
        & (F.col("t_role") != F.col("origin")) & (F.col("assertion") != "quoted")
    ).select("doc_id", F.lit("origin_mismatch").alias("code"), F.col("item_id").alias("ref"))
    a = ids.select("doc_id", F.col("item_id").alias("from"), F.lit(1).alias("__a"))
    b = ids.select("doc_id", F.col("item_id").alias("to"), F.lit(1).alias("__b"))
    dangling = relations.join(a, ["doc_id", "from"], "left").join(b, ["doc_id", "to"], "left").filter(
        F.col("__a").isNull() | F.col("__b").isNull()
    ).select("doc_id", F.lit("unknown_relation_target").alias("code"), F.concat_ws("→", "from", "to").alias("ref"))
    return reduce(DataFrame.unionByName, (vocab, lost, wrong, swapped, dangling))


def split_blocking(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues that keep a document from being saved, and the ones that only warn."""
    return issues.filter(F.col("code").isin(*BLOCKING)), issues.filter(~F.col("code").isin(*BLOCKING))


def format_issue(message: Column | None = None) -> Column:
    tail = F.concat(F.lit(": "), message) if message is not None else F.lit("")
    return F.concat(F.upper("severity"), F.lit(" "), F.col("code"), F.lit(" at "), F.col("path"), tail)


@dataclass(frozen=True)
class Upgrade:
    """A registered step of the upgrade chain: a transform of the documents of one version."""

    source: str
    target: str
    apply: Callable[[DataFrame], DataFrame]


def upgrade(docs: DataFrame, chain: list[Upgrade], current: str = S.FORMAT_VERSION) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, version, ...) moved along the chain, and the ones without a path.

    Steps are followed on the registry, not per row: each version has one next step.
    """
    cycles = set()
    for start in chain:
        seen, at = {start.source}, start.target
        while (step := next((u for u in chain if u.source == at), None)) is not None:
            if at in seen:
                cycles.add(start.source)
                break
            seen.add(at)
            at = step.target
    state = version_state(F.col("version"), F.lit(True), current)
    out = docs.withColumn("applied", F.array().cast("array<string>"))
    for _ in range(len(chain)):
        for step in chain:
            if step.source in cycles:
                continue
            hit = (F.col("version") == step.source) & ~state.isin("current", "newer_minor_version")
            moved = step.apply(out.filter(hit)).withColumn("version", F.lit(step.target)).withColumn(
                "applied", F.concat("applied", F.array(F.lit(f"{step.source}→{step.target}")))
            )
            out = out.filter(~F.coalesce(hit, F.lit(False))).unionByName(moved)
    coded = out.withColumn(
        "code",
        F.when(F.col("version").isin(*sorted(cycles)) if cycles else F.lit(False), F.lit("upgrade_cycle"))
        .when(state == "unsupported_major_version", F.lit("unsupported_major_version"))
        .when(state == "requires_upgrade", F.lit("no_upgrade_path")),
    )
    return coded.filter("code is null").drop("code"), coded.filter("code is not null").select("doc_id", "version", "code")
