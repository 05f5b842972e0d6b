"""Whole documents written and read back, with annotations, relations and fields this engine doesn't know.

An archive is flat tables. Each row becomes one JSON text; ordered, these texts are
fragments that concatenate to the document. Documents up to a size are written as
one JSON line each; longer ones stay ordered fragments, so no task holds more than
that size. Both are read back through the same per-record readers. Unknown fields
travel as VARIANT in `open`. Spans are code points here and UTF-16 units in a document.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import schema as S
from turnloom.functions import text as X
from turnloom.session import cut

EXTENSION = "turnloom.semantic"
WHOLE = 64 << 20  # characters of a document that is written as one line
SPAN = "struct<start:int,end:int>"
EVIDENCE = f"array<struct<turn_id:string,span:{SPAN}>>"
HEAD = "id:string,context_version:string,metadata:struct<title:string,description:string,created_at:string,updated_at:string,created_by:struct<agent:string>,tags:array<string>>"
CONVERSATION = "id:string,source:struct<kind:string,platform:string>,title:string,url:string,captured_at:string"
TURN = "id:string,index:int,role:string,content:string,timestamp:string,attachments:variant"
ITEM = (
    "id:string,type:string,content:string,confidence:double,importance:double,tags:array<string>,strength:string,status:string,language:string,"
    f"filename:string,uri:string,title:string,provenance:struct<source:struct<kind:string,platform:string>,conversation_id:string,turn_id:string,span:{SPAN},"
    "captured_at:string,extracted_by:struct<method:string,agent:string>>,created_at:string"
)
NOTE = f"origin:string,assertion:string,evidence:{EVIDENCE},extractors:array<string>,merged_from:array<struct<extractor:string,type:string,content:string,confidence:double>>"
RELATION = "type:string,from:string,to:string,source:string"
ORDER = ["doc_id", "part", "p1", "p2", "name"]


@dataclass(frozen=True)
class Archive:
    """Tables keyed by doc_id. A `record` is a struct of the fields of HEAD, CONVERSATION, ...; `open` the others.

    docs(doc_id, record, open), conversations(doc_id, ci, record, open), turns(doc_id, ci, ti, record, open),
    items(doc_id, i, record, open), annotations(doc_id, item_id, record, open), relations(doc_id, r, record, open).
    Orders are whole numbers, unique within a document (turns: within a conversation).
    """

    docs: DataFrame
    conversations: DataFrame
    turns: DataFrame
    items: DataFrame
    annotations: DataFrame
    relations: DataFrame


KEYS = {"docs": [], "conversations": ["ci"], "turns": ["ci", "ti"], "items": ["i"], "annotations": ["item_id"], "relations": ["r"]}
SHAPES = {"docs": HEAD, "conversations": CONVERSATION, "turns": TURN, "items": ITEM, "annotations": NOTE, "relations": RELATION}
HOLDS = {"docs": ("conversations", "items", "extensions"), "conversations": ("turns",)}  # fields that are records of their own


def record(shape: str, **values: Column) -> Column:
    """A record of a shape; fields that are not named are null."""
    return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _fields(shape)])


def _fields(shape: str) -> list[tuple[str, str]]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(shape + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = (shape + ",")[at:i].split(":", 1)
            out.append((name, kind))
            at = i + 1
    return out


def record_json() -> Column:
    """The record and its open fields as one JSON object; null fields are absent."""
    known, more = F.to_json("record"), F.to_json("open")
    both = F.concat(F.substr(known, F.lit(1), F.length(known) - 1), F.when(known == "{}", "").otherwise(","), F.substr(more, F.lit(2)))
    return F.when(F.col("open").isNull() | (more == "{}"), known).otherwise(both)


def read_record(json: Column, table: str) -> list[Column]:
    """`record` and `open` from the JSON of a record."""
    known = [n for n, _ in _fields(SHAPES[table])] + list(HOLDS.get(table, ()))
    others = F.map_filter(F.try_parse_json(json).cast("map<string,variant>"), lambda k, _: ~k.isin(*known))
    return [F.from_json(json, f"struct<{SHAPES[table]}>").alias("record"), F.when(F.size(others) > 0, F.to_variant_object(others)).alias("open")]


def fragments(a: Archive) -> DataFrame:
    """(doc_id, part, p1, p2, name, text): in this order the texts of a document are its JSON."""
    none = F.lit(0).cast("bigint")

    def rows(df, part, text, p1=none, p2=none, name=F.lit("")):
        return df.select("doc_id", F.lit(part).alias("part"), p1.cast("bigint").alias("p1"), p2.cast("bigint").alias("p2"), name.alias("name"), text.alias("text"))

    def listed(df, *keys):
        """With `comma`, empty on the first row of each list."""
        order = F.col(keys[-1])
        first = df.groupBy("doc_id", *keys[:-1]).agg(F.min(order).alias("__first"))
        return df.join(first, ["doc_id", *keys[:-1]]).withColumn("comma", F.when(order == F.col("__first"), "").otherwise(","))

    entry = F.to_json(F.create_map("item_id", F.lit(0)))
    name = F.substr(entry, F.lit(2), F.length(entry) - 3)  # "id": as JSON spells it
    opened = lambda tail: F.concat(F.left(record_json(), F.length(record_json()) - 1), F.lit(tail))
    conv, turn, item = listed(a.conversations, "ci"), listed(a.turns, "ci", "ti"), listed(a.items, "i")
    note, edge = listed(a.annotations, "item_id"), listed(a.relations, "r")
    ids = a.docs.select("doc_id")
    parts = (
        rows(a.docs, 0, opened(',"conversations":[')),
        rows(conv, 1, F.concat("comma", opened(',"turns":[')), F.col("ci"), F.lit(-1)),
        rows(turn, 1, F.concat("comma", record_json()), F.col("ci"), F.col("ti")),
        rows(conv, 1, F.lit("]}"), F.col("ci"), F.lit((1 << 63) - 1)),
        rows(ids, 2, F.lit('],"items":[')),
        rows(item, 3, F.concat("comma", record_json()), F.col("i")),
        rows(ids, 4, F.lit('],"extensions":{"' + EXTENSION + '":{"version":1,"items":{')),
        rows(note, 5, F.concat("comma", name, record_json()), name=F.col("item_id")),
        rows(ids, 6, F.lit('},"relations":[')),
        rows(edge, 7, F.concat("comma", record_json()), F.col("r")),
        rows(ids, 8, F.lit("]}}}")),
    )
    return reduce(DataFrame.unionByName, parts)


def documents(pieces: DataFrame) -> DataFrame:
    """(doc_id, raw): the whole text of each document."""
    whole = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER[1:], "text"))).alias("f"))
    return whole.select("doc_id", F.array_join(F.transform("f", lambda x: x["text"]), "").alias("raw"))


def write(a: Archive, path: str, whole: int = WHOLE) -> None:
    """`path/fragments` (Parquet, in order), and `path/documents` with a JSON line per document of at most `whole` characters.

    What is written as a line leaves the fragments, so each document is read from one place.
    """
    spark = a.docs.sparkSession
    a = replace(a, items=cut(a.items), annotations=cut(a.annotations), relations=cut(a.relations))  # each is read twice below
    fragments(a).write.mode("overwrite").parquet(f"{path}/staged")
    pieces = spark.read.parquet(f"{path}/staged")
    sizes = pieces.groupBy("doc_id").agg(F.sum(F.length("text")).alias("size"))
    small = pieces.join(sizes.filter(F.col("size") <= whole).select("doc_id"), "doc_id", "left_semi")
    large = pieces.join(sizes.filter(F.col("size") > whole).select("doc_id"), "doc_id", "left_semi")
    lines = documents(small).select(F.to_json(F.struct("doc_id", F.parse_json("raw").alias("document"))).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/documents")
    large.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.mode("overwrite").parquet(f"{path}/fragments")


def parse(raw: DataFrame) -> Archive:
    """Documents (doc_id, raw) as an archive. A text that is no JSON object has no rows; `validate` reports it."""
    shape = "struct<conversations:array<string>,items:array<string>,extensions:map<string,struct<items:map<string,string>,relations:array<string>>>>"
    is_object = F.startswith(F.schema_of_variant(X.strict_json(F.col("raw"))), F.lit("OBJECT"))
    body = raw.filter(is_object).select("doc_id", "raw", F.from_json("raw", shape).alias("d"))
    convs = body.select("doc_id", F.posexplode("d.conversations").alias("ci", "json"))
    turns = convs.select("doc_id", "ci", F.from_json("json", "struct<turns:array<string>>").alias("c")).select("doc_id", "ci", F.posexplode("c.turns").alias("ti", "json"))
    items = body.select("doc_id", F.posexplode("d.items").alias("i", "json"))
    ext = body.select("doc_id", F.try_element_at("d.extensions", F.lit(EXTENSION)).alias("e"))
    notes = ext.select("doc_id", F.explode("e.items").alias("item_id", "json"))
    edges = ext.select("doc_id", F.posexplode("e.relations").alias("r", "json"))
    return _archive(docs=body.select("doc_id", F.col("raw").alias("json")), conversations=convs, turns=turns, items=items, annotations=notes, relations=edges)


def parse_fragments(pieces: DataFrame) -> Archive:
    """Fragments as an archive, each record on its own."""
    bare = F.regexp_replace("text", "^,", "")

    def part(n, json, *keys):
        return pieces.filter(F.col("part") == n).select("doc_id", *keys, json.alias("json"))

    named = lambda c, n: F.col(c).alias(n)
    convs = part(1, F.concat(bare, F.lit("]}")), named("p1", "ci"), named("p2", "p2")).filter("p2 = -1").drop("p2")
    turns = part(1, bare, named("p1", "ci"), named("p2", "ti")).filter((F.col("ti") >= 0) & (F.col("ti") < (1 << 63) - 1))
    note = F.concat(F.lit("{"), bare, F.lit("}"))
    notes = part(5, F.get(F.map_values(F.from_json(note, "map<string,string>")), F.lit(0)), named("name", "item_id"))
    return _archive(
        docs=part(0, F.concat("text", F.lit("]}"))), conversations=convs, turns=turns, items=part(3, bare, named("p1", "i")), annotations=notes,
        relations=part(7, bare, named("p1", "r")),
    )


def _archive(**texts: DataFrame) -> Archive:
    return Archive(**{
        n: df.select("doc_id", *[F.col(k) if k == "item_id" else F.col(k).cast("bigint").alias(k) for k in KEYS[n]], *read_record(F.col("json"), n)) for n, df in texts.items()
    })


def read(spark: SparkSession, path: str) -> Archive:
    """What `write` has written."""
    lines = spark.read.text(f"{path}/documents").select(F.from_json("value", "struct<doc_id:string,document:string>").alias("v")).select("v.doc_id", F.col("v.document").alias("raw"))
    whole, split = parse(lines), parse_fragments(spark.read.parquet(f"{path}/fragments"))
    return Archive(**{f.name: getattr(whole, f.name).unionByName(getattr(split, f.name)) for f in fields(Archive)})


# -- the engine's tables as an archive, and back ------------------------------------


def _turn_texts(turns: DataFrame) -> DataFrame:
    return turns.select("doc_id", "turn_id", F.col("content").alias("__turn"))


def _converted(rows: DataFrame, turns: DataFrame, offset) -> DataFrame:
    """rows(doc_id, turn_id, start, end) with the offsets converted against their turn."""
    joined = rows.join(_turn_texts(turns), ["doc_id", "turn_id"], "left")
    return joined.withColumns({c: F.when(F.col(c).isNotNull(), offset(F.col("__turn"), F.col(c))).cast("int") for c in ("start", "end")}).drop("__turn")


def _evidence(items: DataFrame, turns: DataFrame, offset) -> DataFrame:
    """(doc_id, item_id, evidence) with converted spans, in order; an item cites few turns."""
    cited = items.select("doc_id", "item_id", F.posexplode("evidence").alias("n", "e")).select("doc_id", "item_id", "n", "e.turn_id", "e.start", "e.end")
    one = F.struct("n", F.struct("turn_id", "start", "end").alias("e"))
    back = _converted(cited, turns, offset).groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    return back.select("doc_id", "item_id", F.transform("s", lambda x: x["e"]).alias("evidence"))


def _wire(e: Column) -> Column:
    span = F.when(e["start"].isNotNull(), F.struct(e["start"].alias("start"), e["end"].alias("end")))
    return F.struct(e["turn_id"].alias("turn_id"), span.alias("span"))


def from_tables(
    envelopes: DataFrame, conversations: DataFrame, turns: DataFrame, items: DataFrame, merged: DataFrame, relations: DataFrame, captured_at: Column, created_at: Column,
    open_fields: dict[str, Column] | None = None,
) -> Archive:
    """Reconciled items (with `i`, their place in the document) and their documents as an archive.

    `open_fields` gives a VARIANT column per table for fields of the caller's own.
    """
    more = lambda n: (open_fields or {}).get(n, F.lit(None).cast("variant")).alias("open")
    docs = envelopes.select("doc_id", record(
        HEAD, id=F.col("context_id"), context_version=F.col("version"),
        metadata=F.struct("title", F.lit(None).cast("string").alias("description"), "created_at", "updated_at", F.struct(F.col("created_by").alias("agent")).alias("created_by"),
                          F.lit(None).cast("array<string>").alias("tags")),
    ).alias("record"), more("docs"))
    convs = conversations.select("doc_id", F.col("conv_pos").alias("ci"), record(
        CONVERSATION, id=F.col("conv_id"), source=F.struct("kind", "platform"), title=F.col("title"), url=F.col("url"), captured_at=F.col("captured_at")
    ).alias("record"), more("conversations"))
    said = turns.select("doc_id", F.col("conv_pos").alias("ci"), F.col("idx").cast("bigint").alias("ti"), record(
        TURN, id=F.col("turn_id"), index=F.col("idx"), role=F.col("role"), content=F.col("content")
    ).alias("record"), more("turns"))
    source = conversations.select("doc_id", "conv_id", "kind", "platform")
    placed = _converted(items.drop("kind", "platform"), turns, X.u16_offset).join(source, ["doc_id", "conv_id"], "left")
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    provenance = F.struct(
        F.struct("kind", "platform").alias("source"), F.col("conv_id").alias("conversation_id"), "turn_id", span.alias("span"), captured_at.alias("captured_at"),
        F.struct("method", "agent").alias("extracted_by"),
    )
    names = "type content confidence strength status language filename uri title".split()
    kept = placed.select("doc_id", "i", record(ITEM, id=F.col("item_id"), provenance=provenance, created_at=created_at, **{n: F.col(n) for n in names}).alias("record"), more("items"))
    gone = merged.groupBy("doc_id", F.col("canonical_id").alias("item_id")).agg(
        F.array_sort(F.collect_list(F.struct("extractor", "type", "content", "confidence"))).alias("merged_from")
    )
    cited = items.drop("evidence").join(_evidence(items, turns, X.u16_offset), ["doc_id", "item_id"], "left").join(gone, ["doc_id", "item_id"], "left")
    notes = cited.select("doc_id", "item_id", record(
        NOTE, origin=F.col("origin"), assertion=F.col("assertion"), evidence=F.transform("evidence", _wire), extractors=F.col("extractors"), merged_from=F.col("merged_from")
    ).alias("record"), more("annotations"))
    order = F.pmod(F.xxhash64("type", "from", "to"), F.lit((1 << 62) - 1))  # relations have no order of their own
    edges = relations.select("doc_id", order.alias("r"), record(RELATION, **{n: F.col(n) for n in ("type", "from", "to", "source")}).alias("record"), more("relations"))
    return Archive(docs, convs, said, kept, notes, edges)


def to_tables(a: Archive) -> dict[str, DataFrame]:
    """turns, items (with origin, assertion, evidence, extractors, merged_from) and relations of an archive; `open` stays beside them."""
    conv = a.conversations.select("doc_id", "ci", F.col("record.id").alias("conv_id"))
    turns = a.turns.join(conv, ["doc_id", "ci"]).select(
        "doc_id", "conv_id", F.col("ci").alias("conv_pos"), F.col("record.index").alias("idx"), F.col("record.id").alias("turn_id"), "record.role", "record.content", "open"
    )
    p = F.col("record.provenance")
    flat = a.items.select(
        "doc_id", "i", F.col("record.id").alias("item_id"), *[f"record.{n}" for n in "type content confidence strength status language filename uri title".split()],
        p["conversation_id"].alias("conv_id"), p["turn_id"].alias("turn_id"), p["span"]["start"].alias("start"), p["span"]["end"].alias("end"),
        p["extracted_by"]["method"].alias("method"), p["extracted_by"]["agent"].alias("agent"), "open",
    )
    notes = a.annotations.select("doc_id", "item_id", *[f"record.{n}" for n in ("origin", "assertion", "extractors", "merged_from")], F.transform(
        "record.evidence", lambda e: F.struct(e["turn_id"].alias("turn_id"), e["span"]["start"].alias("start"), e["span"]["end"].alias("end"))
    ).alias("evidence"))
    cited = notes.drop("evidence").join(_evidence(notes, turns, X.code_point_offset), ["doc_id", "item_id"], "left")
    items = _converted(flat, turns, X.code_point_offset).join(cited, ["doc_id", "item_id"], "left")
    relations = a.relations.select("doc_id", *[f"record.{n}" for n in ("type", "from", "to", "source")])
    return {"turns": turns, "items": items, "relations": relations}
