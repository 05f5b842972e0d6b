"""Column names, enumerations and struct types shared by all operators.

Long tables, one row per turn / item / evidence / relation. Nothing nests a
whole document: a document may hold any share of the data.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the document format, in the format's own order.
ROLES = ("user", "assistant", "system", "tool")
ITEM_TYPES = ("fact", "decision", "constraint", "preference", "task", "question", "code_artifact", "reference")
SOURCE_KINDS = ("browser", "ide", "cli", "agent", "mobile", "api", "manual", "unknown")
METHODS = ("deterministic", "heuristic", "manual", "model", "migration")
ORIGINS = ("user", "assistant", "system", "tool", "unknown")
ASSERTIONS = ("explicit", "inferred", "suggested", "quoted", "unknown")
STRENGTHS = ("must", "must_not", "should", "should_not")
DECISION_STATUS = ("proposed", "accepted", "rejected", "superseded")
TASK_STATUS = ("open", "in_progress", "done", "cancelled")
QUESTION_STATUS = ("open", "answered")
RELATION_TYPES = ("supersedes", "conflicts_with", "same_evidence")
SECTION_ORDER = ("constraint", "decision", "preference", "fact", "task", "question", "code_artifact", "reference")
SECTION_LABELS = {
    "constraint": "Constraints",
    "decision": "Decisions",
    "preference": "Preferences",
    "fact": "Facts",
    "task": "Tasks",
    "question": "Questions",
    "code_artifact": "Code",
    "reference": "References",
}
FORMAT_VERSION = "0.1"

RULE_AGENT = "turnloom.statements@1"
CODE_AGENT = "turnloom.code-blocks@1"
LINK_AGENT = "turnloom.references@1"
MODEL_AGENT = "turnloom.semantic@1"
RECONCILE_AGENT = "turnloom.reconcile@1"

DRAFT = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("strength", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("method", T.StringType()),
        T.StructField("agent", T.StringType()),
    ]
)

ATTACHMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "type", "name", "mimeType", "dataUrl")]
)
CODE_BLOCK = T.StructType([T.StructField("language", T.StringType()), T.StructField("code", T.StringType())])
RECORD_V0 = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("capturedAt", T.StringType()),
        T.StructField(
            "messages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("role", T.StringType()),
                        T.StructField("content", T.StringType()),
                        T.StructField("code", T.ArrayType(CODE_BLOCK)),
                        T.StructField("codeBlocks", T.ArrayType(CODE_BLOCK)),
                        T.StructField("attachments", T.ArrayType(ATTACHMENT)),
                    ]
                )
            ),
        ),
    ]
)

EVIDENCE_QUOTE = T.StructType([T.StructField("message", T.StringType()), T.StructField("quote", T.StringType())])
MODEL_ITEM = T.StructType(
    [
        T.StructField("ref", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("assertion", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("strength", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("evidence", T.ArrayType(EVIDENCE_QUOTE)),
    ]
)
MODEL_RELATION = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "from", "to")])
MODEL_OUTPUT = T.StructType(
    [
        T.StructField("items", T.ArrayType(MODEL_ITEM)),
        T.StructField("relations", T.ArrayType(MODEL_RELATION)),
    ]
)

GOLD = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("message", T.IntegerType()),
        T.StructField("match", T.ArrayType(T.StringType())),
        T.StructField("note", T.StringType()),
    ]
)
FORBIDDEN = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("match", T.ArrayType(T.StringType())),
        T.StructField("reason", T.StringType()),
    ]
)
EVAL_FIXTURE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("conversation", RECORD_V0),
        T.StructField("selection", T.ArrayType(T.IntegerType())),
        T.StructField("expected", T.ArrayType(GOLD)),
        T.StructField("forbidden", T.ArrayType(FORBIDDEN)),
    ]
)
