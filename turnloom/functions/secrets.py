"""Secret patterns and their scan as column expressions.

The list is this engine's own. Values are found natively; only redacted
previews leave a scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (type, confidence, pattern with the secret in group 1, minimum entropy in bits per character)
PATTERNS: tuple[tuple[str, str, str, float], ...] = (
    ("GitHub Token", "high", r"(?:^|[^A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{36,})", 0.0),
    ("OpenAI API Key", "high", r"(?:^|[^A-Za-z0-9_])(sk-(?:proj-)?[A-Za-z0-9_-]{20,})", 0.0),
    ("AWS Access Key", "high", r"(?:^|[^A-Za-z0-9_])(AKIA[0-9A-Z]{16})", 0.0),
    ("Google API Key", "high", r"(?:^|[^A-Za-z0-9_])(AIza[0-9A-Za-z_-]{35})", 0.0),
    ("Slack Token", "high", r"(?:^|[^A-Za-z0-9_])(xox[abprs]-[A-Za-z0-9-]{10,})", 0.0),
    ("Private Key", "high", r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)", 0.0),
    ("JWT", "medium", r"(?:^|[^A-Za-z0-9_])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 0.0),
    ("Generic Secret", "medium", r"(?i)(?:token|secret|password|passwd|api_?key)[\"']?[ \t]*[:=][ \t]*[\"']([^\"'\n \t]{12,})[\"']", 3.0),
)
# The same finding where the plain pattern would start again inside a run of token characters: one look
# ahead per run decides whether it is the first part of a token, so a text is read a fixed number of times.
_RUN = "[A-Za-z0-9_-]"
IN_ONE_PASS = {
    "JWT": rf"(?<!{_RUN})(?={_RUN}++\.eyJ{_RUN}{{10,}}+\.{_RUN}{{10}})(?:{_RUN}*?-)??(eyJ{_RUN}{{10,}}+\.eyJ{_RUN}{{10,}}+\.{_RUN}{{10,}}+)",
}
# Text every pattern needs; most rows stop here.
HINT = r"gh[pousr]_|sk-|AKIA|AIza|xox[abprs]-|PRIVATE KEY|eyJ|(?i:token|secret|passw|api_?key)"


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character."""
    size = F.length(value)

    def add(acc, c):
        p = (size - F.length(F.replace(value, c, F.lit("")))) / size
        return acc - p * F.log2(p)

    chars = F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))
    return F.aggregate(chars, F.lit(0.0), add)


def redact(value: Column) -> Column:
    """First characters only; short values show nothing."""
    return F.when(F.length(value) >= 8, F.concat(F.left(value, F.lit(4)), F.lit("…"))).otherwise(F.lit("…"))


def scan(text: Column) -> Column:
    """array<struct<type, confidence, preview, n>>: n counts the place of a finding of its type."""
    empty = F.array().cast("array<struct<type:string,confidence:string,preview:string,n:int>>")
    found = []
    for kind, confidence, pattern, floor in PATTERNS:
        values = _values(text, kind, pattern, floor)
        found.append(F.transform(values, _finding(kind, confidence)))
    return F.when(text.rlike(HINT), F.concat(*found)).otherwise(empty)


def _values(text: Column, kind: str, pattern: str, floor: float) -> Column:
    values = F.regexp_extract_all(text, F.lit(IN_ONE_PASS.get(kind, pattern)), F.lit(1))
    return F.filter(values, _above(floor)) if floor else values


def _above(floor: float):
    return lambda v: entropy(v) >= floor


def _finding(kind: str, confidence: str):
    return lambda v, i: F.struct(
        F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), redact(v).alias("preview"), i.alias("n")
    )


def redact_text(text: Column) -> Column:
    """The text with every secret replaced by a marker of its type."""
    out = text
    for kind, _, pattern, floor in PATTERNS:
        marker = f"[REDACTED:{kind}]"
        values = F.array_distinct(_values(text, kind, pattern, floor))
        out = F.aggregate(values, out, _replace_with(marker))
    return F.when(text.rlike(HINT), out).otherwise(text)


def _replace_with(marker: str):
    return lambda acc, v: F.replace(acc, v, F.lit(marker))
