"""Text building blocks as column expressions (no Python at run time).

Offsets are code points inside the engine; `u16_length` and `u16_offset`
convert to UTF-16 units where a document leaves it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space set of the transcript format, wider than Java's \s.
WS_CHARS = (
    r"\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"
SEP = "␟"

_WORD = "[A-Za-z0-9_]"


def ascii_words(pattern: str) -> str:
    r"""Replace ``\<`` and ``\>`` by ASCII word boundaries: Java's ``\b`` is Unicode-aware."""
    return pattern.replace(r"\<", f"(?<!{_WORD})").replace(r"\>", f"(?!{_WORD})")


def re2_words(pattern: str) -> str:
    r"""The same pattern for RE2 engines, whose ``\b`` is ASCII."""
    return pattern.replace(r"\<", r"\b").replace(r"\>", r"\b")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}*\\n{WS}*", " "))


def u16_length(c: Column) -> Column:
    """Length in UTF-16 units; plain `length` when there is nothing outside ASCII."""
    units = F.shiftright(F.octet_length(F.encode(c, "UTF-16BE")), 1)
    return F.when(F.length(c) == F.octet_length(c), F.length(c)).otherwise(units)


def u16_offset(content: Column, n: Column) -> Column:
    """UTF-16 offset of code point offset `n` in `content`."""
    return u16_length(F.left(content, n))


def code_point_offset(content: Column, n: Column) -> Column:
    """Code point offset of UTF-16 offset `n` in `content`: a unit is put behind each character that takes two."""
    units = F.regexp_replace(F.translate(content, "\uffff", "\ufffe"), r"([\x{10000}-\x{10FFFF}])", "$1\uffff")
    wide = F.length(F.replace(F.left(units, n), F.lit("\uffff"), F.lit("")))
    return F.when(F.length(content) == F.octet_length(content), n).otherwise(wide)


def dedupe_form(c: Column) -> Column:
    """Key under which two statements count as the same one."""
    lowered = F.regexp_replace(F.lower(c), "’", "'")
    return strip(F.regexp_replace(collapse(lowered), r"[.!?;:,]+$", ""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Content-derived id. `concat_ws` skips nulls, so every part is coalesced."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix + "_"), F.left(F.md5(F.concat_ws(SEP, *texts)), F.lit(16)))


def id_number(c: Column) -> Column:
    """60 bits of a text's hash as a number. Sums of it identify a set of ids
    whatever the order, so no group has to be collected to name it."""
    return F.conv(F.left(F.md5(c), F.lit(15)), 16, 10).cast("decimal(20,0)")


def strict_json(c: Column) -> Column:
    """The text as VARIANT, null unless it is exactly one JSON value. The parser stops at the end of
    a value and would accept trailing text, which inside brackets is an error."""
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / F.lit(4)).cast("bigint")


def clean_text(c: Column) -> Column:
    out = F.regexp_replace(c, " ", " ")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


# Characters folded when a quote is looked up.
FOLD_FROM = "‘’‚‛“”„‟–—− "
FOLD_TO = "''''\"\"\"\"--- "
_QUOTE_MARKS = "\"'“”‘’«»"


def clean_quote(c: Column) -> Column:
    """Without the quotation marks and ellipses a model wraps around a quote."""
    out = F.regexp_replace(strip(c), f"^[{_QUOTE_MARKS}]+|[{_QUOTE_MARKS}]+$", "")
    out = F.regexp_replace(out, f"^(?:\\.\\.\\.|…){WS}*|{WS}*(?:\\.\\.\\.|…)$", "")
    return strip(out)


def fold(c: Column) -> Column:
    return strip(collapse(F.lower(F.translate(c, FOLD_FROM, FOLD_TO))))


def fold_regex(c: Column) -> Column:
    """A pattern for the folded quote in original text, so that its match gives original offsets."""
    escaped = F.regexp_replace(fold(c), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    out = F.regexp_replace(escaped, "'", "['‘’‚‛]")
    out = F.regexp_replace(out, '"', '["“”„‟]')
    out = F.regexp_replace(out, "-", "[-–—−]")
    return F.concat(F.lit("(?iu)"), F.regexp_replace(out, " ", f"[{WS_CHARS}]+".replace("\\", "\\\\")))


def locate_quote(content: Column, quote: Column) -> Column:
    """struct(start, end) of a quote in `content`, or null. Exact first, then folded.

    The folded form is searched only when the exact one is missing and the
    folded content does hold it, so the per-row pattern is compiled rarely.
    """
    q = clean_quote(quote)
    exact = F.position(q, content)
    folded = F.regexp_substr(content, fold_regex(q))
    start = F.when(exact > 0, exact).otherwise(F.position(folded, content))
    size = F.when(exact > 0, F.length(q)).otherwise(F.length(folded))
    hit = F.when(exact > 0, F.lit(True)).otherwise(
        (F.length(fold(q)) >= 2) & F.contains(fold(content), fold(q)) & folded.isNotNull()
    )
    return F.when(
        (F.length(q) >= 2) & hit,
        F.struct((start - 1).cast("int").alias("start"), (start - 1 + size).cast("int").alias("end")),
    )


def fence(code: Column, language: Column) -> Column:
    """Markdown fence longer than any run of back-ticks inside."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`+)"), F.lit(1)), F.length)
    longest = F.greatest(F.lit(2), F.coalesce(F.array_max(runs), F.lit(0)))
    ticks = F.repeat(F.lit("`"), longest + 1)
    shown = F.when(language == "text", F.lit("")).otherwise(language)
    return F.concat(ticks, shown, F.lit("\n"), code, F.lit("\n"), ticks)


# Tiles: a text is cut once, at marks put around or behind the matches of a pattern, so that
# the pieces joined are the text and every offset is a sum of lengths. U+FFFF marks the cuts;
# where a text holds it (or U+FFFE), both are spelled with U+FFFE and a digit while it is cut.
MARK, ESCAPE = "\uffff", "\ufffe"
BLOCK = 256  # elements summed in one fold; folds copy what they have gathered


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _escape(c: Column) -> Column:
    spelled = F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(MARK), F.lit(ESCAPE + "1"))
    return F.when(F.contains(c, F.lit(MARK)) | F.contains(c, F.lit(ESCAPE)), spelled).otherwise(c)


def _unescape(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))
    return F.when(F.contains(c, F.lit(ESCAPE)), plain).otherwise(c)


def _split(marked: Column) -> Column:
    return F.transform(F.split(marked, MARK), _unescape)


def running_sums(sizes: Column) -> Column:
    """The sum of the elements before each one: array<int>, in time proportional to the array.

    Blocks of `BLOCK` elements are summed on their own and moved by the sums of the blocks before.
    """
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum"))

    def add(acc, n):
        return F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + n).cast("int").alias("sum"))

    def moved(blocks):
        firsts = F.aggregate(blocks, zero, lambda acc, b: add(acc, b["sum"]), lambda acc: acc["out"])
        return let(firsts, lambda s: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["out"], lambda x: x + F.get(s, i)))))

    def summed(n):
        last = F.floor((F.size(n) - 1) / F.lit(BLOCK)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(n, i * BLOCK + 1, F.lit(BLOCK)), zero, add))
        return F.when(F.size(n) <= BLOCK, F.aggregate(n, zero, add, lambda acc: acc["out"])).otherwise(let(blocks, moved))

    return let(sizes, summed)


def _placed(pieces: Column) -> Column:
    """array<struct<text, start>> of pieces that tile a text."""

    def place(p):
        return F.zip_with(p, running_sums(F.transform(p, F.length)), lambda t, at: F.struct(t.alias("text"), at.alias("start")))

    return let(pieces, place)


def tiles(text: Column, pattern: str) -> Column:
    """array<struct<text, start, hit>>: the matches of a pattern (never empty ones) and what lies between, in order."""
    marked = F.regexp_replace(_escape(text), pattern, f"{MARK}$0{MARK}")
    return F.transform(_placed(_split(marked)), lambda t, i: F.struct(t["text"], t["start"], (i % 2 == 1).alias("hit")))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<text, start, hit>> of the matches alone."""
    return F.filter(tiles(text, pattern), lambda t: t["hit"])


def cut_behind(text: Column, pattern: str) -> Column:
    """array<struct<text, start>>: the text cut behind every match of the first group of `pattern`."""
    return _placed(_split(F.regexp_replace(_escape(text), pattern, "$1" + MARK)))
