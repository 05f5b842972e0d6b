"""Formulas, file types, sizes, asset keys and text templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions import text as X

# File extension -> media type.
MIME = {
    "csv": "text/csv", "json": "application/json", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "txt": "text/plain",
    "md": "text/markdown", "html": "text/html", "xml": "text/xml", "zip": "application/zip", "py": "text/x-python",
    "ts": "text/typescript", "tsx": "text/typescript", "js": "text/javascript", "jsx": "text/javascript", "rs": "text/x-rust",
    "go": "text/x-go", "java": "text/x-java", "yaml": "text/yaml", "yml": "text/yaml", "toml": "text/toml", "sql": "text/x-sql",
}
# Code language -> file extension.
EXTENSIONS = {
    "python": "py", "javascript": "js", "typescript": "ts", "tsx": "tsx", "jsx": "jsx", "rust": "rs", "go": "go",
    "java": "java", "cpp": "cpp", "c++": "cpp", "c": "c", "ruby": "rb", "php": "php", "swift": "swift", "kotlin": "kt",
    "sql": "sql", "bash": "sh", "sh": "sh", "zsh": "sh", "powershell": "ps1", "yaml": "yaml", "json": "json", "html": "html",
    "css": "css", "scss": "scss", "markdown": "md", "dockerfile": "Dockerfile", "makefile": "Makefile", "text": "txt",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def mime_type(filename: Column) -> Column:
    return _lookup(MIME, F.lower(F.element_at(F.split(filename, r"\."), -1)))


def language_extension(language: Column) -> Column:
    return F.coalesce(_lookup(EXTENSIONS, F.lower(language)), F.lit("txt"))


def parse_size(text: Column) -> Column:
    """`2.3 MB` -> bytes (1 KB = 1024), null when there is no size in the text."""
    pattern = r"(?i)([0-9.]+)\s*(B|KB|MB|GB)"
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, pattern, 2))
    factor = F.when(unit == "KB", F.lit(1024.0)).when(unit == "MB", F.lit(1048576.0)).when(unit == "GB", F.lit(1073741824.0)).otherwise(F.lit(1.0))
    return F.when(text.rlike(pattern), F.floor(number * factor + 0.5)).cast("bigint")


def latex(text: Column) -> Column:
    r"""array<struct<display, latex>>: `\[..\]`, `\(..\)` outside of those, `$$..$$`, `$\cmd..$`."""

    def blocks(source, pattern, display):
        return F.transform(
            F.regexp_extract_all(source, F.lit(pattern), F.lit(1)),
            lambda m: F.struct(F.lit(display).alias("display"), X.strip(m).alias("latex")),
        )

    display_re = r"(?s)\\\[(.*?)\\\]"
    outside = F.regexp_replace(text, display_re, " ")
    found = F.concat(
        blocks(text, display_re, True), blocks(outside, r"(?s)\\\((.*?)\\\)", False),
        blocks(text, r"(?s)\$\$(.*?)\$\$", True), blocks(text, r"\$(\\[a-zA-Z]+[^\n\r\x{2028}\x{2029}]*?)\$", False),
    )
    some = F.contains(text, F.lit("$")) | F.contains(text, F.lit("\\"))
    return F.when(some, found).otherwise(F.array().cast("array<struct<display:boolean,latex:string>>"))


def asset_key(data: Column) -> Column:
    """Key of an asset from its first and last 50 characters and its length."""
    return F.md5(F.concat(F.left(data, F.lit(50)), F.right(data, F.lit(50)), F.length(data).cast("string")))


_VARIABLE = r"\{\{(\w+)(?::\s*([^}]*?)\s*)?\}\}"


def template_variables(body: Column) -> Column:
    """Distinct variables in order of appearance: array<struct<name, default>>."""
    names = F.regexp_extract_all(body, F.lit(_VARIABLE), F.lit(1))
    defaults = F.regexp_extract_all(body, F.lit(_VARIABLE), F.lit(2))
    pairs = F.zip_with(names, defaults, lambda n, d: F.struct(n.alias("name"), F.nullif(d, F.lit("")).alias("default")))
    first = F.array_distinct(names)
    return F.transform(first, lambda n: F.get(F.filter(pairs, lambda p: p["name"] == n), F.lit(0)))


def render_template(body: Column, values: Column) -> Column:
    """`{{name: default}}` -> value of the map, else the default, else the bare name in braces.

    The body is cut at its variables, so a value that looks like a variable is not expanded again.
    """
    whole = F.regexp_extract_all(body, F.lit("(" + _VARIABLE + ")"), F.lit(1))
    names = F.regexp_extract_all(body, F.lit(_VARIABLE), F.lit(1))
    defaults = F.regexp_extract_all(body, F.lit(_VARIABLE), F.lit(2))
    has_default = F.transform(whole, lambda w: F.contains(w, F.lit(":")))
    gaps = F.split(body, r"\{\{\w+(?::\s*[^}]*?\s*)?\}\}")
    known = F.arrays_zip(names.alias("n"), defaults.alias("d"), has_default.alias("h"))
    filled = F.transform(
        known,
        lambda k: F.coalesce(
            F.try_element_at(values, k["n"]), F.when(k["h"], k["d"]), F.concat(F.lit("{{"), k["n"], F.lit("}}"))
        ),
    )
    joined = F.zip_with(gaps, filled, lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    return F.array_join(joined, "")
