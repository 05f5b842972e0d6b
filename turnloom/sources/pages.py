"""Web pages as Markdown, tables, code and turns.

HTML is the one input whose nesting the built-in functions cannot express, so a
small standard-library tree walk runs over Arrow batches. Everything after it
(exploding, de-duplication, extraction) is native again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.ordering import first_wins

# Elements without content, noise, and the Markdown around an element's content.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NOISE = frozenset("button svg script style noscript template head".split())
_NOISE_CLASS = re.compile("copy-button|action-bar|ds-icon-button|ds-atom-button", re.I)
_WRAP = {
    "strong": ("**", "**"), "b": ("**", "**"), "em": ("*", "*"), "i": ("*", "*"), "li": ("\n- ", ""),
    "h1": ("\n\n# ", "\n\n"), "h2": ("\n\n## ", "\n\n"), "h3": ("\n\n### ", "\n\n"), "blockquote": ("\n\n> ", "\n\n"),
    "p": ("", "\n"), "div": ("", "\n"), "section": ("", "\n"), "ul": ("", "\n"), "ol": ("", "\n"),
}


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator["_Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def within(self, tags: tuple[str, ...]) -> Iterator["_Node"]:
        """Nodes of the tags below this one, in order, without what lies in an inner table."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, _Node):
                if node.tag in tags:
                    yield node
                elif node.tag != "table":
                    stack.extend(reversed(node.children))

    def text(self, breaks: bool = False) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag == "br" and breaks:
                out.append("\n")
            else:
                stack.extend(reversed(node.children))
        return "".join(out)


class _Builder(HTMLParser):
    """A tree without the noise elements. Unclosed elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("root", {})
        self.stack, self.skip = [self.root], None

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        node = _Node(tag, values)
        noisy = (
            tag in _NOISE or values.get("role") == "button" or values.get("aria-hidden") == "true"
            or _NOISE_CLASS.search(values.get("class", ""))
        )
        if tag in ("p", "li", "tr", "td", "th") and self.stack[-1].tag == tag:
            self.handle_endtag(tag)
        if not noisy:
            self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _language(pre: _Node) -> str:
    code = next((n for n in pre.walk() if n.tag == "code"), None)
    for node in (code, pre):
        hit = re.search(r"\blanguage-([\w+#-]+)", node.attrs.get("class", "")) if node else None
        if hit:
            return hit.group(1)
    return (code.attrs.get("data-language", "") if code else "") or pre.attrs.get("data-language", "")


def _span(value: str, most: int) -> int:
    """A span attribute as a number; the HTML standard clamps it to `most`."""
    digits = re.match(r"\s*\d+", value)
    return min(max(1, int(digits.group())), most) if digits else 1


_BLOCKS = {"table", "tr", "td", "th", "p", "div", "li", "ul", "ol", "pre", "blockquote"}


def _cell_text(cell: _Node) -> str:
    """The text of a cell on one line; blocks inside are kept apart."""
    out: list[str] = []
    stack: list[object] = [cell]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag == "br":
            out.append(" ")
        else:
            apart = [" "] if node.tag in _BLOCKS else []
            stack.extend([*apart, *reversed(node.children), *apart])
    return re.sub(r"\s+", " ", "".join(out)).strip()


def _grid(table: _Node) -> list[list[str]]:
    """Cells of a table with row and column spans filled in; what hangs down is kept per column."""
    hanging: dict[int, tuple[int, str]] = {}  # column: rows left, value
    rows = []
    for tr in table.within(("tr",)):
        row: list[str] = []
        later: dict[int, tuple[int, str]] = {}

        def fill():
            while len(row) in hanging:
                left, value = hanging.pop(len(row))
                if left > 1:
                    later[len(row)] = left - 1, value
                row.append(value)

        for cell in tr.within(("td", "th")):
            fill()
            value = _cell_text(cell).replace("|", "\\|")
            wide, tall = (_span(cell.attrs.get(k, ""), most) for k, most in (("colspan", 1000), ("rowspan", 65534)))
            for _ in range(wide):
                hanging.pop(len(row), None)
                if tall > 1:
                    later[len(row)] = tall - 1, value
                row.append(value)
        fill()
        hanging = {**hanging, **later} if row else hanging
        if row:
            rows.append(row)
    width = max((len(r) for r in rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _table(table: _Node) -> str:
    rows = ["| " + " | ".join(r) + " |" for r in _grid(table)]
    return "\n".join(rows[:1] + ["|" + " --- |" * rows[0].count(" | ") + " --- |"] + rows[1:]) if rows else ""


def _markdown(node: _Node, in_pre: bool = False) -> str:
    """Markdown of a tree; an explicit stack, so nesting depth is not bounded by recursion."""
    out: list[str] = []
    stack: list[object] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if isinstance(n, tuple):
            out.append(n[0])
            continue
        classes = n.attrs.get("class", "").split()
        if "katex" in classes or "katex-display" in classes:
            tex = next((a.text().strip() for a in n.walk() if a.tag == "annotation"), n.text().strip())
            mark = "$$" if "katex-display" in classes else "$"
            out.append(f"{mark}{tex}{mark}" if tex else "")
        elif n.tag == "pre":
            code = next((c for c in n.walk() if c.tag == "code"), n).text(breaks=True)
            body = re.sub(r"\r\n?", "\n", code).rstrip("\n")
            out.append(f"\n\n```{_language(n)}\n{body}\n```\n\n")
        elif n.tag == "code":
            out.append(f"`{n.text()}`")
        elif n.tag == "table":
            out.append(f"\n\n{_table(n)}\n\n")
        elif n.tag == "img":
            src = n.attrs.get("src") or n.attrs.get("data-src", "")
            if src and not re.search("favicon|sprite", src, re.I):
                out.append(f"\n\n![{n.attrs.get('alt') or n.attrs.get('aria-label') or 'image'}]({src})\n\n")
        elif n.tag == "br":
            out.append("\n")
        elif n.tag == "hr":
            out.append("\n\n---\n\n")
        elif n.tag == "a":
            href, label = n.attrs.get("href", ""), n.text()
            out.append(f"[{label}]({href})" if href and not href.startswith("javascript:") else label)
        else:
            before, after = _WRAP.get(n.tag, ("", ""))
            out.append(before)
            stack.append((after,))
            stack.extend(reversed(n.children))
    text = re.sub(r"[ \t]+\n", "\n", "".join(out).replace(" ", " "))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# Attributes by which chat pages mark who speaks (role, attribute, how, value); "has" ignores case.
MARKERS = (
    ("user", "data-message-author-role", "is", "user"),
    ("user", "data-role", "is", "user"),
    ("user", "data-testid", "has", "user-message"),
    ("user", "class", "has", "user-message"),
    ("user", "class", "has", "user-bubble"),
    ("assistant", "data-message-author-role", "is", "assistant"),
    ("assistant", "data-role", "is", "model"),
    ("assistant", "data-role", "is", "assistant"),
    ("assistant", "data-testid", "has", "assistant"),
    ("assistant", "data-testid", "has", "model"),
    ("assistant", "class", "has", "assistant-message"),
    ("assistant", "class", "has", "model-response"),
    ("assistant", "class", "has", "bot-message"),
)


def _speaker(node: _Node) -> str | None:
    """Who speaks in an element by its own marks; the first mark counts."""
    for role, name, how, value in MARKERS:
        own = node.attrs.get(name, "")
        if own and (own == value if how == "is" else value in own.lower()):
            return role
    return None


def _spoken(root: _Node) -> list[dict[str, str]]:
    """The turns of a page in order: the innermost elements that are marked with a speaker, empty ones left out.

    One walk with an explicit stack; an element is innermost if none was found between its start and its end.
    """
    found: list[tuple[str, _Node] | None] = []
    stack: list[object] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):  # the end of a marked element that is at this place of the list
            place, role, element = node
            if len(found) == place + 1:
                found[place] = (role, element)
        elif isinstance(node, _Node):
            role = _speaker(node)
            if role:
                stack.append((len(found), role, node))
                found.append(None)
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))
    turns = [(role, _markdown(node)) for role, node in filter(None, found)]
    return [{"role": role, "content": content} for role, content in turns if content]


def _page(html: str) -> dict[str, object]:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    nodes = list(builder.root.walk())
    pres = [n for n in nodes if n.tag == "pre"]
    inside = {id(c) for p in pres for c in p.walk()}
    return {
        "markdown": _markdown(builder.root),
        "tables": [_table(n) for n in nodes if n.tag == "table"],
        "code": [{"language": _language(p), "code": p.text(breaks=True).rstrip("\n")} for p in pres],
        "inline": [t for n in nodes if n.tag == "code" and id(n) not in inside and len(t := n.text()) < 200],
        "links": [{"label": n.text(), "href": n.attrs.get("href", "")} for n in nodes if n.tag == "a"],
        "turns": _spoken(builder.root),
    }


PAGE_SCHEMA = (
    "page_id bigint, url string, title string, markdown string, tables array<string>,"
    " code array<struct<language:string,code:string>>, inline array<string>, links array<struct<label:string,href:string>>,"
    " turns array<struct<role:string,content:string>>"
)


def read_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> Markdown and structured parts, one row per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([_page(h) for h in batch["html"]], index=batch.index)
            yield pd.concat([batch[["page_id", "url", "title"]], rows], axis=1)[
                ["page_id", "url", "title", "markdown", "tables", "code", "inline", "links", "turns"]
            ]

    titled = pages.select("page_id", "url", "html", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))
    return titled.mapInPandas(run, PAGE_SCHEMA)


def page_code(read: DataFrame) -> DataFrame:
    """Code blocks of the pages, the same block of a page once (first 200 characters decide)."""
    rows = read.select("page_id", F.posexplode("code").alias("pos", "c")).select("page_id", "pos", "c.*")
    keyed = rows.withColumn("__key", F.left("code", F.lit(200)))
    return first_wins(keyed, ["page_id", "__key"], ["pos"]).drop("__key")


def page_tables(read: DataFrame) -> DataFrame:
    return read.select("page_id", F.posexplode("tables").alias("pos", "table"))


def page_turns(read: DataFrame) -> DataFrame:
    """Pages as conversations, ready for the extractors: a turn per marked speaker; a page without any is one assistant turn."""
    conv = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    whole = F.array(F.struct(F.lit("assistant").alias("role"), F.col("markdown").alias("content")))
    said = F.when(F.size("turns") > 0, F.col("turns")).otherwise(whole)
    return read.select("page_id", conv.alias("conv_id"), F.posexplode(said).alias("idx", "t")).select(
        F.col("conv_id").alias("doc_id"), "conv_id", F.col("page_id").alias("conv_pos"), "idx",
        F.concat("conv_id", F.lit("_t"), F.col("idx").cast("string")).alias("turn_id"), "t.role", "t.content",
    )
