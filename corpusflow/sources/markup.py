"""Blocks, sections and protected spans of HTML, Markdown and plain text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import LINK, MARKER, strip

#: The elements that make blocks, that are passed over, that become Markdown marks, and that cannot be represented.
BLOCKS = "p div li dt dd blockquote pre".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
SKIPPED = "script style svg head".split()
MARKS = {"em": "*", "i": "*", "strong": "**", "b": "**", "code": "`"}
UNSUPPORTED = "img table figure figcaption aside sup sub math ruby audio video".split()
SCENE = "<!-- bt-scene-break -->"
_ID = r"[A-Za-z_][A-Za-z0-9_.:-]*"
_NAME = re.compile(_ID)
_EXTERNAL = re.compile(r"https?://[^\s/?#]+\S*", re.I)
_ESCAPED = str.maketrans({c: "\\" + c for c in "*`[]\\"})


class Blocked(ValueError):
    """A document whose structure would be lost."""


@dataclass
class _Node:
    """An element of the tree: text has no tag. Elements that mean nothing here are left out, their content is their parent's."""

    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)
    text: str = ""
    closed: bool = True


class _Tree(HTMLParser):
    """Reads a document into a tree of blocks, marks and text."""

    def __init__(self, skipped: set[str]):
        super().__init__(convert_charrefs=True)
        self.skipped, self.depth = skipped, 0
        self.known = {*BLOCKS, *HEADINGS, *MARKS, "a"}
        self.root = _Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in self.skipped:
            self.depth += 1
        elif not self.depth:
            node = _Node(tag, dict(attrs))
            if tag in self.known:
                node.closed = False
                self.open[-1].children.append(node)
                self.open.append(node)
            elif tag in ("br", "hr") or tag in UNSUPPORTED:
                self.open[-1].children.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in ("br", "hr"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.skipped:
            self.depth = max(0, self.depth - 1)
        elif not self.depth and tag in self.known:
            at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), None)
            if _is_mark(tag) and (at is None or any(_is_mark(n.tag) for n in self.open[at + 1 :])):
                raise Blocked(f"unbalanced <{tag}>")
            if at is not None:
                # Blocks may be left open, as HTML allows; marks may not.
                self.open[at].closed = True
                del self.open[at:]

    def handle_data(self, data):
        if not self.depth:
            self.open[-1].children.append(_Node("", text=data))


def _is_mark(tag: str) -> bool:
    return tag == "a" or tag in MARKS


def _tidy(raw: str) -> str:
    """Runs of blanks become one, lines without text vanish."""
    return "\n".join(re.sub(r"[ \t\r\f\v]+", " ", line) for line in raw.split("\n") if line.strip()).strip()


class _Walk:
    """Blocks in the order of the tree. Text belongs to the innermost block that is open; what follows a block inside another has none."""

    def __init__(self, document: str | None):
        self.document, self.blocks, self.wanted = document, [], set()
        self.run, self.owner = [], None

    def end_run(self) -> None:
        if text := _tidy("".join(self.run)):
            self.blocks.append((self.owner.tag if self.owner else "text", text))
        self.run, self.owner = [], None

    def visit(self, node: _Node, inside_mark: bool) -> None:
        for child in node.children:
            if not child.tag:
                self.run.append(child.text.translate(_ESCAPED))
            elif child.tag == "br":
                self.run.append("\n")
            elif child.tag in UNSUPPORTED:
                raise Blocked(f"element <{child.tag}> has no counterpart in text")
            elif _is_mark(child.tag):
                self.mark(child)
            elif inside_mark:
                raise Blocked("inline formatting is open at the end of a block")
            else:
                self.block(child)

    def mark(self, node: _Node) -> None:
        if not node.closed:
            raise Blocked("inline formatting is open at the end of a block")
        before, after = MARKS.get(node.tag, ""), MARKS.get(node.tag, "")
        if node.tag == "a" and (href := _target(node.attrs.get("href") or "", self.document)):
            before, after = "[", f"]({href})"
            if href.startswith("#"):
                self.wanted.add(href[1:])
        self.run.append(before)
        self.visit(node, True)
        self.run.append(after)

    def block(self, node: _Node) -> None:
        self.end_run()
        if node.tag == "hr":
            self.blocks.append(("hr", SCENE))
            return
        if _NAME.fullmatch(node.attrs.get("id") or ""):
            self.blocks.append(("anchor", node.attrs["id"]))
        self.owner = node
        self.visit(node, False)
        if self.owner is node and node.closed:
            self.end_run()


def html_blocks(html: str, skip_nav: bool = True, document: str | None = None) -> list[tuple[str, str]]:
    """Ordered (tag, text) blocks with inline marks; anchors stay where a link of the document leads to them."""
    tree = _Tree({*SKIPPED, *(["nav"] if skip_nav else [])})
    tree.feed(html)
    tree.close()
    walk = _Walk(document)
    walk.visit(tree.root, False)
    walk.end_run()
    return [(t, f"<!-- bt-anchor:{v} -->" if t == "anchor" else v) for t, v in walk.blocks if t != "anchor" or v in walk.wanted]


def _target(href: str, document: str | None) -> str:
    """An external address with its brackets escaped, or the place in the same document."""
    if not href or _EXTERNAL.fullmatch(href):
        return href.replace("(", "%28").replace(")", "%29")
    page, _, place = href.partition("#")
    own = (document or "").rsplit("/", 1)[-1]
    if not document or not _NAME.fullmatch(place) or page and (page != own or not page.endswith((".xhtml", ".html", ".htm"))):
        raise Blocked("a link leads neither out nor into the same document")
    return "#" + place


_BLOCK = T.StructType([T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])))])


def blocks_of(html: Column, skip_nav: bool = True, document: Column | None = None) -> Column:
    """``status`` (ok, empty or blocked), ``reason`` and ``blocks`` of an HTML document; null for null."""

    @F.pandas_udf(_BLOCK)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, names in batches:
            rows = []
            for t, n in zip(texts, names):
                try:
                    found = html_blocks(t, skip_nav, n) if t is not None else None
                    rows.append((None, None, None) if found is None else ("ok" if found else "empty", None, found))
                except Blocked as e:
                    rows.append(("blocked", str(e), None))
            yield pd.DataFrame(rows, columns=_BLOCK.names)

    return parse(html, document if document is not None else F.lit(None).cast("string"))


def as_markdown(blocks: Column) -> Column:
    """Blocks as Markdown: headings with their level, list items, and plain paragraphs."""
    line = lambda b: F.when(b["tag"].rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(b["tag"], 2, 1).cast("int")), F.lit(" "), b["text"])).when(b["tag"] == "li", F.concat(F.lit("- "), b["text"])).otherwise(b["text"])
    return F.concat(strip(F.array_join(F.transform(blocks, line), "\n\n")), F.lit("\n"))


def _cut_at(lines: Column, starts: Column, titles, title: Column) -> Column:
    """Sections of an array of lines that begin at ``starts``; what stands before the first is front matter."""
    n = F.size(lines)
    whole = F.array(F.struct(title.alias("title"), F.concat(strip(F.array_join(lines, "\n")), F.lit("\n")).alias("content")))
    bounds = F.concat(starts, F.array(n))
    text = lambda a, b: strip(F.array_join(F.slice(lines, a + 1, b - a), "\n"))
    front = text(F.lit(0), F.get(starts, F.lit(0)))
    parts = F.transform(F.sequence(F.lit(0), F.size(starts) - 1), lambda i: F.struct(titles(F.get(lines, F.get(starts, i))).alias("title"), F.concat(text(F.get(starts, i), F.get(bounds, i + 1)), F.lit("\n")).alias("content")))
    all_ = F.concat(F.array(F.struct(F.concat(title, F.lit(" — front matter")).alias("title"), F.concat(front, F.lit("\n")).alias("content"))), parts)
    return F.when(F.size(starts) < 2, whole).otherwise(F.filter(all_, lambda s: s["content"] != "\n"))


_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def markdown_sections(text: Column, title: Column) -> Column:
    """Sections at the first of the two top heading levels that occurs twice; the whole text where none does."""
    lines = F.split(text, _LINES)
    at = lambda level: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(rf"^#{{{level}}}\s+\S"))
    starts = F.when(F.size(at(1)) >= 2, at(1)).when(F.size(at(2)) >= 2, at(2)).otherwise(F.array().cast("array<int>"))
    return _cut_at(lines, starts, lambda x: strip(F.regexp_replace(x, r"^#{1,2}\s+", "")), title)


CHAPTER_LINE = r"(?iu)^\s*(?:chapter|глава|часть|part)\s+(?:\d+|[ivxlcdm]+)(?![\p{L}\p{N}_]).*$"


def text_sections(text: Column, title: Column) -> Column:
    """Sections at lines that name a chapter or part by number, where there are two or more."""
    lines = F.split(text, _LINES)
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(CHAPTER_LINE))
    return _cut_at(lines, starts, strip, title)


_PART = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "id", "value", "before", "after")]))
_PROTECTED = re.compile(f"(?P<link>{LINK})|(?P<epub_marker>{MARKER})")


def structure(text: str) -> list[tuple]:
    """Parts of a text in order: links and markers that must stay, white space, and the numbered spans between."""
    parts: list[tuple] = []
    n, at = 0, 0

    def span(raw: str) -> None:
        nonlocal n
        if not raw.strip():
            if raw:
                parts.append(("literal", None, raw, None, None))
            return
        n += 1
        core = raw.strip()
        lead = raw.index(core)
        parts.append(("text", f"s{n:05d}", core, raw[:lead], raw[lead + len(core) :]))

    for m in _PROTECTED.finditer(text):
        span(text[at : m.start()])
        parts.append((m.lastgroup if m["link"] is None else "link", None, m[0], None, None))
        at = m.end()
    span(text[at:])
    return parts


@F.pandas_udf(_PART)
def structure_parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``kind, id, value, before, after`` of every part; they concatenate to the text exactly."""
    for s in batches:
        yield pd.Series([None if t is None else structure(t) for t in s], dtype=object)


def rendered(parts: Column) -> Column:
    """The text that parts make up."""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.coalesce(p["before"], F.lit("")), p["value"], F.coalesce(p["after"], F.lit("")))), "")


def numbered_blocks(blocks: Column) -> Column:
    """Blocks joined to one text, each under a marker with its number."""
    return F.array_join(F.transform(blocks, lambda b, i: F.concat(F.format_string("<!-- bt-block:%06d -->\n", i + 1), b)), "\n\n")


def marked_blocks(text: Column) -> Column:
    """(id, text) of the blocks under markers; null where the numbers are not 1 to n in order."""
    ids = F.regexp_extract_all(text, F.lit(r"<!--\s*bt-block:(\d+)\s*-->"), F.lit(1))
    bodies = F.slice(F.split(text, r"<!--\s*bt-block:\d+\s*-->"), 2, 1_000_000_000)
    good = F.forall(F.transform(ids, lambda v, i: v.cast("int") == i + 1), lambda ok: ok)
    return F.when(good, F.zip_with(ids, bodies, lambda i, b: F.struct(i.alias("id"), strip(b).alias("text"))))
