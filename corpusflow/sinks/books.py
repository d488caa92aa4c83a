"""Books written out: Markdown in order, EPUB archives, sealed tables."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.sources.files import read_epub


def write_units(units: DataFrame, path: str, book: str = "book_slug") -> None:
    """Units as Parquet, a folder for each book."""
    units.write.mode("overwrite").partitionBy(book).parquet(path)


def write_markdown(units: DataFrame, path: str, book: str, number: str, content: str) -> None:
    """The units of each book as text files that, read in the order of their names, are the book.

    Ranges of (book, number) are sorted by as many tasks as the data need, so no book has to fit one of them.
    """
    laid = units.where(F.col(content).isNotNull()).repartitionByRange(F.col(book), F.col(number)).sortWithinPartitions(book, number)
    laid.select(book, F.concat(F.regexp_replace(content, r"\s+$", ""), F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy(book).text(path)


_INLINE = (
    (re.compile(r"(?<!\\)`([^`]+)`"), r"<code>\1</code>"),
    (re.compile(r"(?<!\\)\*\*(.+?)(?<!\\)\*\*", re.S), r"<strong>\1</strong>"),
    (re.compile(r"(?<!\\)\*(.+?)(?<!\\)\*", re.S), r"<em>\1</em>"),
    (re.compile(r"(?<!\\)\[([^\]\n]*)\]\(((?:https?://|#)[^)\s]+)\)"), r'<a href="\2">\1</a>'),
)


def inline_xhtml(text: str) -> str:
    out = html.escape(text, quote=False)
    for pattern, by in _INLINE:
        out = pattern.sub(by, out)
    return re.sub(r"\\([*`\[\]\\])", r"\1", out)


#: What a line of Markdown begins or is, in the order in which it is asked.
_LINES = (
    ("fence", re.compile(r"\s*```")),
    ("blank", re.compile(r"\s*$")),
    ("rule", re.compile(r"\s*(?:\* ?\* ?\*|- ?- ?-|_{3,}|<!-- bt-scene-break -->)\s*$")),
    ("anchor", re.compile(r"\s*<!-- bt-anchor:([A-Za-z_][A-Za-z0-9_.:-]*) -->\s*$")),
    ("marker", re.compile(r"\s*<!--\s*bt-(?:anchor|block|inline|media):[^>]*-->\s*$")),
    ("heading", re.compile(r"(#{1,6})\s+(.*\S)\s*$")),
    ("ul", re.compile(r"[-*] (.*)$")),
    ("ol", re.compile(r"\d{1,9}[.)] (.*)$")),
    ("p", re.compile(r"(.*)$")),
)
_ANY_LINK = re.compile(r"(?<!\\)(?<!!)\[[^\]\n]*\]\(([^)\s]*)[^)]*\)")


def _blocks(markdown: str) -> Iterator[tuple[str, list[re.Match]]]:
    """Runs of lines of one kind: a heading or rule is a run of its own, a paragraph goes on until anything else begins."""
    kind, run, fenced = "", [], False
    for line in markdown.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        now, m = next((k, m) for k, p in _LINES if (m := p.match(line)))
        if fenced:
            fenced = now != "fence"
            if fenced:
                run.append(re.match(r"(.*)", line))
                continue
            yield "code", run
            kind, run = "", []
            continue
        if now != kind or now in ("heading", "rule", "anchor", "marker"):
            if run:
                yield kind, run
            kind, run = now, []
        if now == "fence":
            fenced, run = True, []
        elif now != "blank":
            run.append(m)
    if fenced:
        yield "open_code", run
    elif run:
        yield kind, run


def markdown_xhtml(title: str, markdown: str, language: str = "en", strict: bool = False) -> str:
    """Headings, paragraphs, lists, fenced code, anchors, scene breaks and inline marks as an XHTML document.

    ``strict`` refuses (ValueError) what would be lost or lead nowhere: a fence that is not closed, a link that is neither http(s) nor in
    the document, and a place that is not there or is there twice.
    """
    body = []
    for kind, run in _blocks(markdown):
        if kind == "rule":
            body.append("<hr/>")
        elif kind == "anchor":
            body.append(f'<span id="{run[0][1]}"></span>')
        elif kind == "heading":
            body.append(f"<h{len(run[0][1])}>{inline_xhtml(run[0][2].strip())}</h{len(run[0][1])}>")
        elif kind in ("ul", "ol"):
            body.append(f"<{kind}>" + "".join(f"<li>{inline_xhtml(m[1].strip())}</li>" for m in run) + f"</{kind}>")
        elif kind in ("code", "open_code"):
            if strict and kind == "open_code":
                raise ValueError("a fence is not closed")
            body.append("<pre><code>" + html.escape("\n".join(m[1] for m in run)) + "</code></pre>")
        elif kind == "p":
            body.append("<p>" + inline_xhtml("\n".join(m[1] for m in run)).replace("\n", "<br/>") + "</p>")
    if strict:
        places = re.findall(r'<span id="([^"]*)"></span>', "".join(body))
        for target in _ANY_LINK.findall(markdown):
            if target.startswith("#"):
                if places.count(target[1:]) != 1:
                    raise ValueError(f"{target} is not one place of the document")
            elif not re.match(r"https?://[^\s/?#]", target):
                raise ValueError(f"{target} leads nowhere")
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{html.escape(language)}"><head><title>{html.escape(title)}</title></head><body>{"".join(body)}</body></html>'


_RENDERED = T.StructType([T.StructField(n, T.StringType()) for n in ("status", "reason", "xhtml")])


@F.pandas_udf(_RENDERED)
def rendered_xhtml(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """``status`` (ok or blocked), ``reason`` and ``xhtml`` of a title and its Markdown, strictly; null for null."""
    for titles, texts in batches:
        rows = []
        for title, text in zip(titles, texts):
            try:
                rows.append((None, None, None) if text is None else ("ok", None, markdown_xhtml(title or "", text, strict=True)))
            except ValueError as e:
                rows.append(("blocked", str(e), None))
        yield pd.DataFrame(rows, columns=_RENDERED.names)


def epub_bytes(identifier: str, title: str, language: str, units: list[tuple[str, str]]) -> bytes:
    """An EPUB of (title, Markdown) units; the same units always give the same bytes."""
    out = io.BytesIO()
    esc = html.escape
    names = [f"unit-{i + 1:06d}" for i in range(len(units))]
    manifest = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
    nav = "".join(f'<li><a href="{n}.xhtml">{esc(t or n)}</a></li>' for n, (t, _) in zip(names, units))
    files = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "OEBPS/package.opf": f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{esc(identifier)}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:language>{esc(language)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{manifest}</manifest><spine>{"".join(f"<itemref idref={chr(34)}{n}{chr(34)}/>" for n in names)}</spine></package>',
        "OEBPS/nav.xhtml": f'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{esc(title)}</title></head><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>',
    } | {f"OEBPS/{n}.xhtml": markdown_xhtml(t or n, text or "", language) for n, (t, text) in zip(names, units)}
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, text.encode())
    return out.getvalue()


_EPUB = T.StructType([T.StructField("book", T.StringType()), T.StructField("n_units", T.IntegerType()), T.StructField("epub", T.BinaryType())])


def epubs(units: DataFrame, book: str, number: str, title: str, content: str, language: str = "en", largest: int = 100_000_000) -> DataFrame:
    """``book, n_units, epub``: one archive for each book. A book is one file, so it is made by one task; one of more than ``largest``
    characters is refused before any is made."""
    sizes = units.groupBy(book).agg(F.sum(F.length(content)).alias("n")).where(F.col("n") > largest)
    if (big := sizes.first()) is not None:
        raise ValueError(f"{big[0]} is larger than one archive may be")
    rows = units.select(F.col(book).cast("string").alias("book"), F.col(number).alias("n"), F.col(title).alias("t"), F.col(content).alias("c"))

    def make(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("n")
        return pd.DataFrame([(key[0], len(f), epub_bytes(str(key[0]), str(key[0]), language, list(zip(f["t"], f["c"]))))], columns=_EPUB.names)

    return rows.groupBy("book").applyInPandas(make, _EPUB)


def archive_faults(data: bytes, expected: int) -> list[str]:
    """What is wrong with an archive that ``epub_bytes`` could have made; nothing if it is whole."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError):
        return ["no archive"]
    with z:
        out, infos = [], z.infolist()
        names = [x.filename for x in infos]
        if not names or names[0] != "mimetype" or infos[0].compress_type != zipfile.ZIP_STORED or z.read("mimetype") != b"application/epub+zip":
            out.append("mimetype")
        if len(set(names)) != len(names):
            out.append("repeated entry")
        found = read_epub(data)
        if found["status"] != "ok":
            return [*out, found["reason"]]
        if not found["title"] or not found["language"]:
            out.append("title or language")
        if len(found["documents"]) != expected:
            out.append(f"{len(found['documents'])} units instead of {expected}")
        for _, name, _, text in found["documents"]:
            if not "".join(_parsed(text, f"{name} is no XHTML", out)).strip():
                out.append(f"{name} is empty")
        contents = next((n for n in names if n.endswith("nav.xhtml")), None)
        if contents is None:
            return [*out, "no contents"]
        links = re.findall(r'<li><a href="([^"]+)">', z.read(contents).decode("utf-8", "replace"))
        if links != [place.rsplit("/", 1)[-1] for _, _, place, _ in found["documents"]]:
            out.append("contents")
        return out


def _parsed(text: str | None, fault: str, out: list[str]) -> list[str]:
    try:
        body = next(n for n in ElementTree.fromstring((text or "").encode()).iter() if n.tag.endswith("body"))
        return list(body.itertext())
    except (ElementTree.ParseError, StopIteration):
        out.append(fault)
        return ["-"]


def check_epubs(archives: DataFrame) -> DataFrame:
    """``book, n_units, n_read, faults``: archives read again, with the documents found in them and what is wrong."""

    @F.pandas_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("faults", T.ArrayType(T.StringType()))]))
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, counts in batches:
            yield pd.DataFrame([(len(read_epub(bytes(b))["documents"] or []), archive_faults(bytes(b), int(n))) for b, n in zip(data, counts)], columns=["n", "faults"])

    seen = archives.select("book", "n_units", check("epub", "n_units").alias("c"))
    return seen.select("book", "n_units", F.col("c.n").alias("n_read"), F.col("c.faults").alias("faults"))
