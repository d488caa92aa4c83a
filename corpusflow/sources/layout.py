"""Books whose layout stays: the inventory of an EPUB's documents, their prose in place, and archives with that prose exchanged.

A block is a prose element without prose elements inside. Only the text of blocks is ever changed; every other byte of the archive that
is not an edited document stays as it is.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree as E

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.sources.files import read_epub

#: Elements that hold prose, that may stand inside a block of which the text is exchanged, and kinds of images.
PROSE = "p h1 h2 h3 h4 h5 h6 li blockquote dt dd figcaption td th pre".split()
INLINE = "em i strong b span".split()
IMAGES = ("image/jpeg", "image/png", "image/gif", "image/svg+xml")
SVG = "svg g path rect circle ellipse line polyline polygon defs title desc text tspan lineargradient radialgradient stop clippath use symbol".split()
XHTML = "http://www.w3.org/1999/xhtml"
_MARKS = re.compile(r"\*\*(?P<strong>(?:\\.|[^*\\])+)\*\*|\*(?P<em>(?:\\.|[^*\\])+)\*")
_ESCAPE = re.compile(r"\\([*`\[\]\\])")


class Unreadable(ValueError):
    """A document that cannot be kept as it is."""


def _name(node: E.Element) -> str:
    return node.tag.rsplit("}", 1)[-1].lower() if isinstance(node.tag, str) else ""


def _body(root: E.Element) -> E.Element:
    found = [n for n in root.iter() if _name(n) == "body"]
    if len(found) != 1:
        raise Unreadable("not exactly one body")
    return found[0]


def prose(body: E.Element) -> list[E.Element]:
    """The blocks of a body in order. Text that no block holds is an error, as it would be lost."""
    out: list[E.Element] = []

    def visit(node: E.Element) -> None:
        inner = any(_name(x) in PROSE for x in node.iter() if x is not node)
        if _name(node) in PROSE and not inner:
            if "".join(node.itertext()).strip():
                out.append(node)
            return
        loose = [node.text, *(x.tail for x in node)]
        if any((t or "").strip() for t in loose) and _name(node) not in ("script", "style"):
            raise Unreadable(f"text in <{_name(node)}> outside of blocks")
        for x in node:
            visit(x)

    visit(body)
    return out


def _contents(root: E.Element, place: str, documents: set[str]) -> list[tuple[str, str]] | None:
    """``(document, title)`` of a list of contents: a body whose text stands in links alone, all to documents of the book, besides headings;
    None for anything else."""
    body = _body(root)
    links = [n for n in body.iter() if _name(n) == "a" and n.get("href")]
    said = re.sub(r"\s+", "", "".join(t for n in body.iter() if _name(n) not in ("a",) and not re.fullmatch("h[1-6]|span", _name(n)) for t in (n.text or "",)))
    targets = [posixpath.normpath(posixpath.join(posixpath.dirname(place), unquote(urlsplit(n.get("href")).path))) for n in links]
    if len(links) < 2 or said or any(t not in documents for t in targets):
        return None
    return [(t, "".join(n.itertext()).strip()) for t, n in zip(targets, links)]


def safe_image_url(href: str) -> bool:
    """Whether an image may be referred to outside of the archive: http(s), with a host, without user or blanks."""
    u = urlsplit(href)
    return u.scheme in ("http", "https") and bool(u.hostname) and "." in u.hostname and not u.username and not re.search(r"[\s\"'<>\\]", href)


def static_svg(data: bytes) -> bool:
    """Whether an SVG only draws: known elements, no scripts or handlers, no references to anything outside of it."""
    try:
        root = E.fromstring(data)
    except E.ParseError:
        return False
    ok = lambda k, v: not k.lower().startswith("on") and (not k.lower().endswith("href") or v.startswith("#")) and "url(http" not in v.replace(" ", "").lower()
    return _name(root) == "svg" and all(_name(n) in SVG and all(ok(k.rsplit("}", 1)[-1], v) for k, v in n.attrib.items()) for n in root.iter())


def inventory(data: bytes) -> dict:
    """``status, reason, documents``: each document of the reading order with ``path, kind`` (text, artwork or contents), ``title, blocks,
    images`` and the digest of its bytes. Blocked where text would be lost, an image is not declared, or a file outside the order has text."""
    book = read_epub(data)
    if book["status"] != "ok":
        return {"status": "blocked", "reason": book["reason"], "documents": None}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names, order = z.namelist(), [d[2] for d in book["documents"]]
            roots = {p: E.fromstring(z.read(p)) for p in names if p.lower().endswith((".xhtml", ".html"))}
            listed = {p: c for p in roots if (c := _contents(roots[p], p, set(order))) is not None}
            titles = {p: t for c in listed.values() for p, t in c if t}
            out = []
            for p in order:
                if p in listed:
                    out.append((p, "contents", "Contents", [], [], hashlib.sha256(z.read(p)).hexdigest()))
                    continue
                body, images = _body(roots[p]), []
                for n in (n for n in body.iter() if _name(n) in ("img", "image")):
                    href = next((v for k, v in n.attrib.items() if k.rsplit("}", 1)[-1] in ("src", "href")), "")
                    inside = posixpath.normpath(posixpath.join(posixpath.dirname(p), unquote(href)))
                    if not safe_image_url(href) and (inside not in names or not z.getinfo(inside).file_size or inside.lower().endswith(".svg") and not static_svg(z.read(inside))):
                        raise Unreadable(f"{p}: image {href or 'without place'}")
                    images.append(href if safe_image_url(href) else inside)
                blocks = ["".join(n.itertext()).strip() for n in prose(body)]
                if not blocks and not images:
                    raise Unreadable(f"{p}: neither text nor images")
                out.append((p, "text" if blocks else "artwork", titles.get(p) or posixpath.basename(p).rsplit(".", 1)[0], blocks, images, hashlib.sha256(z.read(p)).hexdigest()))
            for p in roots:
                if p not in order and p not in listed and "".join(_body(roots[p]).itertext()).strip() and not any(_name(n) == "nav" for n in roots[p].iter()):
                    raise Unreadable(f"{p}: text outside of the reading order")
            return {"status": "ok", "reason": None, "documents": out}
    except (Unreadable, E.ParseError, KeyError) as e:
        return {"status": "blocked", "reason": str(e), "documents": None}


def _write(node: E.Element, text: str) -> None:
    """A block's content from text with marks for emphasis."""
    for x in list(node):
        node.remove(x)
    node.text, last, at = "", None, 0

    def put(t: str) -> None:
        t = _ESCAPE.sub(r"\1", t)
        if last is None:
            node.text += t
        else:
            last.tail = (last.tail or "") + t

    for m in _MARKS.finditer(text):
        put(text[at : m.start()])
        last = E.SubElement(node, f"{{{XHTML}}}{m.lastgroup}")
        last.text, at = _ESCAPE.sub(r"\1", m[m.lastgroup]), m.end()
    put(text[at:])


def exchanged(data: bytes, texts: dict[str, Sequence[str]]) -> bytes:
    """The archive with the blocks of some documents exchanged, in their order; the same input gives the same bytes. ValueError where the
    numbers of blocks differ, or a changed block holds more than text and emphasis."""
    found = inventory(data)
    if found["status"] != "ok":
        raise ValueError(found["reason"])
    kinds = {p: kind for p, kind, *_ in found["documents"]}
    out = io.BytesIO()
    E.register_namespace("", XHTML)
    E.register_namespace("epub", "http://www.idpf.org/2007/ops")
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as w:
        for name in ["mimetype", *(n for n in z.namelist() if n != "mimetype")]:
            content = z.read(name)
            if name in texts:
                if kinds.get(name) != "text":
                    raise ValueError(f"{name} has no text")
                root = E.fromstring(content)
                blocks = prose(_body(root))
                if len(blocks) != len(texts[name]):
                    raise ValueError(f"{name} has {len(blocks)} blocks, not {len(texts[name])}")
                for node, text in zip(blocks, texts[name]):
                    if text != "".join(node.itertext()).strip():
                        if any(_name(x) not in INLINE for x in node.iter() if x is not node):
                            raise ValueError(f"{name}: a block with more than text")
                        _write(node, text)
                content = E.tostring(root, encoding="utf-8", xml_declaration=True)
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            w.writestr(info, content)
    return out.getvalue()


def _shape(data: bytes) -> list[tuple]:
    """Elements and attributes of a document outside of its blocks' content."""
    root, out = E.fromstring(data), []
    held = {id(x) for n in prose(_body(root)) for x in n.iter() if x is not n}
    for n in root.iter():
        if id(n) not in held:
            out.append((n.tag, tuple(sorted(n.attrib.items()))))
    return out


def layout_faults(before: bytes, after: bytes) -> list[str]:
    """What an archive with exchanged text has lost or changed besides: files, assets, documents without text, elements around blocks."""
    found = inventory(before)
    if found["status"] != "ok":
        return [found["reason"]]
    try:
        with zipfile.ZipFile(io.BytesIO(before)) as a, zipfile.ZipFile(io.BytesIO(after)) as b:
            names = ["mimetype", *(n for n in a.namelist() if n != "mimetype")]
            if b.namelist() != names:
                return ["files"]
            out = [] if b.infolist()[0].compress_type == zipfile.ZIP_STORED else ["mimetype"]
            text = {p for p, kind, *_ in found["documents"] if kind == "text"}
            out += [f"{n} changed" for n in names if n not in text and a.read(n) != b.read(n)]
            return out + [f"{n} lost its form" for n in sorted(text) if _shape(a.read(n)) != _shape(b.read(n))]
    except (zipfile.BadZipFile, E.ParseError, Unreadable, KeyError) as e:
        return [f"not readable: {e}"]


_DOCUMENT = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("title", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("images", T.ArrayType(T.StringType())), T.StructField("sha256", T.StringType())])
_INVENTORY = T.StructType([T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("documents", T.ArrayType(_DOCUMENT))])


@F.pandas_udf(_INVENTORY)
def inventoried(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([(None, None, None) if b is None else tuple(inventory(bytes(b)).values()) for b in s], columns=_INVENTORY.names)


def layout(books: DataFrame, key: str, content: str) -> DataFrame:
    """``key, status, reason, pos, path, kind, title, blocks, images, sha256``: the documents of every archive in reading order; a blocked
    archive is one row with the reason."""
    i = books.select(key, inventoried(content).alias("i"))
    return i.select(key, "i.status", "i.reason", F.posexplode_outer("i.documents").alias("pos", "d")).select(key, "status", "reason", "pos", "d.*")


_REBUILT = T.StructType([T.StructField("epub", T.BinaryType()), T.StructField("fault", T.StringType())])


@F.pandas_udf(_REBUILT)
def _rebuilt(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for books, lists in batches:
        rows = []
        for data, texts in zip(books, lists):
            try:
                new = exchanged(bytes(data), {t["path"]: list(t["blocks"]) for t in (texts if texts is not None else ())})
                rows.append((new, "; ".join(layout_faults(bytes(data), new)) or None))
            except ValueError as e:
                rows.append((None, str(e)))
        yield pd.DataFrame(rows, columns=_REBUILT.names)


def rebuild(books: DataFrame, texts: DataFrame, key: str, content: str) -> DataFrame:
    """``key, epub, fault``: every archive with the blocks that ``texts`` (``key, path, blocks``) gives for its documents, checked against
    what it was; without archive, and with the reason, where that cannot be. A book is one file, so its texts meet in one task."""
    listed = texts.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("path", "blocks")).alias("_texts"))
    both = books.where(F.col(content).isNotNull()).join(listed, F.col(key) == F.col("_k"), "left")
    return both.select(key, _rebuilt(content, "_texts").alias("r")).select(key, "r.epub", "r.fault")
