"""Books as files: finding, decoding and taking apart EPUB, HTML, Markdown and plain text."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusflow.functions.text import identity_form
from corpusflow.sources.markup import as_markdown, blocks_of, markdown_sections, text_sections

#: Formats by suffix: fixed values.
SUFFIXES = {"epub": "epub", "html": "html", "htm": "html", "xhtml": "xhtml", "txt": "txt", "md": "markdown", "markdown": "markdown"}
CHARSETS = ("utf-8-sig", "utf-16", "cp1251", "cp1252")


@F.pandas_udf(T.StringType())
def probed_format(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The format of a file by its suffix and its bytes: "epub" only where the bytes are an archive with a container; null for others."""
    for names, data in batches:
        out = []
        for name, b in zip(names, data):
            found = SUFFIXES.get((name or "").rsplit(".", 1)[-1].lower())
            if found == "epub":
                found = "epub" if b is not None and _has_container(bytes(b)) else None
            out.append(found)
        yield pd.Series(out, dtype=object)


def _has_container(data: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return "META-INF/container.xml" in z.namelist()
    except (zipfile.BadZipFile, OSError):
        return False


def format_of(path: Column) -> Column:
    """The format that a path's suffix names; null for any other."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    names = F.create_map(*[F.lit(x) for p in SUFFIXES.items() for x in p])
    return F.try_element_at(names, suffix)


def decode_bytes(data: bytes) -> str | None:
    for charset in CHARSETS:
        try:
            return data.decode(charset)
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(T.StringType())
def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of bytes in the first charset that fits; null where none does."""
    for s in batches:
        yield s.map(lambda b: None if b is None else decode_bytes(b))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, format, sha256, n_bytes, content`` of all files under a folder, in any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", format_of(F.col("path")).alias("format"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"), "content")


_DOC = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("idref", T.StringType()), T.StructField("path", T.StringType()), T.StructField("html", T.StringType())])
_EPUB = T.StructType([T.StructField(n, T.StringType()) for n in ("status", "reason", "title", "author", "language")] + [T.StructField("documents", T.ArrayType(_DOC))])


def read_epub(data: bytes) -> dict:
    """Metadata and reading order of an EPUB; blocked, with the reason, where any document of the order cannot be read."""
    out = {"status": "blocked", "reason": None, "title": None, "author": None, "language": None, "documents": None}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if len(set(names)) != len(names):
                return out | {"reason": "an entry occurs twice"}
            local = lambda node: node.tag.rsplit("}", 1)[-1]
            container = ElementTree.fromstring(z.read("META-INF/container.xml"))
            root = next(n.get("full-path") for n in container.iter() if local(n) == "rootfile")
            package = ElementTree.fromstring(z.read(root))
            for field, name in (("title", "title"), ("author", "creator"), ("language", "language")):
                out[field] = next((n.text.strip() for n in package.iter() if local(n) == name and n.text and n.text.strip()), None)
            listed = [n for n in package.iter() if local(n) == "item" and n.get("id") and n.get("href")]
            items = {n.get("id"): n for n in listed}
            if len(items) != len(listed):
                return out | {"reason": "two files are listed under one name"}
            documents = []
            for ref in (n.get("idref") for n in package.iter() if local(n) == "itemref"):
                if ref not in items:
                    return out | {"reason": f"the reading order names {ref}, which is not listed"}
                item = items[ref]
                if "nav" in (item.get("properties") or "").split():
                    continue
                if item.get("media-type") not in ("application/xhtml+xml", "text/html"):
                    return out | {"reason": f"{ref} is {item.get('media-type')}"}
                place = posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(item.get("href").split("#")[0])))
                if place not in names:
                    return out | {"reason": f"{place} is missing"}
                documents.append((len(documents), ref, place, decode_bytes(z.read(place))))
            return out | ({"status": "ok", "documents": documents} if documents else {"reason": "no document to read"})
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration) as e:
        return out | {"reason": f"not an EPUB: {type(e).__name__}"}


@F.pandas_udf(_EPUB)
def epub(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([read_epub(b) if b is not None else dict.fromkeys(_EPUB.names) for b in s], columns=_EPUB.names)


def _html_sections(blocks: Column, title: Column) -> Column:
    """Sections of blocks at the first of h1 and h2 that occurs twice."""
    n = lambda tag: F.size(F.filter(blocks, lambda b: b["tag"] == tag))
    level = F.when(n("h1") >= 2, "h1").when(n("h2") >= 2, "h2")
    starts = F.filter(F.sequence(F.lit(0), F.size(blocks) - 1), lambda i: F.get(blocks, i)["tag"] == level)
    first = F.get(F.filter(blocks, lambda b: b["tag"].rlike("^h[1-6]$")), F.lit(0))["text"]
    whole = F.array(F.struct(F.coalesce(first, title).alias("title"), as_markdown(blocks).alias("content")))
    bounds = F.concat(starts, F.array(F.size(blocks)))
    part = lambda a, b: as_markdown(F.slice(blocks, a + 1, b - a))
    front = F.when(F.get(starts, F.lit(0)) > 0, F.array(F.struct(title.alias("title"), part(F.lit(0), F.get(starts, F.lit(0))).alias("content")))).otherwise(F.slice(whole, 1, 0))
    rest = F.transform(F.sequence(F.lit(0), F.size(starts) - 1), lambda i: F.struct(F.get(blocks, F.get(starts, i))["text"].alias("title"), part(F.get(starts, i), F.get(bounds, i + 1)).alias("content")))
    return F.when(level.isNull(), whole).otherwise(F.concat(front, rest))


def extract_units(files: DataFrame) -> DataFrame:
    """``path, format, status, reason, number, title, content``: the units of every file, in order; a file that cannot be taken apart
    gives one row with the reason."""
    stem = strip_name(F.col("path"))
    books = files.where("format = 'epub'").select("path", "format", epub("content").alias("e"))
    documents = books.where("e.status = 'ok'").select("path", "format", F.explode("e.documents").alias("d")).select("path", "format", F.col("d.pos").alias("pos"), strip_name(F.col("d.path")).alias("name"), blocks_of(F.col("d.html"), True, F.col("d.path")).alias("b"))
    pages = files.where("format IN ('html', 'xhtml')").select("path", "format", F.lit(0).alias("pos"), stem.alias("name"), blocks_of(decoded("content"), False).alias("b"))
    marked = documents.unionByName(pages)
    read = marked.where("b.status = 'ok'").select("path", "format", "pos", F.posexplode(_html_sections(F.col("b.blocks"), F.col("name"))).alias("i", "s"))
    texts = files.where("format IN ('markdown', 'txt')").select("path", "format", decoded("content").alias("t"), stem.alias("name")).where("t IS NOT NULL")
    sections = F.when(F.col("format") == "markdown", markdown_sections(F.col("t"), F.col("name"))).otherwise(text_sections(F.col("t"), F.col("name")))
    plain = texts.select("path", "format", F.lit(0).alias("pos"), F.posexplode(sections).alias("i", "s"))
    # Units are numbered by their place: documents of a file, then sections of a document. A file is one task's work anyway.
    place = F.row_number().over(Window.partitionBy("path").orderBy("pos", "i"))
    units = read.unionByName(plain).select("path", "format", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"), place.alias("place"), F.col("s.title").alias("title"), F.col("s.content").alias("content"))
    nothing = [F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content")]
    failed = books.where("e.status <> 'ok'").select("path", "format", "e.status", "e.reason", *nothing)
    blocked = marked.where("b.status <> 'ok'").select("path", "format", "b.status", "b.reason", *nothing)
    unknown = files.where("format IS NULL").select("path", "format", F.lit("blocked").alias("status"), F.lit("unknown format").alias("reason"), *nothing)
    return units.unionByName(failed).unionByName(blocked).unionByName(unknown)


def spine(books: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, pos, name, n_blocks, n_filled, first_tag, has_image, sha256, n_chars``: the documents of each EPUB in reading order, with
    their blocks and the digest of their text in its form for comparison. Null block counts where a document cannot be taken apart."""
    e = books.select(F.col(path).alias("path"), epub(content).alias("e")).where("e.status = 'ok'").select("path", F.explode("e.documents").alias("d"))
    b = e.select("path", "d.pos", F.col("d.path").alias("name"), "d.html", blocks_of(F.col("d.html"), True, F.col("d.path")).alias("b"))
    text = identity_form(F.array_join(F.transform("b.blocks", lambda x: x["text"]), " "))
    own = b.withColumn("t", F.coalesce(text, identity_form(F.regexp_replace(F.regexp_replace("html", r"(?s)<head.*?</head>", ""), "<[^>]*>", " "))))
    return own.select("path", "pos", "name", F.size("b.blocks").alias("n_blocks"), F.size(F.filter("b.blocks", lambda x: ~x["tag"].isin("hr", "anchor"))).alias("n_filled"), F.get("b.blocks", F.lit(0))["tag"].alias("first_tag"), F.col("html").rlike(r"(?i)<img[\s/>]").alias("has_image"), F.sha2("t", 256).alias("sha256"), F.length("t").alias("n_chars"))


def fingerprints(documents: DataFrame, most: int = 300, least_first: int = 500) -> DataFrame:
    """``path, n_documents, digests, first``: the digests of a book's documents in order, null above ``most`` of them, and that of its first
    one where it has ``least_first`` characters."""
    one = documents.groupBy("path").agg(F.count("*").alias("n_documents"), F.min_by(F.when(F.col("n_chars") >= least_first, F.col("sha256")), "pos").alias("first"))
    few = one.where(F.col("n_documents") <= most).select("path")
    listed = documents.join(few, "path", "left_semi").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sha256"))), lambda x: x["sha256"]).alias("digests"))
    return one.join(listed, "path", "left").select("path", "n_documents", "digests", "first")


def strip_name(path: Column) -> Column:
    """A file's name without folder and suffix, hyphens and underscores as spaces."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", ""), "[-_]", " "))
    return F.when(name == "", "Book").otherwise(name)
