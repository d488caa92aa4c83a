"""Splitting oversized items at natural boundaries (problem 1).

An item is cut into atoms at every sentence, line and paragraph end; atoms still too long are cut at clauses, then at words, and
only then inside words. A heap holds the adjacent pairs: the weakest boundary is merged first, among equals the smallest pair, as
long as the pair fits the limit less the overlap. What stays apart are the pieces; each later piece also repeats the end of what
stands before it. Rows are handled one by one, so nothing is shuffled, and items within the limit never leave the JVM.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.names import free
from corpusflow.session import table

#: Strength of a boundary, from one inside a word to one before a heading or scene break.
FORCED, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH, SECTION = range(7)
_COARSE = regex.compile(
    r"(?P<section>(?:\r?\n[^\S\n]*){2,}(?=\#{1,6}\s|<!--|(?:\*[ ]?){3}|-{3,}))|(?P<para>(?:\r?\n[^\S\n]*){2,})|(?P<line>\r?\n)"
    r"|(?P<sent>(?:[.!?…]+[\p{Pf}\p{Pe}\"'”“»]*[^\S\n]+(?=[\p{Lu}\p{Lt}\p{Lo}\p{Nd}\p{Pi}\p{Ps}\p{Pd}\"'„«¿¡*_\[#])|[。！？][\p{Pf}\p{Pe}]*))"
)
_CLAUSE = regex.compile(r"[,;:—–)\]][^\S\n]+|[，；：、]")
_WORD = regex.compile(r"\s+")
_LEVEL = {"section": SECTION, "para": PARAGRAPH, "line": LINE, "sent": SENTENCE}


def _safe(text: str, at: int, low: int) -> int:
    """The last place at or before ``at``, and after ``low``, that is not inside a character made of several code points."""
    p = at
    while p > low and p < len(text) and (unicodedata.combining(text[p]) or text[p] in "‍︎️‌" or text[p - 1] == "‍" or text[p - 1 : p + 1] == "\r\n"):
        p -= 1
    return p if p > low else at


def _atoms(text: str, room: int) -> list[list[int]]:
    """Ends and strengths of atoms, each no longer than ``room``."""
    out: list[list[int]] = []
    start = 0
    for m in [*_COARSE.finditer(text), None]:
        end, level = (m.end(), _LEVEL[m.lastgroup]) if m else (len(text), SECTION)
        if end == start:
            continue
        if end - start > room:
            _finer(text, start, end, room, ((_CLAUSE, CLAUSE), (_WORD, WORD)), out)
            out[-1][1] = level
        else:
            out.append([end, level])
        start = end
    return out


def _finer(text: str, start: int, end: int, room: int, ways: tuple, out: list[list[int]]) -> None:
    if not ways:
        while end - start > room:
            start = _safe(text, start + room, start)
            out.append([start, FORCED])
        out.append([end, FORCED])
        return
    (pattern, level), *rest = ways
    marks = [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]
    for e in [*marks, end]:
        if e - start > room:
            _finer(text, start, e, room, tuple(rest), out)
            out[-1][1] = level
        else:
            out.append([e, level])
        start = e


def merge_atoms(ends: Sequence[int], strengths: Sequence[int], room: int) -> list[tuple[int, int]]:
    """Merge neighbours, weakest boundary first, while the two fit ``room``: the remaining ends with their strengths."""
    n = len(ends)
    size = [e - (ends[i - 1] if i else 0) for i, e in enumerate(ends)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    last = list(range(n))  # the atom whose end is the segment's end
    heap = [(strengths[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        s, both, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or size[i] + size[j] != both or both > room:
            continue
        alive[j], size[i], last[i], after[i] = False, both, last[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (strengths[last[i]], both + size[after[i]], i, after[i]))
        if before[i] >= 0:
            p = before[i]
            heapq.heappush(heap, (strengths[last[p]], size[p] + both, p, i))
    return [(ends[last[i]], strengths[last[i]]) for i in range(n) if alive[i]]


def cut(text: str, limit: int, overlap: int, at_word: bool = False) -> list[tuple[int, int, int, int]]:
    """``(start, core_start, end, strength of the boundary at its end)`` of each piece. The cores are the text, without holes.

    A later piece starts ``overlap`` characters before its core, or with the text where less stands before it. ``at_word`` lets it
    start at the first word of the overlap's first eighth instead, where there is one.
    """
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError(f"a limit of {limit} leaves no room for an overlap of {overlap}")
    if len(text) <= limit:
        return [(0, 0, len(text), SECTION)]
    room = limit - overlap
    atoms = _atoms(text, room)
    kept = merge_atoms([a[0] for a in atoms], [a[1] for a in atoms], room)
    pieces, core = [], 0
    for end, strength in kept:
        start = max(0, core - overlap)
        if at_word and start and (m := _WORD.search(text, start, start + overlap // 8)):
            start = m.end()
        pieces.append((start, core, end, strength))
        core = end
    return pieces


_SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "core_start", "end", "strength")]))


def _spans(at_word: bool):
    @F.pandas_udf(_SPAN)
    def spans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, limits, overlaps in batches:
            yield pd.Series([None if t is None else cut(t, int(n), int(o), at_word) for t, n, o in zip(texts, limits, overlaps)], dtype=object)

    return spans


def split_oversized(df: DataFrame, keys: Sequence[str], text: str | Column, limit: str | Column, overlap: str | Column, only_oversized: bool = False, at_word: bool = False) -> DataFrame:
    """Pieces of each row's text: ``keys, piece_no, n_pieces, piece_start, core_start, piece_end, boundary, piece``.

    ``piece`` is ``text[piece_start:piece_end]`` (code points, from 0) and never longer than ``limit``; from ``core_start`` on it is
    new, before that it repeats the end of its forerunners: exactly ``overlap`` characters, or all there are where less stands before
    the core. ``at_word`` makes the repeated part begin at a word where one begins in its first eighth. ``boundary`` is the strength of the cut at its end. The cores of an item concatenate to its text exactly.

    A text within the limit, an empty one, and one whose limit is null is one piece; a null text gives no row. Repeated rows come out
    repeatedly. Columns besides ``keys`` are dropped; where a key has the name of an output column, that gets an underscore.
    An overlap not below the limit is an error. ``only_oversized`` leaves out items within the limit.
    """
    text, limit, overlap = (F.col(c) if isinstance(c, str) else c for c in (text, limit, overlap))
    rows = df.select(F.struct(*keys).alias("k"), text.alias("t"), limit.cast("int").alias("n"), F.coalesce(overlap.cast("int"), F.lit(0)).alias("o")).where("t IS NOT NULL")
    big = F.coalesce(F.length("t") > F.col("n"), F.lit(False))
    rows = rows.where(big) if only_oversized else rows
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("core_start"), F.length("t").alias("end"), F.lit(SECTION).alias("strength")))
    spans = rows.withColumn("s", F.coalesce(_spans(at_word)(F.when(big, F.col("t")), F.col("n"), F.col("o")), whole))
    out = {name: free(name, keys) for name in ("piece_no", "n_pieces", "piece_start", "core_start", "piece_end", "boundary", "piece")}
    one = spans.select("k", "t", F.size("s").alias("c"), F.posexplode("s").alias("i", "p"))
    return one.select(
        *[F.col("k").getField(k).alias(k) for k in keys],
        F.col("i").alias(out["piece_no"]), F.col("c").alias(out["n_pieces"]), F.col("p.start").alias(out["piece_start"]), F.col("p.core_start").alias(out["core_start"]),
        F.col("p.end").alias(out["piece_end"]), F.col("p.strength").alias(out["boundary"]),
        F.substring("t", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias(out["piece"]),
    )


def limited_items(spark: SparkSession, root: str) -> DataFrame:
    """All items that have a limit: ``item_kind, item_id, item_pos, item, max_chars, overlap_chars``."""
    chapters = table(spark, root, "chapters").select(F.lit("chapter").alias("item_kind"), F.col("chapter_id").alias("item_id"), F.lit(0).alias("item_pos"), F.col("content").alias("item"))
    blocks = table(spark, root, "source_documents").select(F.lit("block").alias("item_kind"), F.col("document_key").alias("item_id"), F.posexplode("blocks").alias("item_pos", "item"))
    segments = table(spark, root, "structural_segments").select(F.lit("segment").alias("item_kind"), F.col("segment_key").alias("item_id"), F.lit(0).alias("item_pos"), F.col("source").alias("item"))
    items = chapters.unionByName(blocks).unionByName(segments)
    # One row for each kind of item, whatever the size of the data.
    limits = table(spark, root, "size_limits").groupBy("item_kind").agg(F.min("max_chars").alias("max_chars"), F.min_by("overlap_chars", "max_chars").alias("overlap_chars"))
    return items.join(limits, "item_kind", "left")


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of every oversized item; exact repetitions of a row once."""
    items = limited_items(spark, root).where(F.length("item") > F.col("max_chars"))
    keys = ["item_kind", "item_id", "item_pos", "version"]
    items = items.withColumn("version", F.xxhash64("item")).dropDuplicates(keys)
    return split_oversized(items, keys, "item", "max_chars", "overlap_chars").drop("version")


def p1_checks(spark: SparkSession, root: str) -> DataFrame:
    """Every oversized item put together again from its pieces: the digest of its cores in order, and how many pieces are above the
    limit, begin elsewhere than the overlap asks for, or have other characters than the item there."""
    items = limited_items(spark, root).where(F.length("item") > F.col("max_chars"))
    keys = ["item_kind", "item_id", "item_pos", "version"]
    items = items.withColumn("version", F.xxhash64("item")).dropDuplicates(keys)
    pieces = split_oversized(items, [*keys, "max_chars", "overlap_chars"], "item", "max_chars", "overlap_chars")
    core = F.substring("piece", F.col("core_start") - F.col("piece_start") + 1, F.length("piece"))
    seen = pieces.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", core.alias("t")))), lambda p: p["t"]), "").alias("t"),
        F.count_if(F.length("piece") > F.col("max_chars")).alias("n_too_long"),
        F.count_if(F.col("core_start") - F.col("piece_start") != F.least("overlap_chars", "core_start")).alias("n_wrong_overlap"),
        F.count_if(F.length("piece") != F.col("piece_end") - F.col("piece_start")).alias("n_wrong_length"),
        (F.min(F.struct("piece_no", F.col("core_start")))["core_start"] == 0).alias("from_start"),
    )
    return seen.select("item_kind", "item_id", "item_pos", F.sha2("t", 256).alias("sha256"), "n_too_long", "n_wrong_overlap", "n_wrong_length", "from_start")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    items = limited_items(spark, root)
    pieces = split_oversized(items, ["item_kind", "item_id", "item_pos"], "item", "max_chars", "overlap_chars", only_oversized=True)
    return pieces.where("n_pieces > 1 AND piece_no = 0").select("item_kind", "item_id", "item_pos").distinct()


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """Per kind: items, pieces, the longest piece and how the cuts were made."""
    pieces = split_oversized(limited_items(spark, root), ["item_kind", "item_id", "item_pos", "max_chars"], "item", "max_chars", "overlap_chars", only_oversized=True)
    inner = F.col("piece_no") < F.col("n_pieces") - 1
    return pieces.groupBy("item_kind", "max_chars").agg(
        F.count_if(F.col("piece_no") == 0).alias("n_items"),
        F.count("*").alias("n_pieces"),
        F.max(F.col("piece_end") - F.col("piece_start")).alias("longest_piece"),
        F.avg(F.col("piece_end") - F.col("piece_start")).alias("mean_piece"),
        *[F.count_if(inner & (F.col("boundary") == i)).alias(f"cuts_{n}") for i, n in enumerate(("forced", "word", "clause", "sentence", "line", "paragraph", "section"))],
    )


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_report": p1_report, "p1_checks": p1_checks}
_ITEMS = """WITH items AS (
  SELECT 'chapter' AS item_kind, chapter_id AS item_id, 0 AS item_pos, content AS item FROM chapters
  UNION ALL SELECT 'segment', segment_key, 0, source FROM structural_segments
  UNION ALL SELECT 'block', document_key, CAST(generate_subscripts(blocks, 1) - 1 AS INTEGER), unnest(blocks) FROM source_documents
)"""
ORACLE = {
    "p1_found": f"{_ITEMS} SELECT DISTINCT item_kind, item_id, CAST(item_pos AS INTEGER) AS item_pos FROM items JOIN size_limits USING (item_kind) WHERE length(item) > max_chars",
    "p1_checks": f"""{_ITEMS} SELECT DISTINCT item_kind, item_id, CAST(item_pos AS INTEGER) AS item_pos, sha256(item) AS sha256, CAST(0 AS BIGINT) AS n_too_long, CAST(0 AS BIGINT) AS n_wrong_overlap,
  CAST(0 AS BIGINT) AS n_wrong_length, true AS from_start FROM items JOIN size_limits USING (item_kind) WHERE length(item) > max_chars""",
}
