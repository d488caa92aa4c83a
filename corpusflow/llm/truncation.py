"""Texts cut off by field limits or in transfer (problem 4).

A value that does not end like a finished text is a candidate. Its tail, the words since the sentence began or the last three, is
looked up among all sentences of all values: the tail of every sentence position is keyed by the words before it and by each prefix
of the word itself, counted before anything is shuffled, so that "is a strict prefix of longer copies" and "ends a sentence as it
stands" are two counts found by one equi-join. Where the ending alone leaves no doubt (no end of sentence, and no heading, list,
verse, signature or broken speech), the counts are evidence only; where it does, as with an ellipsis, they decide.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusflow.llm.language import sentences
from corpusflow.session import cut_lineage, table

#: Words of context: all since the start of the sentence up to this many, beyond it the last two.
CONTEXT = 4
#: Longer copies that make a tail of whole words an unfinished one; a beginning of a word needs one.
SURE = 5
#: Bits of the filter that tells the tasks which contexts are asked for: it has this size (1 MB) for any number of them, and what it
#: lets through in excess falls out of the join.
FILTER_BITS = 1 << 23
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"\w+")
_JUNK = re.compile(r"(?:\\+[nrt\"']?|�|&\#?\w{0,8}|<[^<>]{0,60}|[\u00ad\u200b-\u200f\u2060\ufeff]|\[(?:\.\.\.|…|truncated|cut)\]|\((?:truncated|cut)\)|\s)+$", re.I)
_ENDED = re.compile(r"(?:[.!?．！？。](?<!\.\.\.)[\s\"'”“’»)\]*_]*|[—–…-]\s?[\"'”“’»)\]]+[*_]*|-->|(?:\*\s?){3}|-{3,}|\](?:\([^()\s]*\))?|\|)$")
_DOTS = re.compile(r"(?:…|\.\.\.)[*_]*$")
_HEADING, _ITEM = re.compile(r"\s*#{1,6}\s"), re.compile(r"\s*(?:[-*•+]|\d{1,3}[.)])\s+(.*)")
_SIGNED = re.compile(r"\s*(?:—|–|--?)\s?(?:[A-ZÀ-ÞА-ЯЁІЇЄҐΑ-Ω][\w.'’-]*\s?){1,4}$")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")


#: An ending that fills all that is looked at: it may have begun before.
_LONG_END = re.compile(r"[\s\"'”“’»)\]*_]+|[^()\s]*\)")


def _without_junk(text: str) -> str:
    """``text`` without what was put behind the cut. Only the end is read, and more of it as long as all of that is such."""
    size = 128
    while True:
        low = max(0, len(text) - size)
        m = _JUNK.search(text, low)
        if m is None or low == 0 or m.start() > low + 64:  # one piece of it has 64 characters at most, or repeats one
            return text if m is None else text[: m.start()]
        size *= 4


def _is_ended(core: str) -> bool:
    low = max(0, len(core) - 64)
    return bool(_ENDED.search(core, low)) or low > 0 and bool(_LONG_END.fullmatch(core, low)) and bool(_ENDED.search(core))


def ending(text: str) -> tuple[str, str]:
    """How a text ends: ``done``, or ``open`` (inside a word or sentence), ``dots``, ``list`` or ``verse``; and the text before what
    was put behind the cut."""
    core = _without_junk(text)
    if not core or _is_ended(core):
        return "done", core
    block = _PARAGRAPH.split(core)[-1]
    lines = block.strip("\n").split("\n")
    last = lines[-1]
    if _DOTS.search(core):
        return "dots", _DOTS.sub("", core)
    if last.rstrip().endswith(")") and block.count("(") <= block.count(")"):
        return "done", core
    if _HEADING.match(last) or _SIGNED.match(last):
        return "done", core
    item = _ITEM.match(last)
    if item:
        others = [m[1] for m in map(_ITEM.match, lines[:-1]) if m]
        plain = sum(not _ENDED.search(o.rstrip()) for o in others)
        return ("list" if len(item[1].split()) <= 6 and 2 * plain >= len(others) else "open"), core
    if len(lines) > 1:
        free = [x for x in lines[:-1] if x.strip() and not re.search(r"[.!?,;:]\s*$", x) and x.lstrip()[:1].isupper() and len(x) <= 60]
        if 5 * len(free) >= 4 * (len(lines) - 1) and last.lstrip()[:1].isupper() and len(last) <= 60 and not re.search(r"[,;:]$", last):
            return "verse", core
    return "open", core


def _words(sentence: str) -> list[str]:
    s = sentence.lower()
    return _WORD.findall(s if s.isascii() else unicodedata.normalize("NFKC", _HIDDEN.sub("", s)))


def _context(words: list[str], i: int) -> str:
    return "^ " + " ".join(words[:i]) if i <= CONTEXT else " ".join(words[i - 2 : i])


def _any(word: str) -> str:
    """The context that stands for any; words are kept apart by their first two characters."""
    return "~" + word[:2]


def tail(text: str) -> tuple[str, str, str] | None:
    """``(ending, context, last word or its beginning)`` of a candidate; None for a finished text."""
    kind, core = ending(text)
    if kind == "done":
        return None
    spans = sentences(core)
    words = _words(core[spans[-1][0] : spans[-1][1]]) if spans else []
    if not words:
        return None
    return kind, _context(words, len(words) - 1), words[-1]


def context_hash(context: str) -> int:
    """Where a context stands in the filter."""
    h = 0
    for w in context.split(" "):
        h = (h * 31 + zlib.crc32(w.encode())) % FILTER_BITS
    return h


def _passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def _context_hashes(words: list[str], place: np.ndarray, crc: dict[str, int]) -> np.ndarray:
    """``context_hash`` of the context of every word, from its place in its sentence and the hashes of the words before."""
    try:
        h = np.array([crc[w] for w in words], np.int64)
    except KeyError:
        if len(crc) > 1_000_000:
            crc.clear()
        for w in words:
            if w not in crc:
                crc[w] = zlib.crc32(w.encode())
        h = np.array([crc[w] for w in words], np.int64)
    at = np.arange(len(words))
    out = h[np.maximum(at - 2, 0)] * 31 + h[np.maximum(at - 1, 0)]
    for p in range(CONTEXT + 1):
        here = at[place == p]
        x = np.full(len(here), zlib.crc32(b"^"), np.int64)
        for k in range(max(1, p)):
            x = (x * 31 + (h[here - p + k] if p else 0)) % FILTER_BITS
        out[here] = x
    return out % FILTER_BITS


def count_tails(texts: list[str | None], total: Counter, bits: np.ndarray | None = None, crc: dict[str, int] | None = None) -> None:
    """Add the places of all words: (context, word, ends a sentence); with ``bits`` of those whose context passes the filter only. The
    last word of an unfinished text is left out."""
    said: list[str] = []
    sizes: list[int] = []
    closed: list[bool] = []
    for t in texts:
        if not t:
            continue
        kind, core = ending(t)
        spans = sentences(core)
        for k, (lo, hi) in enumerate(spans):
            s = core[lo:hi]
            words = _words(s)
            open_ = k == len(spans) - 1 and kind != "done"
            if open_:
                del words[-1:]
            if words:
                said += words
                sizes.append(len(words))
                closed.append(not open_ and (s[-1] in "!?…．！？。" or s[-1] == "." and s[-3:] != "..." or bool(_ENDED.search(s))))
    if not said:
        return
    ends = np.cumsum(sizes)
    place = np.arange(len(said)) - np.repeat(ends - sizes, sizes)
    final = np.zeros(len(said), bool)
    final[ends - 1] = closed
    wanted = range(len(said)) if bits is None else np.flatnonzero(_passes(bits, _context_hashes(said, place, {} if crc is None else crc))).tolist()
    for i in wanted:
        p = int(place[i])
        total[("^ " + " ".join(said[i - p : i]) if p <= CONTEXT else " ".join(said[i - 2 : i])), said[i], bool(final[i])] += 1
    last = Counter(said[i] for i in np.flatnonzero(final).tolist())
    counts = Counter(said)
    starts = [*{_any(w) for w in counts}]
    kept = set(starts if bits is None else itertools.compress(starts, _passes(bits, np.array([context_hash(c) for c in starts]))))
    for w, n in counts.items():
        if (c := _any(w)) in kept:
            if n > last[w]:
                total[c, w, False] += n - last[w]
            if last[w]:
                total[c, w, True] += last[w]


_TAIL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("ctx", T.StringType()), T.StructField("last", T.StringType())])


@F.pandas_udf(_TAIL)
def _tails(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows = [(tail(t) if t else None) or (None, None, None) for t in s]
        yield pd.DataFrame(rows, columns=["kind", "ctx", "last"])


def _counted(held: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, crc = Counter(), {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame([(c, w, n, n if e else 0) for (c, w, e), n in total.items()], columns=["ctx", "w", "n", "ends"])
            total.clear()
            return frame

        for b in batches:
            for lo in range(0, len(b), 1000):
                count_tails(b["t"].iloc[lo : lo + 1000].tolist(), total, held.value, crc)
                if len(total) > 150_000:
                    yield out()
        yield out()

    return run


def _filter_of(asked: DataFrame) -> np.ndarray:
    """The bits of the contexts ``ctx``: as many rows come to the driver as the filter has words of 64 bits, at most."""
    bit = F.aggregate(F.split("ctx", " "), F.lit(0).cast("long"), lambda h, w: F.pmod(h * 31 + F.crc32(w), F.lit(FILTER_BITS).cast("long")))
    rows = asked.select(bit.alias("b")).select(F.shiftright("b", 6).alias("i"), F.expr("shiftleft(1L, cast(b & 63 AS int))").alias("v")).groupBy("i").agg(F.bit_or("v").alias("v")).collect()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[[r.i for r in rows]] = np.array([r.v for r in rows], np.int64).view(np.uint64)
    return out


def tail_counts(values: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """``ctx, last, n_longer, n_end, n_word`` for the contexts ``ctx`` of ``asked``: how often a word with the beginning ``last`` goes on
    there, how often ``last`` ends a sentence, and how often it stands as a word.

    Counts leave the tasks added up, and of those only the contexts asked for. A context has as many rows after the first exchange as
    there are words that follow it, however often they do.
    """
    held = values.sparkSession.sparkContext.broadcast(_filter_of(asked))
    words = values.select(F.col(text).alias("t")).mapInPandas(_counted(held), "ctx string, w string, n long, ends long").groupBy("ctx", "w").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    # As many lengths as a word has letters.
    lengths = asked.groupBy("ctx").agg(F.collect_set(F.length("last")).alias("ks"))
    starts = words.join(lengths, "ctx").select("ctx", "w", "n", "ends", F.explode(F.filter("ks", lambda k: k <= F.length("w"))).alias("k"))
    whole = F.col("k") == F.length("w")
    return (
        starts.select("ctx", F.substring("w", F.lit(1), F.col("k")).alias("last"), F.when(whole, F.col("n") - F.col("ends")).otherwise(F.col("n")).alias("longer"), F.when(whole, F.col("ends")).otherwise(0).alias("end"), F.when(whole, F.col("n")).otherwise(0).alias("word"))
        .groupBy("ctx", "last")
        .agg(F.sum("longer").alias("n_longer"), F.sum("end").alias("n_end"), F.sum("word").alias("n_word"))
    )


def truncated(values: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Candidates with their evidence: ``keys, ending, tail_word, n_longer, n_end, n_word, cut``.

    ``n_longer`` and ``n_end`` count, over all values, the longer copies of the tail and the sentences it ends; ``n_word`` counts the
    tail's last word as a whole word anywhere. ``cut`` tells whether the value was cut: it ends inside a word or sentence; or with an
    ellipsis after a tail that goes on elsewhere (as a word's beginning, or SURE times) and never ends a sentence; or in a list or verse with the beginning of a word that
    nowhere stands whole. Finished values, nulls and empty texts give no row; repeated rows give one; an empty table gives none.
    """
    cand = cut_lineage(values.select(F.struct(*keys).alias("k"), _tails(F.col(text)).alias("x")).where("x.kind IS NOT NULL").select("k", "x.*"))
    # A candidate asks for its tail in its context, and where that may not decide, for its last word in any; one letter tells nothing.
    contexts = F.array(F.struct(F.col("ctx").alias("c"), F.lit(0).alias("any")), F.struct(F.concat(F.lit("~"), F.substring("last", 1, 2)).alias("c"), F.lit(1).alias("any")))
    asked = cand.select("k", "kind", "last", F.explode(F.when((F.length("last") < 2) | (F.col("kind") == "open"), F.slice(contexts, 1, 1)).otherwise(contexts)).alias("q")).select("k", "kind", "last", F.col("q.c").alias("ctx"), "q.any")
    got = asked.join(tail_counts(values, text, asked), ["ctx", "last"], "left").groupBy("k", "kind", "last").agg(
        *[F.coalesce(F.max(F.when(F.col("any") == a, F.col(n))), F.lit(0)).alias(f"{n}_{a}") for n in ("n_longer", "n_end", "n_word") for a in (0, 1)]
    )
    goes_on = (F.col("n_longer_0") >= SURE) | (F.col("n_longer_0") > 0) & (F.col("n_word_0") == 0)
    dots = F.when(F.col("n_longer_0") + F.col("n_end_0") > 0, (F.col("n_end_0") == 0) & goes_on).otherwise((F.col("n_longer_1") > 0) & (F.col("n_end_1") == 0))
    cut = F.when(F.col("kind") == "open", True).when(F.col("kind") == "dots", dots).otherwise((F.col("n_word_1") == 0) & (F.col("n_longer_1") > 0))
    return got.select(*[F.col("k").getField(k).alias(k) for k in keys], F.col("kind").alias("ending"), F.col("last").alias("tail_word"), F.col("n_longer_0").alias("n_longer"), F.col("n_end_0").alias("n_end"), F.col("n_word_1").alias("n_word"), cut.alias("cut"))


_STEP = "_h binary, _k string, _n long, _border int, _pid int, _text string, _longer string, _m long"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values in order, each against the next; the first and the last of a partition also go out by themselves."""
    pid, last = TaskContext.get().partitionId(), None
    for frame in batches:
        rows = []
        for h, k, t in zip(frame["_h"], frame["_k"], frame["_text"]):
            if last is None:
                rows.append((h, k, len(t), 0, pid, t, None, None))
            elif t.startswith(last[2]):
                rows.append((last[0], last[1], len(last[2]), None, None, None, k, len(t)))
            last = (h, k, t)
        yield pd.DataFrame(rows, columns=["_h", "_k", "_n", "_border", "_pid", "_text", "_longer", "_m"])
    if last is not None:
        yield pd.DataFrame([(last[0], last[1], len(last[2]), 1, pid, last[2], None, None)], columns=["_h", "_k", "_n", "_border", "_pid", "_text", "_longer", "_m"])


def strict_prefixes(values: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, longer, n_chars, n_longer_chars``: the rows whose text is the beginning of a longer text, and the row that has it.

    The different values are sorted by ranges. If any value begins with a text, then the one that follows it in the order does, so each
    is compared with its successor only, however many share a beginning; what is compared over the borders of the ranges are two values
    for each. ``longer`` is the keys (a struct) of the successor: the least of those rows with it. Every copy of a value has a row,
    repeated rows one; nulls and empty texts have none, and are nobody's beginning. An empty table gives none.
    """
    rows = values.where(F.length(text) > 0).select(F.struct(*keys).alias("k"), F.col(text).alias("t")).withColumn("h", F.unhex(F.sha2("t", 256)))
    kind = rows.schema["k"].dataType.simpleString()
    distinct = rows.groupBy(F.col("h").alias("_h"), F.col("t").alias("_text")).agg(F.to_json(F.min("k"), {"ignoreNullFields": "false"}).alias("_k"))
    laid = distinct.select("_h", "_k", "_text").repartitionByRange("_text").sortWithinPartitions("_text")
    seen = cut_lineage(laid.mapInPandas(_neighbours, _STEP))
    # Two rows for each partition.
    borders = seen.where("_border IS NOT NULL")
    following = Window.orderBy("_pid", "_border")
    after = [F.lead(c).over(following).alias(a) for c, a in (("_border", "b2"), ("_text", "t2"), ("_k", "k2"), ("_n", "n2"))]
    over = borders.select("_h", "_n", "_text", "_border", *after).where((F.col("_border") == 1) & (F.col("b2") == 0) & F.startswith("t2", "_text"))
    found = seen.where("_border IS NULL").select("_h", "_n", "_longer", "_m").unionByName(over.select("_h", "_n", F.col("k2").alias("_longer"), F.col("n2").alias("_m")))
    out = rows.select("k", "h").distinct().join(found, F.col("h") == F.col("_h"))
    return out.select(*[F.col("k").getField(k).alias(k) for k in keys], F.from_json("_longer", kind).alias("longer"), F.col("_n").alias("n_chars"), F.col("_m").alias("n_longer_chars"))


def p4_values(spark: SparkSession, root: str) -> DataFrame:
    answers = table(spark, root, "translator_responses").select(F.lit("response").alias("record_kind"), F.col("response_id").alias("record_id"), F.lower(F.trim("route")).alias("source"), F.col("translation").alias("value"))
    chapters = table(spark, root, "chapters").select(F.lit("chapter").alias("record_kind"), F.col("chapter_id").alias("record_id"), F.col("source_format").alias("source"), F.col("content").alias("value"))
    return answers.unionByName(chapters)


def p4_evidence(spark: SparkSession, root: str) -> DataFrame:
    return truncated(p4_values(spark, root), ["record_kind", "record_id"], "value").distinct()


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return truncated(p4_values(spark, root), ["record_kind", "record_id"], "value").where("cut").select("record_kind", "record_id").distinct()


def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of cut records per route of the responses and per format of the chapters; each record once."""
    records = p4_values(spark, root).where("value IS NOT NULL").select("record_kind", "record_id", "source").distinct()
    cut = p4_found(spark, root).withColumn("cut", F.lit(1))
    return records.join(cut, ["record_kind", "record_id"], "left").groupBy("record_kind", "source").agg(F.count("*").alias("n_records"), F.count("cut").alias("n_cut"), F.round(F.count("cut") / F.count("*"), 6).alias("share"))


def p4_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """Whole values that are the beginning of a longer value elsewhere."""
    found = strict_prefixes(p4_values(spark, root), ["record_kind", "record_id"], "value")
    return found.select("record_kind", "record_id", F.col("longer.record_kind").alias("longer_kind"), F.col("longer.record_id").alias("longer_id"), "n_chars", "n_longer_chars")


def p4_prefix_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of records that are the beginning of a longer value, per route and format."""
    records = p4_values(spark, root).where("value IS NOT NULL").select("record_kind", "record_id", "source").distinct()
    hit = p4_prefixes(spark, root).select("record_kind", "record_id").distinct().withColumn("hit", F.lit(1))
    return records.join(hit, ["record_kind", "record_id"], "left").groupBy("record_kind", "source").agg(F.count("*").alias("n_records"), F.count("hit").alias("n_prefixes"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


QUERIES = {"p4_found": p4_found, "p4_evidence": p4_evidence, "p4_rates": p4_rates, "p4_prefixes": p4_prefixes, "p4_prefix_rates": p4_prefix_rates}
_VALUES = """v AS (SELECT 'response' AS record_kind, response_id AS record_id, lower(trim(route, ' ')) AS source, translation AS value FROM translator_responses
  UNION ALL SELECT 'chapter', chapter_id, source_format, content FROM chapters),
d AS (SELECT value, min({'k': record_kind, 'i': record_id}) AS k FROM v WHERE length(value) > 0 GROUP BY 1),
s AS (SELECT a.value, arg_min(b.k, b.value) AS k, CAST(arg_min(length(b.value), b.value) AS BIGINT) AS n FROM d a JOIN d b ON starts_with(b.value, a.value) AND length(b.value) > length(a.value) GROUP BY 1),
p AS (SELECT DISTINCT v.record_kind, v.record_id, s.k.k AS longer_kind, s.k.i AS longer_id, CAST(length(value) AS BIGINT) AS n_chars, s.n AS n_longer_chars FROM v JOIN s USING (value))"""
ORACLE = {
    "p4_prefixes": f"WITH {_VALUES} SELECT * FROM p",
    "p4_prefix_rates": f"""WITH {_VALUES}, r AS (SELECT DISTINCT record_kind, record_id, source FROM v WHERE value IS NOT NULL), h AS (SELECT DISTINCT record_kind, record_id, 1 AS hit FROM p)
SELECT record_kind, source, count(*) AS n_records, count(hit) AS n_prefixes, round(count(hit) / count(*), 6) AS share FROM r LEFT JOIN h USING (record_kind, record_id) GROUP BY 1, 2""",
}
