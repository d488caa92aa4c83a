"""Evaluation passages inside training text (problem 7).

The word n-grams of the held-out items form a hash set, built once and small enough to travel to every task. Each text is cut into words once, the
words become numbers of the items' vocabulary, a rolling hash of every window is looked up in the set, and windows that hit are
extended in both directions, word by word, with the edits counted (furthest-reaching paths). Rows are scanned where they lie:
nothing of the corpus is shuffled. Items beyond a stated size are taken in blocks, one scan for each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.names import free
from corpusflow.llm.glyphs import match_form
from corpusflow.session import cut_lineage, table

#: Words of a stretch that leaks, and words for each edit in it.
STRETCH, PER_EDIT = 20, 8
#: A word with the marks and invisible characters in it.
_WORD = re.compile(r"[\w\u0300-\u036f\u00ad\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]+")
_MARKUP = re.compile(r"<[^<>]{1,400}>|\[\^?\d{1,5}\](?:\([^()\s]*\))?|(?<=\])\([^()\s]*\)|&(?:\#\w{1,7}|\w{2,8});")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _blank(m: re.Match) -> str:
    return " " * len(m[0])


def strip_markup(text: str) -> str:
    """Tags, comments, note references, link targets and entities become as many spaces, so that offsets hold."""
    return _MARKUP.sub(_blank, text) if "<" in text or "[" in text or "&" in text else text


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ ids[k : len(ids) - n + 1 + k].astype(np.uint64)) * _MULT
            h ^= h >> np.uint64(29)
    return h


def longest_run(stretch: int, per_edit: int) -> int:
    """Words without an edit between them that every stretch has somewhere, whatever its length: 20 words with 3 edits have a run of 5."""
    edits = {w: (w + 3) // per_edit for w in range(stretch, stretch + 8 * per_edit)}
    return max(1, min(-(-(w - e) // (e + 1)) for w, e in edits.items()))


class ItemIndex:
    """The items' words and n-grams. Its size follows that of the items, never that of the corpus."""

    def __init__(self, items: list[tuple[int, str]], stretch: int = STRETCH, per_edit: int = PER_EDIT):
        self.stretch, self.per_edit, gram = stretch, per_edit, longest_run(stretch, per_edit)
        self.gap = stretch + 2 * -(-stretch // per_edit) + 2  # wider than what is looked at around a place
        self.vocabulary: dict[str, int] = {}
        self.item_ids, self.starts, self.lengths, stream = [], [], [], [np.full(self.gap, -2, np.int32)]
        at = self.gap
        for item_id, passage in items:
            forms = [f for f in map(match_form, _WORD.findall(strip_markup(passage or ""))) if f]
            if not forms:
                continue
            ids = np.array([self.vocabulary.setdefault(f, len(self.vocabulary) + 1) for f in forms], np.int32)
            self.item_ids.append(item_id)
            self.starts.append(at)
            self.lengths.append(len(ids))
            stream += [ids, np.full(self.gap, -2, np.int32)]
            at += len(ids) + self.gap
        self.words = np.concatenate(stream)
        self.starts, self.lengths = np.array(self.starts, np.int64), np.array(self.lengths, np.int64)
        self.tables = {}
        for n in sorted({min(gram, int(x)) for x in self.lengths}):
            own = np.concatenate([np.arange(s, s + max(0, x - n + 1)) for s, x in zip(self.starts, self.lengths) if min(gram, x) == n])
            h = _windows(self.words, n)[own]
            order = np.argsort(h, kind="stable")
            keys, first, counts = np.unique(h[order], return_index=True, return_counts=True)
            size = 1 << max(16, math.ceil(math.log2(max(1, len(keys)))) + 5)
            bits = np.zeros(size, dtype=bool)
            bits[(keys & np.uint64(size - 1)).astype(np.int64)] = True
            bits = np.packbits(bits, bitorder="little")
            self.tables[n] = (bits, keys, first, counts, own[order])

    def seeds(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of runs of equal words: places in ``ids`` and in ``words``."""
        bits, keys, first, counts, places = self.tables[n]
        h = _windows(ids, n)
        place = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
        at = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
        if not len(at) or not len(keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        hit = keys[k] == h[at]
        at, k = at[hit], k[hit]
        c = counts[k]
        offset = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        g, q = np.repeat(at, c), places[np.repeat(first[k], c) + offset]
        fresh = ids[g - 1] != self.words[q - 1]
        return g[fresh], q[fresh]


def _reach(a: list[int], b: list[int], most: int) -> list[tuple[int, int, int]]:
    """For 0..most edits: ``(words of b passed, words of a passed, equal words)`` on the furthest path that ends in an equal word."""
    best: list[tuple[int, int, int]] = []
    front: dict[int, tuple[int, int]] = {0: (0, 0)}  # diagonal (place in a - place in b) -> furthest place in b, equal words
    top = (0, 0, 0)
    na, nb = len(a), len(b)
    for edits in range(most + 1):
        after: dict[int, tuple[int, int]] = {}
        for d, (j, m) in front.items():
            i, j0 = j + d, j
            while i < na and j < nb and a[i] == b[j]:
                i, j = i + 1, j + 1
            m += j - j0
            if j > j0 and j > top[0]:
                top = (j, i, m)
            for dd, jj in ((d, j + 1), (d + 1, j), (d - 1, j + 1)):
                if jj <= nb and jj + dd <= na and (dd not in after or after[dd] < (jj, m)):
                    after[dd] = (jj, m)
        best.append(top)
        front = after
    return best


def longest_stretch(doc: list[int], item: list[int], g: int, q: int, n: int, stretch: int = STRETCH, per_edit: int = PER_EDIT) -> tuple[int, int, int, int, int] | None:
    """The longest stretch through the equal words at ``doc[g:g+n]`` and ``item[q:q+n]`` that is close enough to leak:
    ``(words of the item, edits, doc from, doc to, equal words)``."""
    most = len(item) // per_edit + 1
    ahead = _reach(doc[g + n :], item[q + n :], most)
    back = _reach(doc[:g][::-1], item[:q][::-1], most)
    need, found = min(stretch, len(item)), None
    for e1, (f_item, f_doc, f_same) in enumerate(ahead):
        for e2, (b_item, b_doc, b_same) in enumerate(back):
            words, edits, same = n + f_item + b_item, e1 + e2, n + f_same + b_same
            if edits > most:
                break
            if words >= need and edits * per_edit <= words + 3 and same >= need - need // per_edit - 1 and (not found or words - edits > found[0] - found[1]):
                found = (words, edits, g - b_doc, g + n + f_doc, same)
    return found


def scan(index: ItemIndex, cache: dict[str, int], texts: list[str | None]) -> list[list[tuple]]:
    """For each text its leaks: ``(item_id, char_from, char_to, words, edits)``."""
    gap, between = index.gap, np.full(index.gap, -3, np.int32)
    vocabulary, streams, starts, at = index.vocabulary, [between], [], gap
    for text in texts:
        ids = []
        if text:
            words = _WORD.findall(strip_markup(text))
            try:
                ids = [cache[w] for w in words]
            except KeyError:
                if len(cache) > 1_000_000:
                    cache.clear()
                for w in words:
                    if w not in cache:
                        f = match_form(w)
                        cache[w] = vocabulary.get(f, 0 if f else -9)
                ids = [cache[w] for w in words]
        arr = np.array(ids, np.int32)
        arr = arr[arr != -9]
        starts.append(at)
        streams += [arr, between]
        at += len(arr) + gap
    stream, begin = np.concatenate(streams), np.array(starts, np.int64)
    out: list[list[tuple]] = [[] for _ in texts]
    for n in index.tables:
        g, q = index.seeds(stream, n)
        if not len(g):
            continue
        which = np.searchsorted(index.starts, q, side="right") - 1
        need = np.minimum(index.stretch, index.lengths[which])
        keep = _promising(stream, index.words, g, q, need, index.stretch, index.per_edit)
        g, q, which = g[keep], q[keep], which[keep]
        doc = np.searchsorted(begin, g, side="right") - 1
        offsets: dict[int, list[tuple[int, int]]] = {}
        done: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for gg, qq, w, d in zip(g.tolist(), q.tolist(), which.tolist(), doc.tolist()):
            if any(lo <= gg < hi for lo, hi in done.get((d, w), ())):
                continue
            s, length = int(index.starts[w]), int(index.lengths[w])
            low, high = max(starts[d], gg - length * 5 // 4 - 8), gg + length * 5 // 4 + 8
            end = starts[d + 1] - gap if d + 1 < len(starts) else len(stream) - gap
            found = longest_stretch(stream[low : min(high, end)].tolist(), index.words[s : s + length].tolist(), gg - low, qq - s, n, index.stretch, index.per_edit)
            if found:
                words, edits, lo, hi, _ = found
                lo, hi = lo + low, hi + low
                done.setdefault((d, w), []).append((lo, hi))
                if d not in offsets:
                    offsets[d] = [m.span() for m in _WORD.finditer(strip_markup(texts[d])) if cache.get(m[0], -9) != -9]
                out[d].append((index.item_ids[w], offsets[d][lo - starts[d]][0], offsets[d][hi - 1 - starts[d]][1], words, edits))
    return out


def _promising(a: np.ndarray, b: np.ndarray, g: np.ndarray, q: np.ndarray, need: np.ndarray, stretch: int, per_edit: int) -> np.ndarray:
    """Seeds around which enough words agree, on this or the next diagonals, for a stretch to be possible. Never refuses a stretch.

    The gaps around every text and item are wider than what is looked at, so no place lies outside.
    """
    drift, reach = -(-stretch // per_edit), stretch + -(-stretch // per_edit)
    keep = np.zeros(len(g), bool)
    for lo in range(0, len(g), 200_000):
        gg, qq, nd = g[lo : lo + 200_000], q[lo : lo + 200_000], need[lo : lo + 200_000]
        total = np.zeros((2 * reach + 1, len(gg)), np.int16)
        for t in range(-reach + 1, reach + 1):
            x = a[gg + t]
            same = np.zeros(len(gg), bool)
            for d in range(-drift, drift + 1):
                same |= x == b[qq + t + d]
            total[t + reach] = total[t + reach - 1] + same
        best = np.zeros(len(gg), np.int16)
        for t in range(reach, 2 * reach + 1):
            np.maximum(best, total[t] - total[t - reach], out=best)
        keep[lo : lo + 200_000] = best >= nd - -(-nd // per_edit)
    return keep


_LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("char_from", T.IntegerType()), T.StructField("char_to", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("n_edits", T.IntegerType())])


def _finder(held: Broadcast):
    @F.pandas_udf(T.ArrayType(_LEAK))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, cache = held.value, {}
        for s in batches:
            found = []
            for lo in range(0, len(s), 500):
                found += scan(index, cache, s.iloc[lo : lo + 500].tolist())
            yield pd.Series(found, dtype=object)

    return find


def leaked_spans(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, block_chars: int = 8_000_000, stretch: int = STRETCH, per_edit: int = PER_EDIT) -> DataFrame:
    """Stretches of ``docs.text`` that come from an item's passage: ``doc_id, item_id, char_from, char_to, n_words, n_edits``.

    A stretch holds the whole passage or at least ``stretch`` of its words in order, with at most one edit in ``per_edit`` words. Letters
    that look alike, case, width, invisible characters, punctuation, white space and markup don't count. Offsets are code points.
    Null and empty texts and passages match nothing; equal passages of several items are each reported; repeated rows of a table give
    repeated rows. Items are read in blocks of about ``block_chars`` characters, and the corpus is scanned once for each block: its index
    is built once, and gone again before the next one is, so that no task and no driver ever holds more of them. Columns besides those
    named are ignored.
    """
    spark = docs.sparkSession
    wanted = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p"))
    chars = wanted.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    rows, out = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), None
    for k in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast(ItemIndex(sorted((r.i, r.p) for r in part.collect()), stretch, per_edit))
        found = rows.select("d", F.explode(_finder(held)("t")).alias("l"))
        if blocks > 1:
            found = cut_lineage(found)
            held.unpersist(blocking=True)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("d").alias(doc_id), *[F.col(f"l.{f}").alias(f) for f in _LEAK.names])


def without_spans(docs: DataFrame, doc_id: str, text: str, spans: DataFrame, few: int = 200_000) -> DataFrame:
    """``docs`` with the leaked stretches cut out of ``text``; only documents with leaks are touched, and no others are moved as long as
    those are at most ``few``: then their offsets travel to the texts. A document in ``spans`` twice is cut once."""
    name = free("_doc", docs.columns)
    cuts = cut_lineage(spans.groupBy(F.col(doc_id).alias(name)).agg(F.array_sort(F.collect_set(F.struct("char_from", "char_to"))).alias(f"{name}_cuts")))

    @F.pandas_udf(T.StringType())
    def remove(texts: pd.Series, lists: pd.Series) -> pd.Series:
        def one(t, spans):
            if t is None or spans is None:
                return t
            out, at = [], 0
            for s in spans:
                out.append(t[at : s["char_from"]])
                at = max(at, s["char_to"])
            return "".join([*out, t[at:]])

        return pd.Series([one(t, c) for t, c in zip(texts, lists)], dtype=object)

    small = cuts.count() <= few
    joined = docs.join(F.broadcast(cuts) if small else cuts, docs[doc_id] == cuts[name], "left")
    touched = F.col(f"{name}_cuts").isNotNull()
    return joined.withColumn(text, F.when(touched, remove(F.when(touched, F.col(text)), F.col(f"{name}_cuts"))).otherwise(F.col(text))).drop(name, f"{name}_cuts")


def p7_spans(spark: SparkSession, root: str) -> DataFrame:
    return leaked_spans(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items").dropDuplicates(["item_id"]), "item_id", "passage")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_spans(spark, root).select("item_id", "doc_id").distinct()


def p7_items(spark: SparkSession, root: str) -> DataFrame:
    """Per item that leaked: the documents, and how much of it they hold."""
    return p7_spans(spark, root).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest_words"), F.min("n_edits").alias("least_edits"))


def p7_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Every document that holds a leak, with the leaks cut out: its length before and after, and the digest of what is left."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    clean = without_spans(docs.withColumn("n_chars", F.length("text")), "doc_id", "text", p7_spans(spark, root))
    return clean.where(F.length("text") < F.col("n_chars")).select("doc_id", "n_chars", F.length("text").alias("n_left"), F.sha2("text", 256).alias("sha256"))


QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans, "p7_items": p7_items, "p7_cleaned": p7_cleaned}
ORACLE: dict[str, str] = {}
