"""Language of documents and of the segments of mixed ones (problem 8).

The model averages hashed subword embeddings of a sentence and puts a linear softmax on the average. It is trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents, cleaned of sentences that stand apart from most of their label,
and once of those that contradict it, and calibrated on held-out sentences: a temperature for the confidence, and the confidence below which a sentence is rejected. A softmax
is sure of anything, so a sentence is also rejected, before it, when too few of its subwords were ever seen in the language: how few
is calibrated with each language left out in turn. For use, embedding and softmax fold into one row of scores for each distinct word,
so that a text costs one look-up for each word. Rows are labelled where they lie; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.glyphs import one_script
from corpusflow.session import table

#: What a text or segment has whose language is none of those that the labels teach.
UNDETERMINED = "und"
#: A language is learned when at least so many documents, and so large a share of the labelled ones, have its label; at most so many
#: languages, those of most documents, as each has a bit in the table of subwords seen.
LEAST_DOCS, LEAST_SHARE, MOST_LANGUAGES = 2, 0.002, 32
#: Places in the table of subwords seen, and the sentences of a language in which one must have been.
PLACES, OFTEN_SEEN = 1 << 18, 2
#: Rejection is set half way between where this share of every language left out is rejected and where that of what is known would be,
#: and never above the latter.
REJECT_UNKNOWN, REJECT_KNOWN = 0.95, 0.005
#: A sentence stands apart from its label when its subwords are so many deviations rarer there than usual.
APART = 2.5
LANGUAGES = ("de", "en", "es", "fr", "pt", "ru", "uk")
#: Notations of the languages besides the two-letter codes: fixed values, in lower case.
NOTATIONS = {
    "de": "deu ger german deutsch allemand alemán alemão немецкий німецька",
    "en": "eng english englisch anglais inglés inglês английский англійська",
    "es": "spa spanish español castellano castilian spanisch espagnol espanhol испанский іспанська",
    "fr": "fra fre french français französisch francés francês французский французька",
    "pt": "por portuguese português portugiesisch portugais portugués португальский португальська",
    "ru": "rus russian русский russisch russe ruso russo російська",
    "uk": "ukr ukrainian українська ukrainisch ukrainien ucraniano украинский",
}
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unknown", "n/a", "na", "none", "null", "mul", "mis", "zxx", "xx", "other", "unk")
#: How Cyrillic is written in Latin letters: fixed values.
ROMAN = dict(zip("абвгдезийклмнопрстуфхцчшщъыьэюяёґєії", "a b v g d e z i y k l m n o p r s t u f kh ts ch sh shch ' y ' e yu ya yo g ye i yi".split(" "))) | {"ж": "zh"}
#: A sentence in another language than most of its text counts from this confidence on.
MINOR = 0.98
#: A whole sentence has at least so many words besides what is inserted into it.
SHORTEST = 4
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_BREAK = re.compile(r"(?<=[.!?…．！？。])[\"'”“»«’)\]]*\s+(?![»,])|\n+")
_END = re.compile(r"[.!?…．！？。]+[\"'”“»’)\]\s*_]*$")
#: What is inserted into a sentence, in brackets, emphasis or quotation marks: it may be in another language than the sentence.
_INSERTED = re.compile(r"(?<=\S\s)(?:\([^()]*\)|\*[^*]*\*|_[^_]*_|[“„«\"][^“”„«»\"]*[”“»\"])")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_NOT_PROSE = re.compile(r"\s*(?:#{1,6}\s|<!--|\* \* \*|[—–-] ?[^\s.]+ [^\s.]+$)")


def label_code(label: Column) -> Column:
    """The two-letter code that a label in any notation names; null where it names no language; the label itself where unknown."""
    clean = F.lower(F.trim(F.regexp_replace(label, r"[\s\p{Z}]+", " ")))
    root = F.regexp_extract(clean, r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    names = {n: code for code, text in NOTATIONS.items() for n in (code, *text.split())}
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    known = F.coalesce(F.try_element_at(pairs, clean), F.try_element_at(pairs, root))
    nothing = clean.isin(*NO_LANGUAGE) | ~clean.rlike(r"\p{L}")
    return F.when(label.isNull() | nothing, F.lit(None)).otherwise(F.coalesce(known, F.when(root != "", root), clean))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences and lines of a text, without the white space between."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        end = m.start() + len(m[0].rstrip())
        if text[at:end].strip():
            out.append((at, end))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def subwords(word: str, buckets: int) -> list[int]:
    """Hashed character n-grams of 2 to 4, with the ends of the word, and the word itself."""
    w = f"<{word}>"
    grams = {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)} | {w}
    return [zlib.crc32(g.encode()) % buckets for g in sorted(grams)]


def places(word: str) -> set[int]:
    """Where the character n-grams of 3 and 4 of a word stand in the table of subwords seen."""
    w = f"<{word}>"
    return {zlib.crc32(w[i : i + n].encode()) % PLACES for n in (3, 4) for i in range(len(w) - n + 1)}


@dataclass
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # bucket x language: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.5
    seen: np.ndarray | None = None  # place -> a bit for each language in which training saw the subword
    least_seen: float = 0.0

    def word(self, w: str) -> np.ndarray:
        """Scores of each language and the number of subwords; how many are seen in each language, and of how many."""
        own, k = one_script(w), len(self.languages)
        ids, at = subwords(own, len(self.scores)), [*places(own)]
        out = np.zeros(2 * k + 2, np.float32)
        out[:k], out[k], out[2 * k + 1] = self.scores[ids].sum(0), len(ids), len(at)
        if self.seen is not None and at:
            out[k + 1 : 2 * k + 1] = ((self.seen[at][:, None] >> np.arange(k, dtype=np.uint32)) & 1).sum(0)
        return out

    def confidence(self, sums: np.ndarray) -> np.ndarray:
        k = len(self.languages)
        z = (sums[:, :k] / np.maximum(sums[:, k : k + 1], 1) + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def share_seen(self, sums: np.ndarray) -> np.ndarray:
        """The share of subwords that training saw in each language."""
        k = len(self.languages)
        return sums[:, k + 1 : 2 * k + 1] / np.maximum(sums[:, -1:], 1)


def _words(text: str) -> list[str]:
    t = text.lower()
    if not t.isascii():
        if _INVISIBLE.search(t):
            t = _INVISIBLE.sub("", t)
        t = unicodedata.normalize("NFKC", t)
    return _WORD.findall(t)


def romanised(words: Sequence[str]) -> list[str]:
    return ["".join(ROMAN.get(c, c) for c in w) for w in words]


def train(samples: Sequence[tuple[Sequence[str], int]], languages: tuple[str, ...] = LANGUAGES, dim: int = 12, buckets: int = 1 << 15, epochs: int = 4, rate: float = 0.3, seed: int = 7, clean: bool = True, cache: dict[str, list[int]] | None = None) -> Model:
    """Fit on (words, language index) pairs. Deterministic for a given order of the samples."""
    rnd, k = np.random.default_rng(seed), len(languages)
    samples = _of_their_label(samples) if clean else samples
    epochs = max(1, epochs // 2) if clean else epochs
    cache = {} if cache is None else cache
    for words, _ in samples:
        for w in words:
            if w not in cache:
                cache[w] = subwords(w, buckets)
    held = [i for i in range(len(samples)) if i % 5 == 0]
    fit = [i for i in range(len(samples)) if i % 5]
    count = np.bincount([samples[i][1] for i in fit], minlength=k) + 1.0
    emb = rnd.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out, bias = rnd.normal(0, 0.1, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    cyrillic = {i: romanised(samples[i][0]) for i in fit if any("а" <= c <= "я" for c in samples[i][0][0])}
    for words in cyrillic.values():
        for w in words:
            if w not in cache:
                cache[w] = subwords(w, buckets)
    weight = (len(fit) / (k * count)).clip(0.2, 5.0)
    for epoch in range(epochs):
        order = rnd.permutation(fit)
        for lo in range(0, len(order), 32):
            part = order[lo : lo + 32]
            flat, sizes = [], []
            for i in part:
                words = cyrillic[i] if i in cyrillic and rnd.random() < 0.2 else samples[i][0]
                if len(words) > 4 and rnd.random() < 0.5:  # shorter passages, so that short sentences are judged as well
                    a = int(rnd.integers(0, len(words) - 3))
                    words = words[a : a + int(rnd.integers(3, 8))]
                ids = [g for w in words for g in cache[w]]
                flat += ids
                sizes.append(len(ids))
            flat, sizes = np.array(flat), np.array(sizes)
            starts = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(emb[flat], starts) / sizes[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = np.array([samples[i][1] for i in part])
            p[np.arange(len(part)), y] -= 1
            p *= weight[y][:, None]
            step = rate * (1 - (epoch + lo / len(order)) / epochs) + 0.01
            back = (p @ out.T) / sizes[:, None]
            out -= step * mean.T @ p / len(part) * 4
            bias -= step * p.mean(0)
            np.subtract.at(emb, flat, (step * 8 * np.repeat(back, sizes, 0)).astype(np.float32))
    model = Model(languages, (emb @ out).astype(np.float32), bias)
    known = {w: model.word(w) for w in {w for words, _ in samples for w in words}}
    sums = np.array([np.sum([known[w] for w in samples[i][0]], axis=0) for i in (range(len(samples)) if clean else held)])
    if clean:
        p = model.confidence(sums)
        agree = p.argmax(1) == np.array([y for _, y in samples])
        return train([s for s, ok in zip(samples, agree) if ok], languages, dim, buckets, 2 * epochs, rate, seed, clean=False, cache=cache)
    y = np.array([samples[i][1] for i in held])
    best = min((float(-np.log(np.maximum(Model(languages, model.scores, bias, t).confidence(sums)[np.arange(len(y)), y], 1e-9)).mean()), t) for t in (0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0)) if len(y) else (0, 1.0)
    model.temperature = best[1]
    p = model.confidence(sums) if len(y) else np.ones((1, k))
    wrong = np.sort(p.max(1)[p.argmax(1) != y]) if len(y) else np.array([])
    # Rejected is what is no surer than all but a thousandth of the held-out sentences' errors.
    allowed = len(y) // 1000
    model.reject = float(min(0.9, max(0.6, wrong[-1 - allowed] if len(wrong) > allowed else 0.0)))
    _learn_seen(model, samples, fit, held)
    return model


def _of_their_label(samples: Sequence[tuple[Sequence[str], int]]) -> list[tuple[Sequence[str], int]]:
    """The samples without those that stand apart: wrong labels, also those in a language that no label names, where nothing else would
    tell. A sentence's subwords are looked up among those of the other sentences with its label; twice, as the first time the strange
    ones support each other."""
    known: dict[str, set[int]] = {}
    for words, _ in samples:
        for w in words:
            if w not in known:
                known[w] = places(one_script(w))
    ids = [np.array([p for w in words for p in known[w]], np.int64) for words, _ in samples]
    kept = [i for i, x in enumerate(ids) if len(x)]
    for _ in range(2):
        out = []
        for y in sorted({samples[i][1] for i in kept}):
            own = [i for i in kept if samples[i][1] == y]
            counts = np.zeros(PLACES, np.float32)
            for i in own:
                counts[np.unique(ids[i])] += 1
            score = np.array([np.log((counts[ids[i]] - 1) / len(own) + 0.001).mean() for i in own])
            middle = np.median(score)
            spread = max(0.1, 1.4826 * float(np.median(np.abs(score - middle))))
            out += [i for i, v in zip(own, score) if v >= middle - APART * spread or len(own) < 10]
        kept = out
    return [samples[i] for i in sorted(kept)]


def _learn_seen(model: Model, samples: Sequence[tuple[Sequence[str], int]], fit: list[int], held: list[int]) -> None:
    """Which subwords each language has, and the share of them below which a sentence is in none of the languages."""
    k, known = len(model.languages), {}

    def at(words: Sequence[str]) -> list[int]:
        for w in words:
            if w not in known:
                known[w] = places(one_script(w))
        return [p for w in words for p in known[w]]

    counts = np.zeros((PLACES, k), np.int32)

    def add(which: list[int]) -> None:
        for i in which:
            words, y = samples[i]
            for form in [words, romanised(words)] if any("а" <= c <= "я" for c in words[0]) else [words]:
                counts[list(set(at(form))), y] += 1

    add(fit)
    seen = counts >= OFTEN_SEEN
    own, other = [], [[] for _ in range(k)]
    for i in held:
        words, y = samples[i]
        if len(words) >= SHORTEST and (ids := at(words)):
            share = seen[ids].mean(0)
            own.append(share[y])
            other[y].append(np.delete(share, y).max(initial=0.0))
    if own:
        known_from, unknown_to = float(np.quantile(own, REJECT_KNOWN)), max(float(np.quantile(x, REJECT_UNKNOWN)) for x in other if x)
        model.least_seen = min(known_from, (known_from + unknown_to) / 2)
    add(held)
    model.seen = ((counts >= OFTEN_SEEN).astype(np.uint32) << np.arange(k, dtype=np.uint32)).sum(1, dtype=np.uint32)


def judge(model: Model, cache: dict, texts: list[str | None]) -> list[list[tuple]]:
    """For each text its segments: ``(lang, confidence, char_from, char_to, n_sentences)``; ``n_sentences`` counts whole ones."""
    rows, index = cache.setdefault("rows", []), cache.setdefault("index", {})
    if len(index) > 1_000_000:
        rows.clear(), index.clear()
    flat: list[int] = []
    units: list[tuple[int, int, int, int, bool]] = []  # text, from, to, number of words, whole
    for t, text in enumerate(texts):
        if not text:
            continue
        for lo, hi in sentences(text):
            s = text[lo:hi]
            words = _words(_INSERTED.sub(" ", s))
            if not words and not (words := _words(s)):
                continue
            try:
                flat += [index[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in index:
                        index[w] = len(rows)
                        rows.append(model.word(w))
                flat += [index[w] for w in words]
            units.append((t, lo, hi, len(words), len(words) >= SHORTEST and bool(_END.search(s)) and not _NOT_PROSE.match(s)))
    out: list[list[tuple]] = [[] for _ in texts]
    if not units:
        return out
    if len(cache.get("matrix", ())) != len(rows):
        cache["matrix"] = np.array(rows, np.float32)
    sizes = np.array([u[3] for u in units])
    sums = np.add.reduceat(cache["matrix"][np.array(flat)], np.cumsum(sizes) - sizes)
    p, share = model.confidence(sums), model.share_seen(sums)
    own = np.array([u[0] for u in units])
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    together = np.add.reduceat(sums, first)
    whole_text, whole_share = model.confidence(together), model.share_seen(together)
    for k, lo in enumerate(first.tolist()):
        hi = first[k + 1] if k + 1 < len(first) else len(units)
        _segments(model, units[lo:hi], p[lo:hi], share[lo:hi], whole_text[k], whole_share[k], out[units[lo][0]])
    return out


def _segments(model: Model, units: list, p: np.ndarray, share: np.ndarray, total: np.ndarray, total_share: np.ndarray, out: list) -> None:
    top, sure, und = p.argmax(1), p.max(1), p.shape[1]
    known = share[np.arange(len(units)), top] >= model.least_seen
    # A sentence stands for itself when it is whole and sure, or whole and strange; others take the language of the text or of their neighbours.
    solid = [bool(u[4] and k and s >= model.reject) for u, k, s in zip(units, known, sure)]
    if any(solid):
        main = int(np.bincount(top[solid], weights=[u[3] for u, ok in zip(units, solid) if ok], minlength=und).argmax())
    else:
        main = int(total.argmax()) if total_share[total.argmax()] >= model.least_seen else und
    solid = [ok and (t == main or s >= MINOR) for ok, t, s in zip(solid, top, sure)]
    strange = [bool(u[4]) and not k for u, k in zip(units, known)]
    lang, here = [], next((int(t) for t, ok in zip(top, solid) if ok), main)
    for t, ok, odd in zip(top, solid, strange):
        here = int(t) if ok else here
        lang.append(und if odd else here)
    # The confidence that a sentence is in one of the languages falls with the share of its subwords that were seen there.
    trust = p * np.minimum(1.0, share / max(model.least_seen, 1e-9)) if model.least_seen else p
    trust = np.concatenate([trust, 1 - trust.max(1, keepdims=True)], 1)
    start = 0
    for i in range(1, len(units) + 1):
        if i == len(units) or lang[i] != lang[start]:
            part, y = range(start, i), lang[start]
            weights = np.array([units[j][3] for j in part], float)
            name = model.languages[y] if y < und else UNDETERMINED
            out.append((name, float((trust[start:i, y] * weights).sum() / weights.sum()), units[start][1], units[i - 1][2], sum(1 for j in part if (strange if y == und else solid)[j])))
            start = i


_SEGMENT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("char_from", T.IntegerType()), T.StructField("char_to", T.IntegerType()), T.StructField("n_sentences", T.IntegerType())])


def labelled_languages(docs: DataFrame, label: str) -> dict[str, int]:
    """The languages that enough documents are labelled with, as two- or three-letter codes, and how many are."""
    counts = docs.groupBy(label_code(F.col(label)).alias("l")).agg(F.count("*").alias("n")).where(F.col("l").rlike("^[a-z]{2,3}$"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(LEAST_DOCS, LEAST_SHARE * total)).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES).collect()
    return {r.l: r.n for r in rows}


def fit_model(docs: DataFrame, doc_id: str, text: str, label: str, languages: Sequence[str] | None = None, sample_docs: int = 2000, sample_sentences: int = 9000) -> Model:
    """Train on about ``sample_docs`` labelled rows and ``sample_sentences`` of their sentences: of every language the same number of
    rows, as far as it has them, those with the least hashes of their ids.

    The languages are those of the labels, or of them those given. Rows without usable label or text are left out. A table without any
    gives a model that knows nothing and rejects everything. A session trains once on the same sample.
    """
    held = {k: n for k, n in labelled_languages(docs, label).items() if languages is None or k in languages}
    names = tuple(sorted(held))
    nothing = Model(names or ("und",), np.zeros((2, max(1, len(names))), np.float32), np.zeros(max(1, len(names)), np.float32), 1.0, 1.0, None, 1.0)
    if not names:
        return nothing
    quota, rest = {}, sample_docs
    for i, k in enumerate(sorted(names, key=lambda k: held[k])):
        quota[k] = min(held[k], max(1, rest // (len(names) - i)))
        rest -= quota[k]
    code = label_code(F.col(label))
    share = F.create_map(*[F.lit(x) for k in names for x in (k, int(1_000_000 * min(1.0, 1.5 * quota[k] / held[k])))])
    drawn = (
        docs.select(F.xxhash64(doc_id).alias("h"), F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t"), code.alias("l"))
        .where(F.col("l").isin(*names) & (F.pmod("h", F.lit(1_000_000)) < F.try_element_at(share, F.col("l"))) & (F.length("t") >= 40))
        .collect()
    )
    drawn.sort(key=lambda r: (r.h % 1_000_000, r.h, r.i, r.t))
    samples: list[tuple[list[str], int]] = []
    for y, k in enumerate(names):
        own = [words for r in [r for r in drawn if r.l == k][: quota[k]] for lo, hi in sentences(r.t) if len(words := _words(r.t[lo:hi])) >= 3]
        step = max(1.0, len(own) * len(names) / sample_sentences)
        samples += [(words, y) for i, words in enumerate(own) if int(i / step) != int((i - 1) / step)]
    if not samples:
        return nothing
    samples.sort(key=lambda s: zlib.crc32(" ".join(s[0]).encode()))
    key = hashlib.sha256(repr((names, samples)).encode()).hexdigest()
    if key not in _TRAINED:
        if len(_TRAINED) >= 4:
            _TRAINED.pop(next(iter(_TRAINED)))
        _TRAINED[key] = train(samples, names)
    return _TRAINED[key]


#: The models of the last samples.
_TRAINED: dict[str, Model] = {}


def _labeller(held: Broadcast):
    @F.pandas_udf(T.ArrayType(_SEGMENT))
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for s in batches:
            found = []
            for lo in range(0, len(s), 500):
                found += judge(held.value, cache, s.iloc[lo : lo + 500].tolist())
            yield pd.Series(found, dtype=object)

    return label


def language_segments(docs: DataFrame, keep: Sequence[str], text: str, model: Model) -> DataFrame:
    """``keep`` columns and ``segments``: array of ``lang, confidence, char_from, char_to, n_sentences`` in order of the text.

    ``n_sentences`` counts the whole sentences in which the language is sure; 0 where the text has words but no such sentence, and
    the language is the likeliest. ``lang`` is "und" for whole sentences, or a text, in none of the model's languages: ``n_sentences``
    then counts the rejected ones. Words in a sentence of another language make no segment of their own. A null or empty text, or one
    without words, has no segments. Rows are judged one by one, so repeated rows repeat and an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*[F.col(c) for c in keep], _labeller(held)(F.col(text)).alias("segments"))


def _languages(segments: Column) -> Column:
    """Languages with at least one whole sentence; the likeliest where there is none, and "und" where none is likely."""
    whole = F.filter(segments, lambda s: (s["n_sentences"] > 0) & (s["lang"] != UNDETERMINED))
    best = F.slice(F.array_sort(segments, lambda a, b: F.when(a["char_to"] - a["char_from"] > b["char_to"] - b["char_from"], -1).otherwise(1)), 1, 1)
    return F.array_sort(F.array_distinct(F.transform(F.when(F.size(whole) > 0, whole).otherwise(best), lambda s: s["lang"])))


def _judged(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    model = fit_model(docs, "doc_id", "text", "lang")
    return language_segments(docs, ["doc_id", "lang"], "text", model)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    seen = _judged(spark, root).where(F.size("segments") > 0).select("doc_id", label_code(F.col("lang")).alias("l"), _languages(F.col("segments")).alias("ls"))
    wrong = F.col("l").isNull() | (F.size("ls") > 1) | ~F.array_contains("ls", F.col("l"))
    # A text in none of the languages has no code to be reported with.
    return seen.where(wrong).select("doc_id", F.explode("ls").alias("lang_found")).where(F.col("lang_found") != UNDETERMINED).distinct()


def p8_segments(spark: SparkSession, root: str) -> DataFrame:
    """Each segment of each document with its language and confidence."""
    return _judged(spark, root).select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.*")


def p8_documents(spark: SparkSession, root: str) -> DataFrame:
    """Each document's language: the one of most of its characters, with the share-weighted confidence; null without words."""
    seg = F.col("segments")
    size = lambda s: (s["char_to"] - s["char_from"]).cast("double")
    by = F.transform(_languages(seg), lambda lang: F.struct(F.aggregate(F.filter(seg, lambda s: s["lang"] == lang), F.lit(0.0), lambda a, s: a + size(s)).alias("n"), lang.alias("lang"), F.aggregate(F.filter(seg, lambda s: s["lang"] == lang), F.lit(0.0), lambda a, s: a + size(s) * s["confidence"]).alias("c")))
    top = F.when(F.size(seg) > 0, F.array_max(by))
    return _judged(spark, root).select("doc_id", label_code(F.col("lang")).alias("label"), top["lang"].alias("lang_found"), F.round(top["c"] / top["n"], 4).alias("confidence"), F.size(_languages(seg)).alias("n_languages"))


QUERIES = {"p8_found": p8_found, "p8_segments": p8_segments, "p8_documents": p8_documents}
ORACLE: dict[str, str] = {}
