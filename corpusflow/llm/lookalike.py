"""One consistent form for text that looks the same (problem 5).

Compatibility normalisation and the deletion of what does not show come first. Then every word is a lattice: each letter may be any
of its look-alikes, one for each script. Viterbi's algorithm picks the path that is best under the scripts' letter bigrams, with a
price for every change of script inside a word and a small gain for the script of the text around it. The lattice depends on how
the word looks only, so whatever looks the same comes out the same. The bigrams are counted over all the text there is.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.glyphs import HYPHENS, IN_SCRIPT, PROTOTYPE, hidden_class, script
from corpusflow.session import table

SCRIPTS = "LCG"
#: The price of a change of script in a word, the gain of each letter in the text's own script, and the weight of
#: single letters beside the pairs seen, and the score of a letter never seen.
SWITCH, OWN, ADD, UNSEEN = 14.0, 3.0, 5.0, -14.0
_WORD = re.compile(r"[^\W\d_][^\W\d_̀-ͯ]*(?:[̀-ͯ]+[^\W\d_]*)*")
_SPACE = re.compile(r"[^\S\n\r\t ]")
_HIDDEN = re.compile(hidden_class())
#: Look-alikes that the normalisation would turn into other letters.
_KEPT = {ord(c): PROTOTYPE[c] for c in PROTOTYPE if unicodedata.normalize("NFKC", c) != c}
_ODD = re.compile("[" + "".join(map(chr, _KEPT)) + "]")
Bigrams = dict[tuple[str, str, str], float]


def clean(text: str) -> str:
    """Compatibility normalisation, no invisible characters, one kind of space and hyphen; letters are decomposed from their marks."""
    if text.isascii():
        return text
    t = unicodedata.normalize("NFKC", text.translate(_KEPT) if _ODD.search(text) else text)
    t = _HIDDEN.sub("", t)
    for h in HYPHENS[:2]:
        t = t.replace(h, "-")
    return unicodedata.normalize("NFD", _SPACE.sub(" ", t))


@lru_cache(maxsize=200_000)
def _anchors(word: str) -> frozenset[str]:
    """The scripts of the letters that no other script has."""
    return frozenset(script(c) for c in word if c not in IN_SCRIPT) - {""}


def _pair(bigrams: Bigrams, s: str, a: str, b: str) -> float:
    """Log probability of letter ``b`` after ``a``; that of the letter alone, at a discount, for a pair never seen."""
    return bigrams[s, a, b] if (s, a, b) in bigrams else bigrams.get((s, a, ""), 0.0) + bigrams.get((s, "", b), UNSEEN)


def bigram_scores(pairs: dict[tuple[str, str, str], int]) -> Bigrams:
    after, single, total = Counter(), Counter(), Counter()
    for (s, a, b), n in pairs.items():
        after[s, a] += n
        single[s, b] += n
        total[s] += n
    one = {(s, "", b): math.log(n / total[s]) for (s, b), n in single.items()}
    rest = {(s, a, ""): math.log(ADD / (n + ADD)) for (s, a), n in after.items()}
    return one | rest | {(s, a, b): math.log((n + ADD * math.exp(one[s, "", b])) / (after[s, a] + ADD)) for (s, a, b), n in pairs.items()}


def resolve(word: str, own: str, bigrams: Bigrams) -> str:
    """The best path through the lattice of a decomposed word."""
    scripts = {script(c) for c in word} - {""}
    anchors = _anchors(word)
    if len(scripts) == 1 and anchors:  # the path without a change of script
        (s,) = scripts
        return "".join(IN_SCRIPT[c].get(s, c) if c in IN_SCRIPT else c for c in word)
    paths = {s: (0.0, "", "^") for s in SCRIPTS}
    for c in word:
        options = IN_SCRIPT.get(c) or ({script(c): c} if script(c) else None)
        if options is None:
            paths = {s: (v, out + c, last) for s, (v, out, last) in paths.items()}
            continue
        after = {}
        for s in SCRIPTS:
            if s in options:
                x = options[s]
                best = max(((v + (0.0 if t == s else -SWITCH), t) for t, (v, _, _) in paths.items()), key=lambda p: (p[0], -SCRIPTS.index(p[1])))
                v, out, last = paths[best[1]]
                after[s] = (best[0] + OWN * (s == own) + _pair(bigrams, s, last if best[1] == s else "^", x), out + x, x)
        paths = after
    s = max(paths, key=lambda k: (round(paths[k][0] + _pair(bigrams, k, paths[k][2], "$"), 9), -SCRIPTS.index(k)))
    return paths[s][1]


def own_script(text: str) -> str:
    """The script that most of the words with a distinctive letter have."""
    return _own(Counter(_WORD.findall(clean(text))))


def _own(words: Counter) -> str:
    n: Counter = Counter()
    for w, k in words.items():
        a = _anchors(w)
        if len(a) == 1:
            n[next(iter(a))] += k
    return max(n, key=lambda s: (n[s], -SCRIPTS.index(s))) if n else ""


class Canonical:
    """The consistent form of texts; distinct words are resolved once."""

    def __init__(self, bigrams: Bigrams):
        self.bigrams, self.known = bigrams, {}

    def word(self, w: str, own: str) -> str:
        key = (w, own)
        if key not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[key] = resolve(w, own, self.bigrams)
        return self.known[key]

    def form(self, text: str, own: str) -> str:
        t = clean(text)
        return self._form(t, own, _WORD.findall(t))

    def own_and_form(self, text: str) -> tuple[str, str]:
        t = clean(text)
        words = Counter(_WORD.findall(t))
        own = _own(words)
        return own, self._form(t, own, words)

    def _form(self, cleaned: str, own: str, words: Iterable[str]) -> str:
        # Most texts hold no word that takes another form.
        if any(self.word(w, own) != w for w in words):
            cleaned = _WORD.sub(lambda m: self.word(m[0], own), cleaned)
        return unicodedata.normalize("NFC", cleaned)


def letter_pairs(texts: Sequence[str | None]) -> Counter:
    """Pairs of neighbouring letters, with ends, of the words written in one script."""
    words: Counter = Counter()
    for t in texts:
        if t:
            words.update(_WORD.findall(clean(t)))
    out: Counter = Counter()
    for w, n in words.items():
        letters = [c for c in w if script(c)]
        found = {script(c) for c in letters}
        if len(found) == 1 and _anchors(w):
            (s,) = found
            for a, b in zip(["^", *letters], [*letters, "$"]):
                out[s, a, b] += n
    return out


def fit_bigrams(texts: DataFrame, text: str) -> Bigrams:
    """Log probabilities of the letter pairs of all words of ``texts``; as many entries as letters of three scripts pair up."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            total.update(letter_pairs(b["t"].tolist()))
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["s", "a", "b", "n"])

    pairs = texts.select(F.col(text).alias("t")).mapInPandas(count, "s string, a string, b string, n long").groupBy("s", "a", "b").agg(F.sum("n").alias("n"))
    return bigram_scores({(r.s, r.a, r.b): r.n for r in pairs.collect()})  # letters are few hundred for each script


_BOTH = T.StructType([T.StructField("own", T.StringType()), T.StructField("form", T.StringType())])


def _own_and_form(held: Broadcast) -> object:
    @F.pandas_udf(_BOTH)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = Canonical(held.value)
        for s in batches:
            yield pd.DataFrame([(None, None) if t is None else c.own_and_form(t) for t in s], columns=_BOTH.names)

    return both


def _form(held: Broadcast) -> object:
    @F.pandas_udf(T.StringType())
    def form(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        c = Canonical(held.value)
        for texts, owns in batches:
            yield pd.Series([None if t is None else c.form(t, o or "") for t, o in zip(texts, owns)], dtype=object)

    return form


def canonical_texts(df: DataFrame, keep: Sequence[str], text: str, bigrams: Bigrams, own: str | None = None) -> DataFrame:
    """``keep`` columns, ``own`` (the script of most words) and ``form`` (the consistent form of ``text``).

    Two texts that look alike have one form where their ``own`` agrees; give the column ``own`` to compare parts with a whole. A null
    text has a null form, an empty one an empty form. Rows are treated one by one: repeated rows repeat, no rows give none.
    """
    held = df.sparkSession.sparkContext.broadcast(bigrams)
    if own:
        rows = df.select(F.struct(*keep).alias("k"), F.struct(F.col(own).alias("own"), _form(held)(F.col(text), F.col(own)).alias("form")).alias("x"))
    else:
        rows = df.select(F.struct(*keep).alias("k"), _own_and_form(held)(F.col(text)).alias("x"))
    return rows.select(*[F.col("k").getField(k).alias(k) for k in keep], F.col("x.own").alias("own"), F.col("x.form").alias("form"))


_FOUND = T.ArrayType(T.StructType([T.StructField("form", T.StringType()), T.StructField("found", T.BooleanType())]))


def _search(held: Broadcast) -> object:
    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        c = Canonical(held.value)
        for texts, lists in batches:
            out = []
            for text, quotes in zip(texts, lists):
                asked = [] if quotes is None else list(quotes)
                own, form = c.own_and_form(text) if text is not None else ("", None)
                forms = [None if q is None else c.form(q, own) for q in asked]
                out.append([(f, None if f is None else form is not None and f in form) for f in forms])
            yield pd.Series(out, dtype=object)

    return search


def find_quotes(quotes: DataFrame, key: str, quote: str, units: DataFrame, text: str, on: Sequence[str], bigrams: Bigrams, every_form: bool = True, block: int = 200) -> DataFrame:
    """``key, quote, quote_form, exact, found`` of every quote, for each text of its unit: whether it stands there as it is, and whether
    it does in the consistent form of both.

    The quotes of a unit meet its text together, ``block`` of them at a time, so a text travels once for so many quotes and a unit with
    any number of them is spread over as many tasks. A quote that stands there as it is goes through the lattice only for ``every_form``;
    else its ``quote_form`` is null. A unit without text holds nothing, repeated quotes of a key are one, a null quote gives no row.
    """
    held = quotes.sparkSession.sparkContext.broadcast(bigrams)
    asked = quotes.where(F.col(quote).isNotNull()).select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(on)], F.col(key).alias("_k"), F.col(quote).alias("_t"))
    ids = [f"_q{i}" for i in range(len(on))]
    # Units with more than one block are few, whatever the number of quotes.
    many = asked.groupBy(*ids).agg(F.count("*").alias("_n")).where(F.col("_n") > block).withColumnsRenamed({c: f"{c}m" for c in ids})
    blocked = asked.join(many, _all([F.col(c).eqNullSafe(F.col(f"{c}m")) for c in ids]), "left").withColumn("_b", F.pmod(F.xxhash64("_k", "_t"), F.ceil(F.coalesce("_n", F.lit(1)) / block)))
    lists = blocked.groupBy(*ids, "_b").agg(F.collect_set(F.struct("_k", "_t")).alias("_qs"))
    texts = units.where(F.col(text).isNotNull()).select(*[F.col(c).alias(f"_u{i}") for i, c in enumerate(on)], F.col(text).alias("_text"))
    met = lists.join(texts, _all([F.col(f"_q{i}") == F.col(f"_u{i}") for i in range(len(on))]), "left")
    seen = met.select("_text", F.transform("_qs", lambda q: F.struct(q["_k"].alias("k"), q["_t"].alias("t"), F.coalesce(F.contains("_text", q["_t"]), F.lit(False)).alias("exact"))).alias("_qs"))
    to_form = F.transform("_qs", lambda q: q["t"] if every_form else F.when(~q["exact"], q["t"]))
    needs = F.exists(to_form, lambda t: t.isNotNull())
    done = seen.select("_qs", _search(held)(F.when(needs, F.col("_text")), to_form).alias("_r"))
    each = done.select(F.explode(F.zip_with("_qs", "_r", lambda q, r: F.struct(q["k"].alias("k"), q["t"].alias("t"), q["exact"].alias("exact"), r["form"].alias("form"), r["found"].alias("found")))).alias("x"))
    return each.select(F.col("x.k").alias(key), F.col("x.t").alias(quote), F.col("x.form").alias("quote_form"), F.col("x.exact").alias("exact"), (F.col("x.exact") | F.coalesce("x.found", F.lit(False))).alias("found"))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def quotes_in_units(spark: SparkSession, root: str, every_form: bool = True) -> DataFrame:
    """Findings with their quote's form: ``finding_key, quote, quote_form, exact, found``. A finding whose unit has no content is not
    found; one without quote falls out."""
    chapters = table(spark, root, "chapters").select("book_slug", "unit_id", "content")
    findings = table(spark, root, "findings").select("finding_key", "book_slug", "unit_id", F.col("source_anchor.quote").alias("quote"))
    return find_quotes(findings, "finding_key", "quote", chapters, "content", ["book_slug", "unit_id"], fit_bigrams(chapters, "content"), every_form)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    seen = quotes_in_units(spark, root, every_form=False)
    by = seen.groupBy("finding_key").agg(F.max("exact").alias("exact"), F.max("found").alias("found"))
    return by.where("found AND NOT exact").select("finding_key")


def p5_quotes(spark: SparkSession, root: str) -> DataFrame:
    """Every finding's quote in the consistent form, and whether it is found in its unit, as it stands or in that form."""
    return quotes_in_units(spark, root).distinct()


def p5_contents(spark: SparkSession, root: str) -> DataFrame:
    """Every chapter's content in the consistent form."""
    chapters = table(spark, root, "chapters").select("chapter_id", "content")
    forms = canonical_texts(chapters, ["chapter_id"], "content", fit_bigrams(chapters, "content"))
    return forms.select("chapter_id", "own", F.col("form").alias("content_form")).dropDuplicates(["chapter_id"])


QUERIES = {"p5_found": p5_found, "p5_quotes": p5_quotes, "p5_contents": p5_contents}
ORACLE: dict[str, str] = {}
