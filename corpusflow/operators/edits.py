"""Edits of texts and checks around them: patches, link masks, fuzzy places, lines, selectors, answers in JSON, token audits."""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import text as X

_LINK = re.compile(X.LINK)


def apply_patches(text: Column, patches: Column) -> Column:
    """``text`` with patches (array of ``quote, occurrence, replacement``) applied; null where one has no place or two overlap.

    Places are those of the text as it was, so the order of the patches does not matter.
    """
    placed = F.transform(patches, lambda p: F.struct(X.nth_offset(text, p["quote"], p["occurrence"]).alias("lo"), F.length(p["quote"]).alias("n"), p["replacement"].alias("r")))
    rising = F.array_sort(placed)
    step = lambda a, p: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, p["lo"] - a["at"]), p["r"]).alias("out"), (p["lo"] + p["n"]).alias("at"), (a["ok"] & p["lo"].isNotNull() & (p["lo"] >= a["at"])).alias("ok"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(True).alias("ok"))
    return F.aggregate(rising, start, step, lambda a: F.when(a["ok"], F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))


def _place(text: Column, quote: Column, n: Column) -> Column:
    """Offset of the ``n``-th (from 0) occurrence, counted without overlaps also where a quote overlaps itself; null where there is none."""
    literal = F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.slice(F.split(text, literal), 1, (n + 1).cast("int"))
    later = F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x)) + (n * F.length(quote)).cast("int")
    return F.when((n > 0) & (X.occurrences(text, quote) > n), later).otherwise(F.when(n == 0, X.nth_offset(text, quote, n)))


def replace_places(text: Column, quotes: Column, replacement: Column) -> Column:
    """``text, n_placed``: every place of ``quotes`` (array of ``quote, occurrence``) replaced; those that have no place count for nothing.

    Places are those of the text as it was. Places that overlap are one stretch and get one replacement; places that touch stay two.
    """
    placed = F.transform(quotes, lambda p: F.struct(_place(text, p["quote"], p["occurrence"]).alias("lo"), F.length(p["quote"]).alias("n")))
    rising = F.array_sort(F.filter(placed, lambda p: p["lo"].isNotNull()))
    apart = lambda a, p: F.concat(a["out"], F.substring(text, a["at"] + 1, p["lo"] - a["at"]), replacement)
    step = lambda a, p: F.struct(F.when(p["lo"] >= a["at"], apart(a, p)).otherwise(a["out"]).alias("out"), F.greatest(a["at"], p["lo"] + p["n"]).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(rising, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.struct(done.alias("text"), F.size(rising).alias("n_placed"))


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (from 1) of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def replace_expected(text: Column, old: Column, new: Column, count: Column) -> Column:
    """``text`` with every ``old`` replaced, where there are exactly ``count``; else null."""
    return F.when(X.occurrences(text, old) == count, F.replace(text, old, new))


def excerpt(text: Column, at: Column, length: Column, around: int = 650) -> Column:
    """What stands at a place, with some characters on both sides."""
    lo = F.greatest(F.lit(0), at - around)
    return F.substring(text, lo + 1, F.least(F.length(text), at + length + around) - lo)


_MASK = T.StructType([T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))])


def mask(text: str) -> tuple[str, list[str]]:
    """Link targets replaced by numbered tokens around the label, and the targets."""
    kept: list[str] = []

    def one(m: re.Match) -> str:
        kept.append(m[0][m.end(2) - m.start(0) :])
        return f"⟦{len(kept)}{'!' if m[1] else ''}⟧{m[2]}⟦/{len(kept)}⟧"

    return _LINK.sub(one, text), kept


def unmask(text: str, links: Sequence[str]) -> str | None:
    """The text with its links again; None where the tokens are not the expected ones in their order."""
    found = re.findall(r"⟦(\d+)!?⟧[^⟦⟧]*⟦/(\d+)⟧", text)
    if [a for a, _ in found] != [str(i + 1) for i in range(len(links))] or any(a != b for a, b in found):
        return None
    out = re.sub(r"⟦(\d+)(!?)⟧([^⟦⟧]*)⟦/\d+⟧", lambda m: f"{m[2]}[{m[3]}{links[int(m[1]) - 1]}", text)
    return None if "⟦" in out or "⟧" in out else out


def mask_like(source: str, translation: str) -> str:
    """A translation with the tokens of its source's links around its own labels, where both have as many links; else as it is."""
    n = len(mask(source)[1])
    return mask(translation)[0] if n and len(mask(translation)[1]) == n else translation


@F.pandas_udf(T.StringType())
def masked_like(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for sources, texts in batches:
        yield pd.Series([None if s is None or t is None else mask_like(s, t) for s, t in zip(sources, texts)], dtype=object)


@F.pandas_udf(_MASK)
def masked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([(None, None) if t is None else mask(t) for t in s], columns=_MASK.names)


@F.pandas_udf(T.StringType())
def unmasked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, links in batches:
        yield pd.Series([None if t is None or k is None else unmask(t, list(k)) for t, k in zip(texts, links)], dtype=object)


_NEAR = T.ArrayType(T.StructType([T.StructField("line", T.StringType()), T.StructField("ratio", T.DoubleType())]))


def near_lines(text: str, quote: str, most: int = 3, least: float = 0.6) -> list[tuple[str, float]]:
    """The lines of a text that resemble a quote most, by matching blocks."""
    lines = list(dict.fromkeys(x.strip() for x in text.splitlines() if x.strip()))
    match, scored = difflib.SequenceMatcher(autojunk=False), []
    match.set_seq2(quote)
    for x in lines:
        match.set_seq1(x)
        if match.real_quick_ratio() >= least and match.quick_ratio() >= least and (r := match.ratio()) >= least:
            scored.append((-r, x))
    return [(x, -r) for r, x in sorted(scored)[:most]]


@F.pandas_udf(_NEAR)
def suggestions(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, quotes in batches:
        yield pd.Series([None if t is None or not q else near_lines(t, q) for t, q in zip(texts, quotes)], dtype=object)


@F.pandas_udf(T.BooleanType())
def related_titles(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether two titles begin alike for 18 characters and agree by four fifths of their matching blocks."""

    def related(a: str | None, b: str | None) -> bool | None:
        if a is None or b is None:
            return None
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return same >= 18 and difflib.SequenceMatcher(a=a, b=b, autojunk=False).ratio() >= 0.8

    for left, right in batches:
        yield pd.Series([related(a, b) for a, b in zip(left, right)], dtype=object)


def selected_units(selector: Column) -> Column:
    """Unit ids of a selector ``N`` or ``N-M``; null for anything else."""
    low = F.regexp_extract(selector, r"^\s*(\d{1,6})(?:\s*-\s*\d{1,6})?\s*$", 1)
    high = F.regexp_extract(selector, r"-\s*(\d{1,6})\s*$", 1)
    a = F.when(low != "", low.cast("int"))
    b = F.when(high != "", high.cast("int")).otherwise(a)
    return F.when((a >= 1) & (b >= a), F.transform(F.sequence(a, F.greatest(a, b)), X.unit_id))


def parsed_batch(answer: Column, expected: Column) -> Column:
    """Answers by id out of a JSON object ``{"segments": [{"id", "translation"}]}``, fenced or not; null unless the ids are the expected
    ones, each once, and no answer is blank."""
    bare = F.regexp_replace(answer, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    rows = F.from_json(bare, "segments array<struct<id string, translation string>>")["segments"]
    good = (F.array_sort(F.transform(rows, lambda r: r["id"])) == F.array_sort(expected)) & F.forall(rows, lambda r: F.coalesce(r["translation"].rlike(r"(?U)\S"), F.lit(False)))
    return F.when(F.coalesce(good, F.lit(False)), F.map_from_entries(F.transform(rows, lambda r: F.struct(r["id"], r["translation"]))))


def parsed_verdicts(answer: Column, expected: Column) -> Column:
    """Verdicts by finding out of a JSON object ``{"decisions": [{"finding_id", "verdict", "risk"}]}``; null unless every expected finding has
    one, each once, and an approval has the risk "none" and a rejection another."""
    rows = F.from_json(answer, "decisions array<struct<finding_id string, verdict string, risk string>>")["decisions"]
    same = F.array_sort(F.transform(rows, lambda r: r["finding_id"])) == F.array_sort(expected)
    sound = F.forall(rows, lambda r: r["verdict"].isin("approve", "reject") & ((r["verdict"] == "approve") == (r["risk"] == "none")))
    return F.when(F.coalesce(same & sound, F.lit(False)), F.map_from_entries(F.transform(rows, lambda r: F.struct(r["finding_id"], r["verdict"]))))


def plain_prose(markdown: Column) -> Column:
    """Markdown without its marks: headings, list items, links, anchors and emphasis; escaped marks stay as characters."""
    t = F.regexp_replace(markdown, r"(?m)^[ \t]*#{1,6}[ \t]+", "")
    t = F.replace(t, F.lit("<!-- bt-scene-break -->"), F.lit("  "))
    t = F.regexp_replace(t, r"(?m)^[ \t]*-[ \t]+", "")
    t = F.regexp_replace(t, X.LINK, "$2")
    t = F.regexp_replace(t, r"(?m)^<!-- bt-(?:anchor|block):[A-Za-z0-9_.:-]* -->\s*\n?", "")
    marks = "*`[]\\"
    for i, c in enumerate(marks):
        t = F.replace(t, F.lit("\\" + c), F.lit(chr(0xE000 + i)))
    return F.translate(F.translate(t, "*`", ""), "".join(chr(0xE000 + i) for i in range(len(marks))), marks)


def token_audit(df: DataFrame, keys: Sequence[str], expected: str, actual: str) -> DataFrame:
    """``keys, n_expected, n_actual, mismatch``: the first token in which two texts differ, from 1; null where they agree."""
    seen = df.select(*keys, X.tokens(F.col(expected)).alias("_e"), X.tokens(F.col(actual)).alias("_a"))
    return seen.select(*keys, F.size("_e").alias("n_expected"), F.size("_a").alias("n_actual"), X.mismatch_index(F.col("_e"), F.col("_a")).alias("mismatch"))


def in_ranges(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, low: str, high: str, width: int = 4096) -> DataFrame:
    """Points joined with the half-open ranges of their key that hold them: an equi-join on buckets of ``width``, then the exact test."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.greatest(F.col(high), F.col(low) + 1) - 1) / width))))
    return p.join(r, [*keys, "_b"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def merged_parts(parts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value, n_values``: one value for each key; null, and how many there are, where the parts disagree."""
    return parts.groupBy(*keys).agg(F.countDistinct(value).alias("n_values"), F.min(value).alias("_v")).select(*keys, F.when(F.col("n_values") == 1, F.col("_v")).alias(value), "n_values")


def global_occurrence(text: Column, quote: Column, low: Column, high: Column) -> Column:
    """Which occurrence in the whole text a quote is that stands once in its block ``[low, high)``, from 0; null where it does not stand
    there exactly once, or stands at no place of the count without overlaps from the beginning."""
    block = F.substring(text, low + 1, high - low)
    at = low + F.length(F.call_function("substring_index", block, quote, F.lit(1)))
    n = X.occurrences(F.substring(text, F.lit(1), at), quote)
    return F.when((X.occurrences(block, quote) == 1) & (X.nth_offset(text, quote, n) == at), n)


@F.pandas_udf(T.StringType())
def unified_diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The difference of two texts in the unified form, with three lines around each change; empty for equal texts, null for null."""
    for old, new in batches:
        yield pd.Series([None if a is None or b is None else "\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), "before", "after", lineterm="")) for a, b in zip(old, new)], dtype=object)


_PIECE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
_BREAKS = re.compile(r"(?P<paragraph>\s*\n[ \t]*\n\s*)|(?P<sentence>(?<=[.!?…])\s+)|(?P<word>\s+)")


def bounded_spans(text: str, limit: int) -> list[tuple[str, str]]:
    """A text in spans of at most ``limit`` characters and the white space between them, which together are the text.

    From where a span begins, it ends at the last end of a paragraph within the limit; without one at the last end of a sentence in the
    second half of it; else at the last white space. ValueError where a word is longer than a span.
    """
    lead, tail = len(text) - len(text.lstrip()), len(text.rstrip())
    places = {k: [] for k in ("paragraph", "sentence", "word")}
    for m in _BREAKS.finditer(text, lead, max(lead, tail)):
        for k in ("word", "sentence", "paragraph"):  # a stronger break is every weaker one as well
            places[k].append(m.span())
            if k == m.lastgroup:
                break
    out, at = [("literal", text[:lead])], lead
    while tail - at > limit:
        for k, least in (("paragraph", 1), ("sentence", limit // 2), ("word", 1)):
            n = bisect.bisect_right(places[k], at + limit, key=lambda p: p[0])
            if n and places[k][n - 1][0] >= at + least:
                start, end = places[k][n - 1]
                break
        else:
            raise ValueError("a word is longer than a span")
        out += [("text", text[at:start]), ("literal", text[start:end])]
        at = end
    out += [("text", text[at:tail]), ("literal", text[max(at, tail) :])]
    return [x for x in out if x[1]]


def spans_within(text: Column, limit: int = 1600) -> Column:
    """``bounded_spans`` of every text; null for null and where a word is longer than a span."""

    @F.pandas_udf(_PIECE)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> list[tuple[str, str]] | None:
            try:
                return None if t is None else bounded_spans(t, limit)
            except ValueError:
                return None

        for s in batches:
            yield pd.Series([one(t) for t in s], dtype=object)

    return cut(text)
