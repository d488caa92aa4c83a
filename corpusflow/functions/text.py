"""Column functions on text that every part of the library shares."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space in the Unicode sense, for the JVM's regular expressions.
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"


@F.pandas_udf(T.StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(c: Column) -> Column:
    """Canonical composition. ASCII values never leave the JVM."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, c).otherwise(_composed(F.when(~plain, c)))


def squeeze_space(c: Column) -> Column:
    """Runs of any white space become one space; none at either end."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def fold_case(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: A letter, digit or underscore of any script, for regular expressions of the JVM and of RE2 alike.
WORD_CHAR = r"[\p{L}\p{N}_]"


def tokens(c: Column) -> Column:
    """Words and single punctuation marks, in canonical composition."""
    return F.regexp_extract_all(nfc(c), F.lit(rf"{WORD_CHAR}+|[^\p{{L}}\p{{N}}_\s]"), F.lit(0))


def words(c: Column) -> Column:
    """Folded words, with apostrophes and hyphens inside them."""
    return F.regexp_extract_all(fold_case(c), F.lit(r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"), F.lit(0))


def numbers(c: Column) -> Column:
    """Numbers that stand by themselves, with their separators."""
    return F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])\p{Nd}+(?:[.,]\p{Nd}+)*(?![\p{L}\p{N}_])"), F.lit(0))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, not overlapping; 0 for an empty part."""
    return F.when(F.length(part) == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def nth_offset(text: Column, part: Column, n: Column) -> Column:
    """Offset of the ``n``-th (from 0) not overlapping occurrence; null where there is none."""
    before = F.call_function("substring_index", text, part, (n + 1).cast("int"))
    return F.when((F.length(part) > 0) & (occurrences(text, part) > n), F.length(before))


def paragraphs(c: Column) -> Column:
    return F.split(c, r"\n[ \t]*\n")


def paragraph_count(c: Column) -> Column:
    """Paragraphs that hold more than white space."""
    return F.size(F.filter(F.split(c, r"\n\s*\n"), lambda p: p.rlike(r"(?U)\S")))


def line_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda p: p.rlike(r"(?U)\S")))


#: Lines that mark a scene break, and headings.
SCENE_BREAK, HEADING = r"(?m)^[ \t]*(?:\* ?\* ?\*|- ?- ?-|_{3,})[ \t]*$", r"(?m)^#{1,6}[ \t]+\S"
#: Links and images, and the markers that a unit's text carries.
LINK = r"(!?)\[([^\]\n]*)\]\((<[^>\n]+>|[^)\s]+)([ \t]+[^)\n]*)?\)"
MARKER = r"<!--\s*bt-(?:anchor|block|inline|media):[^>]*-->"


def slugify(c: Column, default: str = "book") -> Column:
    """Lower case, punctuation dropped, white space and underscores as single hyphens."""
    s = F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_\s\p{Z}-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s\p{Z}_]+", "-"), "-{2,}", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


def stable_slug(c: Column, limit: int = 120) -> Column:
    return F.regexp_replace(F.substring(slugify(c), 1, limit), "-+$", "")


def mismatch_index(expected: Column, actual: Column) -> Column:
    """1-based place of the first difference of two arrays; null where they are equal."""
    common = F.least(F.size(expected), F.size(actual))
    differs = F.array_position(F.zip_with(F.slice(expected, 1, common), F.slice(actual, 1, common), lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differs > 0, differs).when(F.size(expected) != F.size(actual), (common + 1).cast("long"))


def unit_id(number: Column) -> Column:
    return F.format_string("chapter-%06d", number)


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns as one JSON object with its keys sorted and nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def canonical(**fields: Column) -> Column:
    """The fields as one JSON object, keys sorted, nulls kept, without spaces, and a line feed."""
    return F.concat(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), F.lit("\n"))


def drifted(before: Column, after: Column) -> Column:
    """The keys of two maps under which they differ, sorted."""
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k))))


def unit_or_number(unit: Column, number: Column) -> Column:
    """The name that a unit has, else the one its number gives."""
    return F.coalesce(unit, unit_id(number))


def parse_utc(c: Column) -> Column:
    """ISO-8601 time with a zone as a timestamp; null for anything else."""
    shaped = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$")
    return F.when(shaped, F.try_to_timestamp(c))


def external_href(c: Column) -> Column:
    """An http(s) address, or a bare host under www, with brackets escaped; null for anything else."""
    url = F.when(c.rlike(r"(?i)^www\.[^\s/?#]+\.[^\s]+$"), F.concat(F.lit("https://"), c)).when(c.rlike(r"(?i)^https?://[^\s/?#]+\.?[^\s]*$"), c)
    return F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def external_links_only(c: Column) -> Column:
    """Whether a text consists of external links and white space alone, without images."""
    bare = F.regexp_replace(c, MARKER, "")
    links = F.regexp_extract_all(bare, F.lit(LINK), F.lit(0))
    targets = F.regexp_extract_all(bare, F.lit(LINK), F.lit(3))
    return (F.size(links) > 0) & ~F.exists(links, lambda x: x.startswith("!")) & F.forall(targets, lambda x: x.rlike("(?i)^<?https?:")) & (strip(F.regexp_replace(bare, LINK, "")) == "")


@F.pandas_udf(T.StringType())
def identity_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A name or title for comparison: compatibility normalisation, exact case folding, single spaces."""
    for s in batches:
        yield s.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))
