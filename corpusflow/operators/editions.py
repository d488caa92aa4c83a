"""Matching the units of two editions of a book, and sealing and auditing their bytes."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.text import fold_case, squeeze_space
from corpusflow.session import cut_lineage


def _unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def match_editions(old: DataFrame, new: DataFrame, book: str, unit: str, content_hash: str, title: str, position: str | None = None) -> DataFrame:
    """``book, old_unit, new_unit, classification``: unchanged by a content hash, changed by a title, each unique on both sides of a
    book among what is left; new and deleted otherwise. Null hashes and titles match nothing.

    With ``position``, hashes that occur more than once in a book are told apart by their order first.
    """
    side = lambda df, name: df.select(F.col(book).alias("b"), F.col(unit).alias(name), *([F.col(position).alias("p")] if position else []), F.col(content_hash).alias("h"), squeeze_space(fold_case(F.col(title))).alias("t"))
    a, b = side(old, "old_unit"), side(new, "new_unit")
    same = None
    if position:
        again = [df.where("h IS NOT NULL").groupBy("b", "h").count().where("count > 1").select("b") for df in (a, b)]
        books = again[0].unionByName(again[1]).distinct()
        blocks = match_in_order(*[df.where("h IS NOT NULL").join(books, "b", "left_semi").withColumnRenamed(name, "u") for df, name in ((a, "old_unit"), (b, "new_unit"))], "b", "u", "p", "h")
        same = cut_lineage(blocks.select("b", "old_unit", "new_unit", F.lit("unchanged").alias("classification")))
        a2, b2 = a.join(same, ["b", "old_unit"], "left_anti"), b.join(same, ["b", "new_unit"], "left_anti")
    else:
        a2, b2 = a, b
    by_hash = _unique(a2.where("h IS NOT NULL"), ["b", "h"]).join(_unique(b2.where("h IS NOT NULL"), ["b", "h"]), ["b", "h"]).select("b", "old_unit", "new_unit", F.lit("unchanged").alias("classification"))
    same = by_hash if same is None else same.unionByName(by_hash)
    rest_a, rest_b = a.join(same, ["b", "old_unit"], "left_anti"), b.join(same, ["b", "new_unit"], "left_anti")
    moved = _unique(rest_a.where("t IS NOT NULL"), ["b", "t"]).join(_unique(rest_b.where("t IS NOT NULL"), ["b", "t"]), ["b", "t"]).select("b", "old_unit", "new_unit", F.lit("changed").alias("classification"))
    none = F.lit(None).cast("string")
    gone = rest_a.join(moved, ["b", "old_unit"], "left_anti").select("b", "old_unit", none.alias("new_unit"), F.lit("deleted").alias("classification"))
    fresh = rest_b.join(moved, ["b", "new_unit"], "left_anti").select("b", none.alias("old_unit"), "new_unit", F.lit("new").alias("classification"))
    return same.unionByName(moved).unionByName(gone).unionByName(fresh).withColumnRenamed("b", book)


def seal(df: DataFrame, book: str, unit: Sequence[str], content: str) -> DataFrame:
    """``book, n_units, n_chars, seal``: one SHA-256 over the digests of a book's units, whatever their order in the table.

    The digests are sorted in 4096 parts, by their first three digits, and the parts' digests once more, so no task sees all units of a
    large book. A unit's digest is that of its names and of the digest of its content, nulls told from texts.
    """
    one = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"u{i}") for i, c in enumerate(unit)], F.sha2(content, 256).alias("c")), {"ignoreNullFields": "false"}), 256)
    rows = df.select(F.col(book).alias("b"), one.alias("d"), F.length(content).alias("n"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    parts = rows.groupBy("b", F.substring("d", 1, 3).alias("x")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), joined("d").alias("d"))
    return parts.groupBy(F.col("b").alias(book)).agg(F.sum("k").alias("n_units"), F.sum("n").alias("n_chars"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "d"))), lambda p: p["d"]), ""), 256).alias("seal"))


def hash_state(stored: Column, content: Column) -> Column:
    """How a stored SHA-256 relates to the content: missing, malformed, same, other_case or different."""
    real = F.sha2(content, 256)
    return F.when(stored.isNull(), "missing").when(stored == real, "same").when(F.lower(stored) == real, "other_case").when(~stored.rlike("^[0-9a-fA-F]{64}$"), "malformed").otherwise("different")


def verify_seal(stored: DataFrame, current: DataFrame, book: str, unit: str, content_hash: str) -> DataFrame:
    """``book, unit, problem``: units of a stored seal that are missing or differ now, and those that it does not know."""
    a = stored.select(F.col(book).alias("b"), F.col(unit).alias("u"), F.col(content_hash).alias("was"), F.lit(True).alias("old"))
    c = current.select(F.col(book).alias("b"), F.col(unit).alias("u"), F.col(content_hash).alias("now"), F.lit(True).alias("new"))
    both = a.join(c, ["b", "u"], "full_outer")
    problem = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "unknown").when(~F.col("was").eqNullSafe(F.col("now")), "different")
    return both.where(problem.isNotNull()).select(F.col("b").alias(book), F.col("u").alias(unit), problem.alias("problem"))


def match_in_order(old: DataFrame, new: DataFrame, book: str, unit: str, position: str, content_hash: str) -> DataFrame:
    """``book, old_unit, new_unit``: units in the matching blocks of two editions, as difflib finds them in their order.

    Used where contents repeat inside a book, so that only their order tells them apart. A book's hashes are one task's work: a unit
    is 64 bits there, whatever its length.
    """
    schema = f"{book} string, old_unit string, new_unit string"

    def blocks(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (x.sort_values("p", kind="stable").reset_index(drop=True) for x in (a, b))
        found = SequenceMatcher(a=a["h"].tolist(), b=b["h"].tolist(), autojunk=False).get_matching_blocks()
        rows = [(key[0], a["u"][m.a + k], b["u"][m.b + k]) for m in found for k in range(m.size)]
        return pd.DataFrame(rows, columns=[book, "old_unit", "new_unit"])

    side = lambda df: df.select(F.col(book).cast("string").alias("g"), F.col(unit).alias("u"), F.col(position).alias("p"), F.xxhash64(content_hash).alias("h")).groupBy("g")
    return side(old).cogroup(side(new)).applyInPandas(blocks, schema)


def unanswered(earlier: DataFrame, later: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, problem``: rows of ``earlier`` that ``later`` answers never (missing) or more than once (twice), and answers to nothing
    (unknown)."""
    n = later.groupBy(*keys).agg(F.count("*").alias("_n"))
    asked = earlier.select(*keys).distinct().withColumn("_asked", F.lit(True))
    both = asked.join(n, list(keys), "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_asked").isNull(), "unknown").when(F.col("_n") > 1, "twice")
    return both.where(problem.isNotNull()).select(*keys, problem.alias("problem"))


def tiered_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: Sequence[Sequence[str]]) -> DataFrame:
    """``left_id, right_id, tier, n_matches``: the rows of ``right`` that a row of ``left`` agrees with on the keys of the first tier
    that gives any. More than one leaves ``right_id`` null: the row is ambiguous. Null keys agree with nothing."""
    todo, found = left, None
    for k, keys in enumerate(tiers):
        known = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys)).groupBy(*keys).agg(F.countDistinct(right_id).alias("n_matches"), F.min(right_id).alias("_r"))
        hit = todo.join(known, list(keys)).select(left_id, F.when(F.col("n_matches") == 1, F.col("_r")).alias(right_id), F.lit(k + 1).alias("tier"), "n_matches")
        found = hit if found is None else found.unionByName(hit)
        todo = todo.join(hit.select(left_id), left_id, "left_anti")
    return found
