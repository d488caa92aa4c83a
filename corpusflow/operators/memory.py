"""Decisions that later texts depend on: applying them in order, packing them under a budget, finding what they touch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusflow.functions.text import fold_case


def upsert_terms(current: DataFrame, rows: DataFrame, term: str, value: str, order: Sequence[str]) -> DataFrame:
    """``term, value, state``: terms of both sides, case aside; what is there stays (kept), a new term is inserted once (its first row
    by ``order``), and a row that gives another value than the one that holds is a conflict."""
    held = current.groupBy(fold_case(F.col(term)).alias("k")).agg(F.min(F.struct(F.col(term).alias("t"), F.col(value).alias("v"))).alias("r")).select("k", "r.*")
    first = rows.select(fold_case(F.col(term)).alias("k"), F.col(term).alias("t2"), F.col(value).alias("v2"), F.row_number().over(Window.partitionBy(fold_case(F.col(term))).orderBy(*order)).alias("n"))
    both = held.join(first, "k", "full_outer")
    winner = F.coalesce(F.col("v"), F.first("v2").over(Window.partitionBy("k").orderBy(F.col("n").asc_nulls_last())))
    seen = both.withColumn("w", winner)
    state = F.when(F.col("v2").isNull() | (F.col("v").isNotNull() & (fold_case(F.col("v2")) == fold_case(F.col("v")))), "kept").when(F.col("v").isNull() & (F.col("n") == 1), "inserted").when(fold_case(F.col("v2")) == fold_case(F.col("w")), "kept").otherwise("conflict")
    return seen.select(F.coalesce("t", "t2").alias(term), F.when(state == "conflict", F.col("v2")).otherwise(F.col("w")).alias(value), state.alias("state")).distinct()


def superseded(entries: DataFrame, entry: str, replaces: str) -> DataFrame:
    """Adds ``active``: false for entries that another one replaces."""
    gone = entries.where(F.col(replaces).isNotNull()).select(F.col(replaces).alias("_gone")).distinct().withColumn("_is", F.lit(True))
    return entries.join(gone, F.col(entry) == F.col("_gone"), "left").withColumn("active", F.col("_is").isNull()).drop("_gone", "_is")


def context_packs(candidates: DataFrame, unit: Sequence[str], priority: str, entry: str, cost: str, budget: int) -> DataFrame:
    """``unit, entries, used, n_candidates``: for each unit its candidates by priority and id, as many as fit the budget; what does not
    fit is passed over. A null cost is none. The candidates of a unit are read in order by one task, which holds those that fit."""
    k = len(unit)
    rows = candidates.select(*unit, F.col(priority).alias("_p"), F.col(entry).alias("_e"), F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("_c"))
    schema = T.StructType([*rows.schema.fields[:k], T.StructField("entries", T.ArrayType(rows.schema["_e"].dataType)), T.StructField("used", T.LongType()), T.StructField("n_candidates", T.LongType())])

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept, used, n = None, [], 0, 0
        for frame in parts:
            out = []
            for r in frame.itertuples(index=False):
                key = tuple(r[:k])
                if key != last:
                    if last is not None:
                        out.append((*last, kept, used, n))
                    last, kept, used, n = key, [], 0, 0
                n += 1
                if used + r[-1] <= budget:
                    kept.append(r[-2])
                    used += int(r[-1])
            yield pd.DataFrame(out, columns=schema.names)
        if last is not None:
            yield pd.DataFrame([(*last, kept, used, n)], columns=schema.names)

    return rows.repartition(*[F.col(u) for u in unit]).sortWithinPartitions(*unit, "_p", "_e").mapInPandas(fill, schema)


def terms_in(texts: DataFrame, keys: Sequence[str], text: str, terms: DataFrame, term: str, few: int = 5000) -> DataFrame:
    """``keys, term`` of every term of at least three characters that stands in ``text``, also inside words; both folded already.

    Up to ``few`` terms travel as one array and are searched in one pass over the texts. More of them meet the texts by their first three
    characters, and only such pairs are tested.
    """
    wanted = terms.where(F.length(term) >= 3).select(F.col(term).alias("_t")).distinct()
    listed = wanted.limit(few + 1).collect()
    k = F.struct(*keys).alias("_k")
    if len(listed) <= few:
        array = F.array(*[F.lit(r[0]) for r in listed]).cast("array<string>")
        found = texts.select(k, F.explode(F.filter(array, lambda t: F.contains(F.col(text), t))).alias("_t"))
    else:
        rows = texts.select(k, F.col(text).alias("_s")).where(F.length(text) >= 3)
        grams = rows.select("_k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_s") - 2), lambda i: F.substring("_s", i, F.lit(3))))).alias("_g"))
        near = grams.join(wanted, F.col("_g") == F.substring("_t", 1, 3)).select(F.col("_k").alias("_k2"), "_t")
        found = near.join(rows, F.col("_k2").eqNullSafe(F.col("_k"))).where(F.contains("_s", "_t")).select("_k", "_t").distinct()
    return found.select(*[F.col("_k").getField(c).alias(c) for c in keys], F.col("_t").alias(term))


def mentions(texts: DataFrame, keys: Sequence[str], columns: Sequence[str], entries: DataFrame, entry: str, term: str, few: int = 5000) -> DataFrame:
    """``keys, entry``: entries whose term, of at least three characters, stands in one of the texts, case aside."""
    named = entries.select(F.col(entry).alias("_e"), fold_case(F.col(term)).alias("_term")).where(F.length(F.trim("_term")) > 2).distinct()
    sides = texts.select(*keys, F.explode(F.array(*[fold_case(F.col(c)) for c in columns])).alias("_text")).where("_text IS NOT NULL")
    return terms_in(sides, keys, "_text", named, "_term", few).join(named, "_term").select(*keys, F.col("_e").alias(entry)).distinct()


def append_missing(current: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that ``current`` has not, by ``keys`` (null is a value), each once: the first by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    k = F.struct(*keys)
    first = rows.groupBy(k.alias("_k")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    new = first.join(current.select(k.alias("_h")).distinct(), F.col("_k").eqNullSafe(F.col("_h")), "left_anti")
    return new.select(*[F.col("_k").getField(c).alias(c) for c in keys], *[F.col("_r").getField(c).alias(c) for c in rest])


def union_once(first: DataFrame, second: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of both, each key once: that of ``first`` if it has one, else the foremost by ``order``."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    rest = [c for c in first.columns if c not in keys]
    one = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_side", *order)).alias("_r"))
    return one.select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest])


def grounded(proposals: DataFrame, texts: DataFrame, unit: Sequence[str], original: str, rendering: str, source: str, target: str) -> DataFrame:
    """``proposals`` with ``state``: grounded where the original stands in its unit's source and the rendering in its target, case aside;
    else source_missing or target_missing; no_unit where the unit has no texts. A null original or rendering stands nowhere."""
    held = texts.select(*[F.col(u).alias(f"_{u}") for u in unit], fold_case(F.col(source)).alias("_s"), fold_case(F.col(target)).alias("_t"))
    on = F.lit(True)
    for u in unit:
        on = on & (F.col(u) == F.col(f"_{u}"))
    inside = lambda text, part: F.coalesce(F.contains(text, fold_case(F.col(part))), F.lit(False))
    state = F.when(F.col("_s").isNull() & F.col("_t").isNull(), "no_unit").when(~inside("_s", original), "source_missing").when(~inside("_t", rendering), "target_missing").otherwise("grounded")
    return proposals.join(held, on, "left").withColumn("state", state).drop("_s", "_t", *[f"_{u}" for u in unit])
