"""Ordered records of units: the latest, their history, scores and progress; and the measures of calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; combined on the map side, so a hot key costs one row for each task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest])


def with_history(df: DataFrame, unit: Sequence[str], order: Sequence[str], record: str, same: Sequence[str]) -> DataFrame:
    """Adds ``sequence`` in the unit, ``supersedes`` (the record before), and ``duplicate_of`` (the first record with equal ``same``)."""
    line = Window.partitionBy(*unit).orderBy(*order)
    alike = Window.partitionBy(*unit, *same).orderBy(*order)
    first = F.first(record).over(alike)
    return df.withColumns({"sequence": F.row_number().over(line), "supersedes": F.lag(record).over(line), "duplicate_of": F.when(first != F.col(record), first)})


def severity_weight(severity: Column, weights: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, w in weights.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def stalled(df: DataFrame, unit: Sequence[str], order: Sequence[str], score: str, artifact: str, rejected: str, reviews: int = 3) -> DataFrame:
    """Units whose last ``reviews`` records were all rejected, each of another artifact, and never with a lower score."""
    back = Window.partitionBy(*unit).orderBy(*[F.desc(c) for c in order])
    line = Window.partitionBy(*unit).orderBy(*order)
    seen = df.withColumns({"_back": F.row_number().over(back), "_before": F.lag(score).over(line)}).where(F.col("_back") <= reviews)
    held = F.bool_and(F.when(F.col("_back") < reviews, F.col(score) >= F.col("_before")).otherwise(True))
    return (
        seen.groupBy(*unit)
        .agg(F.count("*").alias("n_reviews"), F.bool_and(rejected).alias("_rejected"), F.countDistinct(artifact).alias("_artifacts"), held.alias("_held"), F.min_by(score, "_back").alias("last_score"), F.max_by(score, "_back").alias("first_score"))
        .where((F.col("n_reviews") == reviews) & F.col("_rejected") & (F.col("_artifacts") == reviews) & F.col("_held"))
        .select(*unit, "first_score", "last_score")
    )


def grouped_medians(df: DataFrame, group: str, baseline: object, rate: str, measures: Sequence[str]) -> DataFrame:
    """Exact medians of each group, and how the rate compares with that of the baseline group."""
    medians = df.groupBy(group).agg(F.count("*").alias("samples"), F.median(rate).alias(f"median_{rate}"), *[F.median(m).alias(f"median_{m}") for m in measures])
    base = medians.where(F.col(group) == baseline).agg(F.max(f"median_{rate}").alias("_base"))
    # One row on the right.
    return medians.join(F.broadcast(base)).withColumn("speedup", F.col(f"median_{rate}") / F.col("_base")).drop("_base")


def resolve_units(units: DataFrame, records: DataFrame, on: Sequence[str], identity: Sequence[str], order: Sequence[str], passed: Column) -> DataFrame:
    """``units`` with ``state``: pass or corrections_required where the last record with equal identity says so, stale where there are
    only others, missing where there is none."""
    exact = records.groupBy(*on, *identity).agg(F.max_by(passed, F.struct(*order)).alias("_pass"))
    some = records.select(*on).distinct().withColumn("_some", F.lit(True))
    seen = units.join(exact, [*on, *identity], "left").join(some, [*on], "left")
    return seen.withColumn("state", F.when(F.col("_pass"), "pass").when(~F.col("_pass"), "corrections_required").when(F.col("_some"), "stale").otherwise("missing")).drop("_pass", "_some")


def classified(df: DataFrame, unit: Sequence[str], order: Sequence[str], record: str, identity: Sequence[str], current: DataFrame) -> DataFrame:
    """Adds ``classification``: current for the last record of a unit whose ``identity`` is the one in ``current`` (a row for each unit),
    superseded for earlier ones of that identity, stale for those of another or of no unit; and ``duplicate_of``, the first record of the
    unit with the same identity."""
    seen = df.join(current.select(*[F.col(u).alias(f"_{u}") for u in unit], *[F.col(i).alias(f"_now_{i}") for i in identity], F.lit(True).alias("_known")), _all_equal([(F.col(u), F.col(f"_{u}")) for u in unit]), "left")
    same = F.coalesce(F.col("_known"), F.lit(False)) & _all_equal([(F.col(i), F.col(f"_now_{i}")) for i in identity])
    line = Window.partitionBy(*unit, *identity)
    last = F.row_number().over(line.orderBy(*[F.desc(c) for c in order])) == 1
    first = F.first(record).over(line.orderBy(*order))
    out = seen.withColumns({"classification": F.when(~same, "stale").when(last, "current").otherwise("superseded"), "duplicate_of": F.when(first != F.col(record), first)})
    return out.drop("_known", *[f"_{u}" for u in unit], *[f"_now_{i}" for i in identity])


def _all_equal(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out


def reusable(old: DataFrame, new: DataFrame, unit: Sequence[str], part: str, hashes: Sequence[str], findings: DataFrame) -> DataFrame:
    """``new`` with ``reuse``: whether the part of that name in ``old`` had equal ``hashes`` and no open finding (rows of ``findings`` by
    unit and part)."""
    keys = [*unit, part]
    same = old.select(*keys, *hashes).distinct().join(findings.select(*keys).distinct(), keys, "left_anti").withColumn("_same", F.lit(True))
    return new.join(same, [*keys, *hashes], "left").withColumn("reuse", F.col("_same").isNotNull()).drop("_same")
