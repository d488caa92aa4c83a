"""Rules over rows and tables, as one pass that collects what each row breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX64, HEX32, UNIT, SEGMENT = "^[0-9a-f]{64}$", "^[0-9a-f]{32}$", r"^chapter-\d{6}$", r"^s\d{5}$"


def violations(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """``keys, errors``: the names of the rules that a row breaks, in the order given; rows without any are left out. A rule that is
    null for a row counts as broken."""
    errors = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda e: e.isNotNull())
    return df.select(*keys, errors.alias("errors")).where(F.size("errors") > 0)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def conflicting(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys under which different values stand, with how many; nulls are a value."""
    return df.groupBy(*keys).agg(F.countDistinct(F.struct(value)).alias("n_values")).where("n_values > 1")


def missing_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def one_of(c: Column, values: Sequence[str]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def bounded(c: Column, least: int, most: int) -> Column:
    return (F.length(c) >= least) & (F.length(c) <= most)
