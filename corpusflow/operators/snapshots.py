"""What changed between full snapshots: gaps and islands over key and row hash.

Snapshots of a group (a book) arrive as full lists of keyed rows. Each key's rows are reduced to one row per snapshot, runs of
consecutive snapshots with an equal hash become validity intervals, and the starts, ends and adjacencies of the intervals are the
change events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.text import nfc, squeeze_space


def text_hash(*columns: Column) -> Column:
    """A hash equal for texts that differ in canonical composition and white space only; null counts as empty."""
    parts = [squeeze_space(nfc(F.coalesce(c, F.lit("")))) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def latest_rows(df: DataFrame, group: str, snapshot: str, key: str, row_hash: Column, latest: Sequence[str]) -> DataFrame:
    """One row per (group, snapshot, key): the one latest by ``latest``, ties by the greatest hash. Rows without snapshot fall out.

    The hash is taken before the shuffle, so no text travels, and ``max`` of a struct combines on the map side.
    """
    order = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(latest)], row_hash.alias("h"))
    return (
        df.where(F.col(snapshot).isNotNull())
        .select(F.col(group).alias("g"), F.col(snapshot).alias("s"), F.col(key).alias("k"), order.alias("o"))
        .groupBy("g", "s", "k")
        .agg(F.max("o").alias("o"))
        .select("g", "s", "k", F.col("o.h").alias("h"))
    )


def validity_intervals(df: DataFrame, group: str, snapshot: str, key: str, row_hash: Column, latest: Sequence[str] = ()) -> DataFrame:
    """Islands of equal hash: ``group, key, row_hash, from_ix, to_ix, prev_to_ix, next_from_ix, from_snapshot, to_snapshot,
    before_from, after_to``.

    ``*_ix`` number the group's snapshots in order without holes, so missing snapshot numbers do not matter. ``before_from`` is the
    snapshot before the interval and ``after_to`` the one after it; null at the ends of the history. Null groups and keys are
    values like any other. An empty table gives no rows. Repeated rows count once. Columns of ``df`` beyond those named are unused,
    whatever their names.
    """
    rows = latest_rows(df, group, snapshot, key, row_hash, latest)
    by_group = Window.partitionBy("g").orderBy("s")
    # One row per snapshot of a group: as many as deliveries, not as rows.
    index = (
        rows.groupBy("g", "s")
        .agg(F.lit(1).alias("one"))
        .select("g", "s", F.row_number().over(by_group).alias("ix"), F.lag("s").over(by_group).alias("before"), F.lead("s").over(by_group).alias("after"))
        .withColumnsRenamed({"g": "ig", "s": "is_"})
    )
    at = rows.join(index, F.col("g").eqNullSafe(F.col("ig")) & (F.col("s") == F.col("is_"))).drop("ig", "is_")
    unit = Window.partitionBy("g", "k").orderBy("ix")
    same = (F.lag("ix").over(unit) == F.col("ix") - 1) & (F.lag("h").over(unit) == F.col("h"))
    islands = at.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("new").over(unit))
    spans = islands.groupBy("g", "k", "island").agg(
        F.first("h").alias("h"), F.min("ix").alias("lo"), F.max("ix").alias("hi"),
        F.min_by("s", "ix").alias("s_lo"), F.max_by("s", "ix").alias("s_hi"), F.min_by("before", "ix").alias("b"), F.max_by("after", "ix").alias("a"),
    )
    seq = Window.partitionBy("g", "k").orderBy("lo")
    return spans.select(
        F.col("g").alias(group), F.col("k").alias(key), F.col("h").alias("row_hash"), F.col("lo").alias("from_ix"), F.col("hi").alias("to_ix"),
        F.lag("hi").over(seq).alias("prev_to_ix"), F.lead("lo").over(seq).alias("next_from_ix"),
        F.col("s_lo").alias("from_snapshot"), F.col("s_hi").alias("to_snapshot"), F.col("b").alias("before_from"), F.col("a").alias("after_to"),
    )


def snapshot_changes(df: DataFrame, group: str, snapshot: str, key: str, row_hash: Column, latest: Sequence[str] = ()) -> DataFrame:
    """Change events between consecutive snapshots: ``group, from_snapshot, to_snapshot, key, change_kind``.

    An interval that starts where another ended is a change; one that starts after a gap, but not with the history, an addition; one
    that ends before a gap or before the history does, a removal. See ``validity_intervals`` for nulls, repeats and empty tables.
    """
    spans = validity_intervals(df, group, snapshot, key, row_hash, latest)
    touches = F.col("prev_to_ix") == F.col("from_ix") - 1
    start = F.when(F.col("before_from").isNotNull(), F.struct(F.col("before_from").alias("f"), F.col("from_snapshot").alias("t"), F.when(touches, "changed").otherwise("added").alias("c")))
    goes = F.col("after_to").isNotNull() & (F.col("next_from_ix").isNull() | (F.col("next_from_ix") > F.col("to_ix") + 1))
    end = F.when(goes, F.struct(F.col("to_snapshot").alias("f"), F.col("after_to").alias("t"), F.lit("removed").alias("c")))
    return spans.select(group, key, F.explode(F.filter(F.array(start, end), lambda e: e.isNotNull())).alias("e")).select(
        F.col(group), F.col("e.f").alias("from_snapshot"), F.col("e.t").alias("to_snapshot"), F.col(key), F.col("e.c").alias("change_kind")
    )
