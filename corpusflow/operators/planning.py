"""Selections under budgets: chunks of a text, prefixes of a list, contiguous partitions, fair queues."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def even_cuts(text: str, count: int, least: int) -> list[int] | None:
    """Offsets of ``count`` pieces with 0 and the length: each cut the paragraph end nearest its even share that leaves ``least``
    characters, and places enough, for every piece still to come; None where there is none."""
    places = [m.end() for m in re.finditer(r"\n[ \t]*\n", text)]
    size, cuts = len(text), [0]
    for part in range(1, count):
        rest = count - part
        low = bisect.bisect_right(places, cuts[-1] + least)
        high = min(bisect.bisect_right(places, size - least * rest), len(places) - max(0, rest - 1))
        if low >= high:
            return None
        aim = size * part / count
        k = bisect.bisect_left(places, aim, low, high)
        cuts.append(min(places[max(low, k - 1) : min(high, k + 1)], key=lambda p: abs(p - aim)))
    return [*cuts, size]


def paragraph_cuts(text: Column, count: Column, least: int = 500) -> Column:
    """``even_cuts`` of every row; null for a null text."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, counts in batches:
            yield pd.Series([None if t is None else even_cuts(t, int(n), least) for t, n in zip(texts, counts)], dtype=object)

    return cut(text, count)


def windows(text: Column, start: Column, end: Column, overlap: int = 1800) -> Column:
    """``lo, hi``: a piece with ``overlap`` more on both sides, out to the ends of paragraphs."""
    left, right = F.greatest(F.lit(0), start - overlap), F.least(F.length(text), end + overlap)
    before = F.length(F.call_function("substring_index", F.substring(text, F.lit(1), left), F.lit("\n\n"), F.lit(-1)))
    after = F.locate("\n\n", F.substring(text, right + 1, F.length(text)))
    lo = F.when(before < left, left - before).otherwise(0)
    return F.struct(lo.alias("lo"), F.when((right < F.length(text)) & (after > 0), right + after + 1).otherwise(F.length(text)).alias("hi"))


def prefix_within(df: DataFrame, group: Sequence[str], order: Sequence[str], size: Column, most_rows: int, most_size: int) -> DataFrame:
    """The first rows of each group, at most ``most_rows`` and up to ``most_size`` in all; a group's first row always fits."""
    line = Window.partitionBy(*group).orderBy(*order)
    seen = df.withColumns({"_n": F.row_number().over(line), "_total": F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, 0))})
    return seen.where((F.col("_n") == 1) | ((F.col("_n") <= most_rows) & (F.col("_total") <= most_size))).drop("_n", "_total")


def prefix_disjoint(df: DataFrame, group: Sequence[str], order: Sequence[str], low: str, high: str, most: int) -> DataFrame:
    """The first rows of each group, at most ``most``, up to the first whose range ``[low, high)`` is null, empty or meets one before; if
    that is the group's first row, it alone. A group is read in order by one task, which holds ``most`` ranges."""
    k = len(group)

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, done = None, [], False
        for frame in parts:
            keep = []
            for r in frame[[*group, low, high]].itertuples(index=False):
                key, a, b = tuple(r[:k]), r[k], r[k + 1]
                if key != last:
                    last, held, done = key, [], False
                fits = not (pd.isna(a) or pd.isna(b)) and a < b and not any(a < y and x < b for x, y in held)
                taken = not done and (fits or not held) and len(held) < most
                done = done or not fits or not taken
                if taken:
                    held.append((a, b))
                keep.append(taken)
            yield frame[keep]

    laid = df.repartition(*[F.col(g) for g in group]).sortWithinPartitions(*group, *order)
    return laid.mapInPandas(choose, df.schema)


def cover_faults(parts: DataFrame, keys: Sequence[str], start: str, end: str, total: str) -> DataFrame:
    """``keys, fault, at``: where parts ``[start, end)`` do not cover their whole of ``total`` characters once: a gap, an overlap, an empty
    part, or a beginning or end that is missing."""
    line = Window.partitionBy(*keys).orderBy(start, end)
    seen = parts.select(*keys, F.col(start).alias("_a"), F.col(end).alias("_b"), F.col(total).alias("_n"), F.lag(end).over(line).alias("_before"), F.lead(start).over(line).alias("_next"))
    fault = lambda ok, name, at: F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("fault"), at.cast("long").alias("at")))
    first, last = F.col("_before").isNull(), F.col("_next").isNull()
    found = F.array(
        fault(F.col("_a") < F.col("_b"), "empty", F.col("_a")), fault(~first | (F.col("_a") == 0), "beginning", F.col("_a")), fault(~last | (F.col("_b") == F.col("_n")), "end", F.col("_b")),
        fault(first | (F.col("_a") <= F.col("_before")), "gap", F.col("_before")), fault(first | (F.col("_a") >= F.col("_before")), "overlap", F.col("_a")),
    )
    return seen.select(*keys, F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select(*keys, "f.fault", "f.at")


def batches_within(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Adds ``batch_no``: consecutive rows of a group, each batch as long as ``most_rows`` and ``most_size`` allow.

    A batch depends on the one before, so a group is read in order by one task, row by row; it holds nothing but three numbers.
    """
    keys = [*group, *order]
    wanted = [*dict.fromkeys([*keys, size])]

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, batch, rows, total = None, 0, 0, 0
        for frame in parts:
            out = []
            for r in frame[[*group, size]].itertuples(index=False):
                key, n = tuple(r[:-1]), int(r[-1] or 0)
                if key != last:
                    last, batch, rows, total = key, 1, 0, 0
                elif rows and (rows >= most_rows or total + n > most_size):
                    batch, rows, total = batch + 1, 0, 0
                rows, total = rows + 1, total + n
                out.append(batch)
            yield frame.assign(batch_no=out)

    laid = df.select(*wanted).repartition(*[F.col(g) for g in group]).sortWithinPartitions(*keys)
    return laid.mapInPandas(number, T.StructType([*laid.schema.fields, T.StructField("batch_no", T.IntegerType())]))


def contiguous_groups(sizes: Column, count: Column) -> Column:
    """Group numbers of a list of sizes cut into ``count`` runs of about equal weight, the target renewed for what remains."""
    total = F.aggregate(sizes, F.lit(0).cast("double"), lambda a, s: a + F.greatest(s, F.lit(1)))
    n = F.size(sizes)
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(1).alias("g"), F.lit(0.0).alias("w"), total.alias("left"), F.lit(0).alias("i"))

    def step(a: Column, s: Column) -> Column:
        weight = F.greatest(s, F.lit(1)).cast("double")
        units, groups = n - a["i"], count - a["g"] + 1
        last_free = units <= groups - 1
        full = (a["w"] >= a["left"] / groups) & (units > groups - 1)
        fresh = (a["w"] > 0) & (last_free | full)
        g = a["g"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.concat(a["out"], F.array(g)).alias("out"), g.alias("g"), F.when(fresh, weight).otherwise(a["w"] + weight).alias("w"), F.when(fresh, a["left"] - a["w"]).otherwise(a["left"]).alias("left"), (a["i"] + 1).alias("i"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def contiguous_runs(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str, count: int) -> DataFrame:
    """Adds ``run_no``: the rows of each group, in order, in ``count`` runs (or as many as it has rows) of about equal weight, the target
    renewed for what remains; as ``contiguous_groups`` does with a list.

    A run depends on the ones before, so a group is read in order by one task, row by row; what is held of it are a few numbers.
    """
    keys = [*group, *order]
    wanted = [*dict.fromkeys([*keys, size])]
    weight = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(1)).cast("double")
    totals = df.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.sum(weight).alias("_left"), F.count("*").alias("_rows"))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, run, filled, left, todo, runs = None, 1, 0.0, 0.0, 0, 1
        for frame in parts:
            out = []
            for r in frame[[*group, size, "_left", "_rows"]].itertuples(index=False):
                key, w = tuple(r[:-3]), float(max(r[-3] or 0, 1))
                if key != last:
                    last, run, filled, left, todo = key, 1, 0.0, float(r[-2]), int(r[-1])
                    runs = min(count, todo)
                groups = runs - run + 1
                if filled and (todo <= groups - 1 or filled >= left / groups):
                    run, left, filled = run + 1, left - filled, 0.0
                filled, todo = filled + w, todo - 1
                out.append(run)
            yield frame.drop(columns=["_left", "_rows"]).assign(run_no=out)

    laid = df.select(*wanted).join(totals, same).select(*wanted, "_left", "_rows").repartition(*[F.col(g) for g in group]).sortWithinPartitions(*keys)
    return laid.mapInPandas(number, T.StructType([*df.select(*wanted).schema.fields, T.StructField("run_no", T.IntegerType())]))


def greedy_within(items: Column, budget: int, size) -> Column:
    """The items of an ordered array that fit a budget, one after another; what does not fit is passed over."""
    start = F.struct(F.slice(items, 1, 0).alias("kept"), F.lit(0).alias("used"))
    return F.aggregate(
        items, start,
        lambda a, x: F.when(a["used"] + size(x) <= budget, F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), (a["used"] + size(x)).alias("used"))).otherwise(a),
        lambda a: a["kept"],
    )


def fair_queue(df: DataFrame, key: Sequence[str], first: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """One row for each key (the first by ``first``), then the ``limit`` foremost by ``order``."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*first)).alias("_r")).select(*key, *[F.col("_r").getField(c).alias(c) for c in rest])
    return one.orderBy(*order).limit(limit)


_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("source_from", "source_to", "target_from", "target_to")]))
_BLOCK = re.compile(r"<!--\s*bt-block:(\d+)\s*-->")


def block_ranges(text: str) -> dict[str, tuple[int, int]]:
    """Where each marked block begins and ends, marker included; nothing where a number occurs twice."""
    found = list(_BLOCK.finditer(text))
    ends = [*(m.start() for m in found[1:]), len(text)]
    out = {m[1]: (m.start(), e) for m, e in zip(found, ends)}
    return out if len(out) == len(found) else {}


def paired_cuts(source: str, target: str, count: int) -> list[tuple[int, int, int, int]] | None:
    """Both texts in ``count`` pieces cut before the same marked blocks, each cut where both together come nearest their even share;
    None where the blocks of the two differ or are too few."""
    a, b = block_ranges(source), block_ranges(target)
    if list(a) != list(b) or len(a) < count or count < 1:
        return None
    places = [(a[k][0], b[k][0]) for k in list(a)[1:]]
    full, cuts, first = len(source) + len(target), [], 0
    for part in range(1, count):
        last = len(places) - (count - 1 - part)
        k = min(range(first, last), key=lambda i: abs(sum(places[i]) - full * part / count))
        cuts.append(places[k])
        first = k + 1
    edges = [(0, 0), *cuts, (len(source), len(target))]
    return [(x[0], y[0], x[1], y[1]) for x, y in zip(edges, edges[1:])]


def paired_chunks(source: Column, target: Column, count: Column) -> Column:
    @F.pandas_udf(_SPANS)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, t, n in batches:
            yield pd.Series([None if x is None or y is None else paired_cuts(x, y, int(k)) for x, y, k in zip(s, t, n)], dtype=object)

    return cut(source, target, count)
