"""Filling containers of fixed capacity with texts measured in tokens (problem 6).

Only sizes matter for the packing, so it is planned on their histogram, which has at most as many entries as the capacity, however
many texts there are. The plan first fixes small sets that dominate every alternative (Martello and Toth's reduction: a pair that
fills a container exactly, an item that nothing fits beside, an item that only one more fits beside), then places what is left,
largest first, into the fullest container with room. Containers with equal histories are one class with a multiplicity. Texts then
get a rank among those of their size, by salted groups, and the plan maps rank ranges to containers.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusflow.session import cut_lineage, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's texts are cut before byte pairs are merged: part of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LARGEST = 1 << 23


def load_vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    path = os.path.join(folder, name)
    if os.path.getsize(path) > _LARGEST:
        raise ValueError(f"{path} is larger than a vocabulary that is sent to every task")
    with open(path, "rb") as f:
        return f.read()


class TokenCounter:
    """Counts tokens; a piece between two cuts is encoded once and then looked up."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        pieces, known = self.cut.findall(text), self.known
        try:
            return sum([known[p] for p in pieces])
        except KeyError:
            if len(known) > 1_000_000:
                known.clear()
            total = 0
            for p in pieces:
                if p not in known:
                    n = len(self.encoding.encode_ordinary(p))
                    if len(p) > 64:
                        total += n
                        continue
                    known[p] = n
                total += known[p]
            return total


def token_counts(docs: DataFrame, doc_id: str, text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens``; a null text has 0 tokens."""
    held = docs.sparkSession.sparkContext.broadcast(load_vocabulary(folder, name))

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(held.value)
        for s in batches:
            yield s.map(lambda t: 0 if t is None else counter.count(t)).astype("int64")

    return docs.select(F.col(doc_id), count(F.col(text)).alias("n_tokens"))


@dataclass
class Plan:
    """Rank ranges of each size, and the containers they go to: item ``r`` of the range goes to ``base + r // per``."""

    capacity: int
    containers: int = 0
    reduced: int = 0
    size: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, ...]:
        key = (np.array(self.size, np.int64) << 44) | np.array(self.rank, np.int64)
        order = np.argsort(key)
        return key[order], np.array(self.per, np.int64)[order], np.array(self.base, np.int64)[order], np.array(self.rank, np.int64)[order]


def plan_containers(counts: dict[int, int], capacity: int) -> Plan:
    """Plan for ``counts`` items of each size from 1 to ``capacity``."""
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes lie between 1 and the capacity")
    plan, used = Plan(capacity), dict.fromkeys(left, 0)

    def settle(contents: Sequence[tuple[int, int]], times: int) -> None:
        for s, per in contents:
            plan.size.append(s), plan.rank.append(used[s]), plan.per.append(per), plan.base.append(plan.containers)
            used[s] += per * times
        plan.containers += times

    def take(s: int, n: int) -> None:
        left[s] -= n
        if not left[s]:
            del left[s]

    _reduce(left, capacity, settle, take)
    plan.reduced = plan.containers
    for contents, times in _best_fit(left, capacity):
        settle(contents, times)
    return plan


def _reduce(left: dict[int, int], capacity: int, settle, take) -> None:
    """Fix the sets that dominate all others with their largest item, until none is found."""
    for s in sorted(left, reverse=True):  # pairs that fill a container exactly, and items that fill it alone
        if s not in left:
            continue
        rest = capacity - s
        if rest == 0:
            settle([(s, 1)], left[s])
            take(s, left[s])
        elif rest == s and left[s] > 1:
            n = left[s] // 2
            settle([(s, 2)], n)
            take(s, 2 * n)
        elif rest != s and rest in left:
            n = min(left[s], left[rest])
            settle([(s, 1), (rest, 1)], n)
            take(s, n), take(rest, n)
    sizes = sorted(left)

    def used_up(*those: int) -> None:
        for x in {x for x in those if x not in left}:
            del sizes[bisect.bisect_left(sizes, x)]

    while sizes:
        s, rest = sizes[-1], capacity - sizes[-1]
        small: list[int] = []  # the three smallest items besides one of the largest
        for x in sizes:
            small += [x] * min(left[x] - (x == s), 3 - len(small))
            if len(small) == 3:
                break
        if not small or small[0] > rest:
            n = left[s] if s > rest else 1
            settle([(s, 1)], n)
            take(s, n)
            used_up(s)
            continue
        k = bisect.bisect_right(sizes, rest)
        if sizes[k - 1] == s and left[s] == 1:
            k -= 1
        best = sizes[k - 1]
        alone = len(small) < 2 or small[0] + small[1] > rest
        if not alone and (len(small) < 3 or sum(small) > rest):  # at most two more fit: one that is as large as any two dominates
            alone = best >= _largest_pair(sizes, k, rest, lambda x: left[x] - (x == s))
        if not alone:
            return
        n = left[s] // 2 if best == s else min(left[s], left[best])
        if best == s:
            settle([(s, 2)], n)
            take(s, 2 * n)
        else:
            settle([(s, 1), (best, 1)], n)
            take(s, n), take(best, n)
        used_up(s, best)


def _largest_pair(sizes: list[int], k: int, rest: int, count) -> int:
    """The most that two of the items of the first ``k`` sizes fill of ``rest``."""
    low, high, top = 0, k - 1, 0
    while low <= high:
        both = sizes[low] + sizes[high]
        if both > rest:
            high -= 1
        else:
            if low < high or count(sizes[low]) > 1:
                top = max(top, both)
            low += 1
    return top


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit of items in falling order; containers with the same contents are counted, not listed."""
    rooms: list[int] = []
    by_room: dict[int, list[tuple[tuple, int]]] = {}
    done: list[tuple[tuple, int]] = []

    def keep(contents: tuple, times: int, room: int) -> None:
        if times <= 0:
            return
        if room == 0:
            done.append((contents, times))
            return
        if room not in by_room:
            bisect.insort(rooms, room)
            by_room[room] = []
        by_room[room].append((contents, times))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                contents, times = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, contents = capacity, ()
                times = -(-n // (capacity // s))
            per = room // s
            full = min(times, n // per)
            rest = n - full * per if full < times else 0
            keep((*contents, (s, per)), full, room - per * s)
            if rest:
                keep((*contents, (s, rest)), 1, room - rest * s)
            keep(contents, times - full - (rest > 0), room)
            n -= full * per + rest
    return done + [x for room in rooms for x in by_room[room]]


def pack(tokens: DataFrame, doc_id: str, n_tokens: str, packs: DataFrame, pack_name: str, capacity: str, group_rows: int = 1_000_000) -> DataFrame:
    """Containers of every text: ``pack_name, doc_id, piece_no, token_from, token_to, container_id``.

    A text above the capacity is cut into pieces of the capacity and one rest; any other is one piece. Container numbers run from 0
    within a pack. Texts without tokens (or with a null count) need no room and are spread over the containers. Repeated rows are
    packed each; ties among equal sizes are broken by ``doc_id``. No texts give no rows, as do no packs; packs whose capacity is null
    or below 1 are ignored, of equal names the smallest capacity holds. ``group_rows`` is about how many pieces are ranked in one task, and the
    histogram that comes to the driver has at most as many rows as the capacities add up to.
    """
    spark = tokens.sparkSession
    wanted = packs.where(F.col(capacity) > 0).groupBy(F.col(pack_name).alias("p")).agg(F.min(capacity).cast("long").alias("c")).orderBy("p").limit(1001).collect()
    if len(wanted) > 1000 or sum(r.c for r in wanted) > 10_000_000:
        raise ValueError("the packs' histograms would not be small")
    base = cut_lineage(tokens.select(F.col(doc_id).alias("d"), F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)).alias("n")))
    names = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(r.c).alias("c")) for i, r in enumerate(wanted)]) if wanted else F.array().cast("array<struct<p:int,c:bigint>>")
    each = base.select("d", "n", F.explode(names).alias("q")).select("d", "n", "q.p", "q.c")
    pieces = F.when(F.col("n") > F.col("c"), F.ceil(F.col("n") / F.col("c"))).otherwise(F.lit(1)).cast("int")
    # Rows that are ranked are pieces: most of those of long texts have one size, the capacity.
    salts = max(8, -(-(each.agg(F.sum(pieces)).first()[0] or 0) // group_rows))
    items = (
        each.select("d", "n", "p", "c", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("i"))
        .withColumns({"lo": F.col("i") * F.col("c"), "hi": F.least("n", (F.col("i") + 1) * F.col("c")), "salt": F.pmod(F.xxhash64("d", "i"), F.lit(salts)).cast("int")})
        .withColumn("size", (F.col("hi") - F.col("lo")).cast("int"))
    )
    parts = items.groupBy("p", "size", "salt").count()
    parts = cut_lineage(parts)
    histogram: dict[int, dict[int, int]] = {i: {} for i in range(len(wanted))}
    for r in parts.groupBy("p", "size").agg(F.sum("count").alias("k")).collect():
        if r.size:
            histogram[r.p][r.size] = r.k
    plans = [plan_containers(histogram[i], r.c) for i, r in enumerate(wanted)]
    held = spark.sparkContext.broadcast([x.arrays() for x in plans])
    before = parts.select("p", "size", "salt", (F.sum("count").over(Window.partitionBy("p", "size").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = items.join(before, ["p", "size", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("p", "size", "salt").orderBy("d", "i")) - 1)

    @F.pandas_udf(T.LongType())
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, size, rank in batches:
            out = np.zeros(len(p), np.int64)
            ps, ss, rs = p.to_numpy(), size.to_numpy(np.int64), rank.to_numpy(np.int64)
            for k in np.unique(ps):
                at = np.flatnonzero((ps == k) & (ss > 0))
                if len(at):
                    key, per, first, start = held.value[k]
                    j = np.searchsorted(key, (ss[at] << 44) | rs[at], side="right") - 1
                    out[at] = first[j] + (rs[at] - start[j]) // per[j]
            yield pd.Series(out)

    count = F.element_at(F.array(*[F.lit(max(1, x.containers)) for x in plans] or [F.lit(1)]), F.col("p") + 1)
    name = F.element_at(F.array(*[F.lit(r.p) for r in wanted] or [F.lit("")]), F.col("p") + 1)
    container = F.when(F.col("size") == 0, F.pmod(F.xxhash64("d"), count.cast("long"))).otherwise(place("p", "size", "rank"))
    return ranked.select(name.alias("pack_name"), F.col("d").alias("doc_id"), F.col("i").alias("piece_no"), F.col("lo").alias("token_from"), F.col("hi").alias("token_to"), container.alias("container_id"))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    tokens = token_counts(table(spark, root, "documents"), "doc_id", "text")
    return pack(tokens, "doc_id", "n_tokens", table(spark, root, "pack_targets"), "pack_name", "capacity_tokens")


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    """Per pack: containers, the least that could do, and the share of space in use."""
    packs = table(spark, root, "pack_targets").select("pack_name", "capacity_tokens").distinct()
    fill = p6_containers(spark, root).groupBy("pack_name").agg(
        F.count_if(F.col("piece_no") == 0).alias("n_docs"), F.count("*").alias("n_pieces"), (F.max("container_id") + 1).alias("n_containers"), F.sum(F.col("token_to") - F.col("token_from")).alias("n_tokens")
    )
    # A row for each pack, of which there is a fixed number.
    return fill.join(packs, "pack_name").withColumns({"least_containers": F.ceil(F.col("n_tokens") / F.col("capacity_tokens")), "fill": F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6)})


QUERIES = {"p6_containers": p6_containers, "p6_report": p6_report}
ORACLE: dict[str, str] = {}
