import random

import numpy as np
import pytest
import tiktoken  # noqa: F401
from pyspark.sql import functions as F

from corpusflow.llm import packing as P


def placed(plan, counts):
    key, per, base, start = plan.arrays()
    out = []
    for s, n in counts.items():
        r = np.arange(n)
        j = np.searchsorted(key, (np.int64(s) << 44) | r, side="right") - 1
        assert (key[j] >> 44 == s).all()
        out += [(int(c), s) for c in base[j] + (r - start[j]) // per[j]]
    return out


def best_fit(items, capacity):
    rooms = []
    for s in sorted(items, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def optimum(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, r in enumerate(rooms):
            if r >= items[i] and r not in rooms[:k]:
                go(i + 1, rooms[:k] + [r - items[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 20, 100])
    items = [rnd.randint(1, capacity) for _ in range(rnd.choice([0, 3, 30, 300]))]
    counts = {s: items.count(s) for s in set(items)}
    plan = P.plan_containers(counts, capacity)
    got = placed(plan, counts)
    load = np.zeros(plan.containers, int)
    for c, s in got:
        load[c] += s
    assert (load <= capacity).all() and (load > 0).all() and len(got) == len(items)
    assert plan.containers <= best_fit(items, capacity)


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(1, 12) for _ in range(9)]
    left, fixed = {s: items.count(s) for s in set(items)}, []

    def take(s, n):
        left[s] -= n
        if not left[s]:
            del left[s]

    P._reduce(left, 12, lambda contents, times: fixed.append(times), take)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(fixed) + optimum(rest, 12) == optimum(items, 12)


def test_counts_as_best_fit():
    rnd = random.Random(5)
    for _ in range(50):
        items = [rnd.randint(1, 30) for _ in range(80)]
        got = P._best_fit({s: items.count(s) for s in set(items)}, 30)
        assert sum(t for _, t in got) == best_fit(items, 30)


def test_token_counts_are_the_tokenizers():
    counter = P.TokenCounter(P.load_vocabulary())
    for text in ["", "Hello  world's\n\n é漢字 \U0001f600", "Старый капитан прячет ржавый нож. ", "x" * 5000, " \t\n  a", "it's we'll 12345 ___"]:
        assert counter.count(text) == len(counter.encoding.encode_ordinary(text))


def test_operator(spark):
    rows = [(1, 25), (2, 10), (3, 7), (4, 3), (5, 0), (6, None), (7, 30), (7, 30), (None, 4)]
    df = spark.createDataFrame(rows, "doc long, n long").withColumn("salt", F.lit(1))
    packs = spark.createDataFrame([("a", 10), ("b", 100), ("c", None), ("d", 0)], "name string, cap int")
    got = P.pack(df, "doc", "n", packs, "name", "cap", group_rows=2).collect()
    assert {r.pack_name for r in got} == {"a", "b"}
    for name, cap in (("a", 10), ("b", 100)):
        mine = [r for r in got if r.pack_name == name]
        load = {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.token_to - r.token_from
        assert max(load.values()) <= cap and sum(load.values()) == sum(n or 0 for _, n in rows)
        assert sum(r.piece_no == 0 for r in mine) == len(rows)
        if cap == 100:
            assert all(r.piece_no == 0 for r in mine) and len(load) == 2
        else:
            assert sorted((r.token_from, r.token_to) for r in mine if r.doc_id == 1) == [(0, 10), (10, 20), (20, 25)]
            assert len(load) == 11
    assert P.pack(df.limit(0), "doc", "n", packs, "name", "cap").count() == 0
    assert P.pack(df, "doc", "n", packs.limit(0), "name", "cap").count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 100_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in P.token_counts(df, "doc_id", "text").collect()} == {1: 0, 2: 0, 3: 100_001}
