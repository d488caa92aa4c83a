import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.operators import memory, planning, records, validation


def naive_cuts(text, count, least):
    import re

    places, cuts = [m.end() for m in re.finditer(r"\n[ \t]*\n", text)], [0]
    for part in range(1, count):
        rest = count - part
        free = [p for p in places if p > cuts[-1] + least and len(text) - p >= least * rest and sum(q > p for q in places) >= rest - 1]
        if not free:
            return None
        cuts.append(min(free, key=lambda p: abs(p - len(text) * part / count)))
    return [*cuts, len(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=25), st.integers(1, 5), st.integers(0, 30))
def test_cuts(sizes, count, least):
    text = "\n\n".join("x" * n for n in sizes)
    assert planning.even_cuts(text, count, least) == naive_cuts(text, count, least)


def naive_groups(sizes, count):
    out, i, left = [], 0, sum(max(1, s) for s in sizes)
    for g in range(count):
        groups, weight, n = count - g, 0, 0
        while i < len(sizes):
            units = len(sizes) - i
            if n and (units <= groups - 1 or weight >= left / groups):
                break
            weight, n, i = weight + max(1, sizes[i]), n + 1, i + 1
            out.append(g + 1)
            if groups == 1:
                continue
        left -= weight
    return out


def test_contiguous_groups(spark):
    rnd = random.Random(1)
    rows = [([rnd.randint(0, 30) for _ in range(rnd.randint(1, 12))], rnd.randint(1, 5)) for _ in range(60)]
    rows = [(s, min(k, len(s))) for s, k in rows]
    got = spark.createDataFrame(rows, "s array<int>, k int").select(planning.contiguous_groups(F.col("s"), F.col("k")).alias("g")).collect()
    for (s, k), r in zip(rows, got):
        assert r.g == naive_groups(s, k)


def test_budgets(spark):
    df = spark.createDataFrame([("u", i, n) for i, n in enumerate([5, 4, 9, 1, 1, 20, 2])], "g string, i int, n int")
    assert [r.i for r in planning.prefix_within(df, ["g"], ["i"], F.col("n"), 3, 10).orderBy("i").collect()] == [0, 1]
    b = planning.batches_within(df, ["g"], ["i"], "n", 3, 10).orderBy("i").collect()
    assert [r.batch_no for r in b] == [1, 1, 2, 3, 3, 4, 5] or [r.batch_no for r in b] == [1, 1, 2, 2, 3, 4, 5]
    kept = spark.createDataFrame([([5, 4, 3, 1],)], "a array<int>").select(planning.greedy_within(F.col("a"), 8, lambda x: x).alias("k")).first().k
    assert kept == [5, 3]


def test_queue_and_latest(spark):
    df = spark.createDataFrame([("a", 2, 9), ("a", 1, 5), ("b", 3, 1), ("c", 4, 7)], "k string, i int, t int")
    assert [tuple(r) for r in planning.fair_queue(df, ["k"], ["i"], ["t"], 2).collect()] == [("b", 3, 1), ("a", 1, 5)]
    assert sorted(tuple(r) for r in records.latest_by(df, ["k"], ["i"]).collect()) == [("a", 2, 9), ("b", 3, 1), ("c", 4, 7)]


def test_stalled(spark):
    rows = [("u", i, s, f"t{i}", True) for i, s in enumerate([3, 4, 5])] + [("v", i, s, f"t{i}", True) for i, s in enumerate([5, 3, 4])] + [("w", i, 3, "same", True) for i in range(3)] + [("x", i, 3, f"t{i}", i < 2) for i in range(3)]
    df = spark.createDataFrame(rows, "u string, i int, score int, art string, rej boolean")
    assert [tuple(r) for r in records.stalled(df, ["u"], ["i"], "score", "art", "rej").collect()] == [("u", 3, 5)]


def test_history_and_states(spark):
    df = spark.createDataFrame([("u", 1, "a", 7), ("u", 2, "b", 8), ("u", 3, "c", 7)], "u string, i int, r string, s int")
    assert [(r.sequence, r.supersedes, r.duplicate_of) for r in records.with_history(df, ["u"], ["i"], "r", ["s"]).orderBy("i").collect()] == [(1, None, None), (2, "a", None), (3, "b", "a")]
    units = spark.createDataFrame([("u", "h1"), ("v", "h2"), ("w", "h3")], "u string, h string")
    recs = spark.createDataFrame([("u", "h1", 1, False), ("u", "h1", 2, True), ("v", "old", 1, True)], "u string, h string, i int, ok boolean")
    got = {r.u: r.state for r in records.resolve_units(units, recs, ["u"], ["h"], ["i"], F.col("ok")).collect()}
    assert got == {"u": "pass", "v": "stale", "w": "missing"}


def test_rules(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 0), (2, "c", 7)], "k int, a string, n int")
    bad = validation.violations(df, ["k"], {"a": validation.one_of(F.col("a"), ["a", "b"]), "n": F.col("n") > 0})
    assert sorted((r.k, r.errors) for r in bad.collect()) == [(2, ["a"]), (2, ["a", "n"])]
    assert [tuple(r) for r in validation.repeated_keys(df, ["k"]).collect()] == [(2, 2)] and validation.conflicting(df, ["k"], "a").count() == 1
    assert validation.missing_from(df, df.where("k = 1"), ["k"]).count() == 2


def test_memory(spark):
    current = spark.createDataFrame([("Key", "ключ")], "t string, v string")
    rows = spark.createDataFrame([("key", "Ключ", 1), ("KEY", "замок", 2), ("Lamp", "лампа", 3), ("lamp", "фонарь", 4)], "t string, v string, i int")
    got = sorted((r.t.lower(), r.v.lower(), r.state) for r in memory.upsert_terms(current, rows, "t", "v", ["i"]).collect())
    assert got == [("key", "замок", "conflict"), ("key", "ключ", "kept"), ("lamp", "лампа", "inserted"), ("lamp", "фонарь", "conflict")]
    cand = spark.createDataFrame([("u", 1, "b", 5), ("u", 0, "a", 4), ("u", 2, "c", 3), ("u", 3, "d", 1)], "u string, p int, e string, c int")
    pack = memory.context_packs(cand, ["u"], "p", "e", "c", 8).first()
    assert (pack.entries, pack.used, pack.n_candidates) == (["a", "c", "d"], 8, 4)
    ent = spark.createDataFrame([("a", None), ("b", "a")], "e string, r string")
    assert {r.e: r.active for r in memory.superseded(ent, "e", "r").collect()} == {"a": False, "b": True}


def test_paired_cuts():
    source = "".join(f"<!-- bt-block:{i:06d} -->\n{'x' * n}\n\n" for i, n in enumerate([10, 200, 30, 180], 1))
    target = source.upper().replace("BT-BLOCK", "bt-block")
    cuts = planning.paired_cuts(source, target, 2)
    assert [source[a:b].count("bt-block") for a, b, _, _ in cuts] == [target[c:d].count("bt-block") for _, _, c, d in cuts] == [2, 2]
    assert "".join(source[a:b] for a, b, _, _ in cuts) == source and "".join(target[c:d] for _, _, c, d in cuts) == target
    assert planning.paired_cuts(source, "no blocks", 2) is None and planning.paired_cuts(source, target, 5) is None and planning.block_ranges(source + source) == {}
