import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from corpusflow.operators import editions as E

SCHEMA = "b string, u string, p int, h string, t string"


def test_match(spark):
    old = spark.createDataFrame([("b", "1", 1, "h1", "One"), ("b", "2", 2, "h2", "Two  X"), ("b", "3", 3, "h3", "Same"), ("b", "4", 4, "h4", "Same"), ("b", "5", 5, None, None)], SCHEMA)
    new = spark.createDataFrame([("b", "a", 1, "h1", "Other"), ("b", "b", 2, "hx", "two x"), ("b", "c", 3, "hy", "Same"), ("b", "d", 4, "hz", "Fresh"), ("b", "e", 5, None, None)], SCHEMA)
    got = {(r.old_unit, r.new_unit, r.classification) for r in E.match_editions(old, new, "b", "u", "h", "t").collect()}
    assert got == {("1", "a", "unchanged"), ("2", "b", "changed"), ("3", None, "deleted"), ("4", None, "deleted"), ("5", None, "deleted"), (None, "c", "new"), (None, "d", "new"), (None, "e", "new")}


def test_match_in_order(spark):
    rnd = random.Random(1)
    make = lambda: [("b", f"{i}", i, rnd.choice("xyz"), None) for i in range(12)]
    a, b = make(), make()
    got = {(r.old_unit, r.new_unit) for r in E.match_in_order(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "b", "u", "p", "h").collect()}
    want = {(str(m.a + k), str(m.b + k)) for m in SequenceMatcher(a=[r[3] for r in a], b=[r[3] for r in b], autojunk=False).get_matching_blocks() for k in range(m.size)}
    assert got == want


def test_seals(spark):
    df = spark.createDataFrame([("b", "1", 1, "text", ""), ("b", "2", 2, "other", ""), ("c", "1", 1, "x", "")], SCHEMA)
    seal = lambda d: {r.b: r.seal for r in E.seal(d, "b", ["u"], "h").collect()}
    assert seal(df) == seal(df.orderBy(F.desc("u")).repartition(3)) and seal(df)["b"] != seal(df.where("u = '1'"))["b"]
    now = df.where("b = 'b'").withColumn("h", F.when(F.col("u") == "1", "changed").otherwise(F.col("h"))).unionByName(spark.createDataFrame([("b", "9", 9, "n", "")], SCHEMA))
    assert {(r.b, r.u, r.problem) for r in E.verify_seal(df, now, "b", "u", "h").collect()} == {("b", "1", "different"), ("c", "1", "missing"), ("b", "9", "unknown")}


def test_states_and_answers(spark):
    real = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    df = spark.createDataFrame([(real, "test"), (real.upper(), "test"), (None, "test"), ("xyz", "test"), (real, "Test")], "s string, c string")
    assert [r.x for r in df.select(E.hash_state(F.col("s"), F.col("c")).alias("x")).collect()] == ["same", "other_case", "missing", "malformed", "different"]
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1,), (2,), (2,), (4,)], "k int")
    assert {tuple(r) for r in E.unanswered(a, b, ["k"]).collect()} == {(3, "missing"), (2, "twice"), (4, "unknown")}


def test_tiers(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "z", "x"), (3, "z", "y"), (4, "z", "none"), (5, None, None)], "i int, k string, t string")
    right = spark.createDataFrame([("r1", "a", "x"), ("r2", "b", "x"), ("r3", "c", "y"), ("r4", None, None)], "r string, k string, t string")
    assert sorted(map(tuple, E.tiered_match(left, right, "i", "r", [["k", "t"], ["t"]]).collect())) == [(1, "r1", 1, 1), (2, None, 2, 2), (3, "r3", 2, 1)]
