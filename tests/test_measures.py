import difflib
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import edits, memory, quality, records


def test_bounded_spans(spark):
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice(["word ", "End. ", "a", "\n", "\n\n", " \n \n", "  "]) for _ in range(rnd.randint(0, 60)))
        try:
            got = edits.bounded_spans(text, 20)
        except ValueError:
            assert any(len(w) > 20 for w in text.split())
            continue
        assert "".join(v for _, v in got) == text and all(len(v) <= 20 and v == v.strip() for k, v in got if k == "text") and all(not v.strip() for k, v in got if k == "literal")
    assert [v for k, v in edits.bounded_spans("One two. Three four five six.\n\nSeven eight nine ten.", 26) if k == "text"] == ["One two. Three four five", "six.", "Seven eight nine ten."]
    rows = spark.createDataFrame([("a b",), (None,), ("x" * 50,), ("",)], "t string").select(edits.spans_within(F.col("t"), 10).alias("s")).collect()
    assert [r.s and [tuple(x) for x in r.s] for r in rows] == [[("text", "a b")], None, None, []]


def test_global_occurrence(spark):
    rows = [("ab ab", "ab", 3, 5), ("ab ab", "ab", 0, 2), ("ab ab", "ab", 0, 5), ("aaa b a", "aa", 1, 3), ("x", "y", 0, 1)]
    df = spark.createDataFrame(rows, "t string, q string, lo int, hi int")
    assert [r.n for r in df.select(edits.global_occurrence(F.col("t"), F.col("q"), F.col("lo"), F.col("hi")).alias("n")).collect()] == [1, 0, None, None, None]


def test_diff_and_masks(spark):
    df = spark.createDataFrame([("a\nb", "a\nc"), ("x", "x"), (None, "x")], "a string, b string")
    got = [r.d for r in df.select(edits.unified_diff("a", "b").alias("d")).collect()]
    assert got == ["\n".join(difflib.unified_diff(["a", "b"], ["a", "c"], "before", "after", lineterm="")), "", None]
    assert edits.mask_like("[a](x) [b](y)", "[c](z) und [d](w)") == "⟦1⟧c⟦/1⟧ und ⟦2⟧d⟦/2⟧" and edits.mask_like("[a](x)", "none") == "none" and edits.mask_like("none", "[a](x)") == "[a](x)"


def test_memory_sets(spark):
    now = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    rows = spark.createDataFrame([("b", 5), ("b", 4), ("a", 3), (None, 9)], "k string, n int")
    assert [tuple(r) for r in memory.append_missing(now, rows, ["k"], ["n"]).collect()] == [("b", 4)]
    assert sorted(memory.union_once(now, rows, ["k"], ["n"]).collect(), key=str) == sorted([("a", 1), (None, 2), ("b", 4)], key=str)
    texts = spark.createDataFrame([("u", "The Key", "ключ"), ("v", None, None)], "unit string, s string, t string")
    p = spark.createDataFrame([(1, "u", "key", "Ключ"), (2, "u", "lamp", "ключ"), (3, "u", "key", "нет"), (4, "w", "key", "x"), (5, "u", None, None)], "i int, unit string, o string, r string")
    assert {r.i: r.state for r in memory.grounded(p, texts, ["unit"], "o", "r", "s", "t").collect()} == {1: "grounded", 2: "source_missing", 3: "target_missing", 4: "no_unit", 5: "source_missing"}


@pytest.mark.parametrize("few", [0, 5000])
def test_terms_by_either_way(spark, few):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abc ") for _ in range(n))
    texts = [(i if i else None, word(rnd.randint(0, 40))) for i in range(80)] + [(99, None)]
    terms = [(word(rnd.randint(1, 5)),) for _ in range(40)]
    got = {tuple(r) for r in memory.terms_in(spark.createDataFrame(texts, "k int, t string"), ["k"], "t", spark.createDataFrame(terms, "w string"), "w", few).collect()}
    assert got == {(k, w) for k, t in texts for (w,) in terms if t and len(w) >= 3 and w in t}


def test_classes_and_reuse(spark):
    df = spark.createDataFrame([("u", 1, "a", 7), ("u", 2, "b", 8), ("u", 3, "c", 7), ("v", 1, "d", 7), ("w", 1, "e", None)], "u string, i int, r string, h int")
    now = spark.createDataFrame([("u", 7), ("v", 9), ("w", None)], "u string, h int")
    got = {r.r: (r.classification, r.duplicate_of) for r in records.classified(df, ["u"], ["i"], "r", ["h"], now).collect()}
    assert got == {"a": ("superseded", None), "b": ("stale", None), "c": ("current", "a"), "d": ("stale", None), "e": ("current", None)}
    old = spark.createDataFrame([("u", 0, "h"), ("u", 1, "h"), ("u", 2, "x")], "u string, p int, h string")
    new = spark.createDataFrame([("u", 0, "h"), ("u", 1, "h"), ("u", 2, "y")], "u string, p int, h string")
    open_ = spark.createDataFrame([("u", 1)], "u string, p int")
    assert {r.p: r.reuse for r in records.reusable(old, new, ["u"], "p", ["h"], open_).collect()} == {0: True, 1: False, 2: False}


def test_preflight_and_json(spark):
    g = spark.createDataFrame([("Warden", "Хранитель"), ("Cade", "Cade")], "original string, translation string")
    df = spark.createDataFrame([(1, "# Scene\nWarden and Cade in 2024 and 2024\n* * *", "# Сцена\nв 2024"), (2, "same 5", "same 5")], "k int, a string, b string")
    got = sorted((r.k, r.kind, r.detail) for r in quality.preflight(df, ["k"], "a", "b", g).collect())
    assert got == [(1, "glossary_candidate", "Warden -> Хранитель"), (1, "glossary_decision_review", "Cade -> Cade"), (1, "number_missing", "2024: 1"), (1, "structure", "scene_break: source=1, translation=0")]
    one = spark.createDataFrame([(1, "é", None)], "b int, a string, c string")
    assert one.select(X.canonical(b=F.col("b"), a=F.col("a"), c=F.col("c")).alias("j")).first().j == '{"a":"é","b":1,"c":null}\n'


def test_disjoint_prefix(spark):
    rows = [("u", 1, 0, 5), ("u", 2, 5, 9), ("u", 3, 8, 12), ("u", 4, 20, 21), ("v", 1, None, None), ("v", 2, 0, 1), ("w", 1, 0, 1), ("w", 2, 1, 2), ("w", 3, 2, 3)]
    df = spark.createDataFrame(rows, "u string, i int, a int, b int")
    from corpusflow.operators import planning

    assert sorted((r.u, r.i) for r in planning.prefix_disjoint(df, ["u"], ["i"], "a", "b", 2).collect()) == [("u", 1), ("u", 2), ("v", 1), ("w", 1), ("w", 2)]
    parts = spark.createDataFrame([("a", 0, 5, 9), ("a", 5, 9, 9), ("b", 1, 4, 9), ("b", 3, 6, 9), ("b", 7, 7, 9)], "k string, lo int, hi int, n int")
    assert sorted(tuple(r) for r in planning.cover_faults(parts, ["k"], "lo", "hi", "n").collect()) == [("b", "beginning", 1), ("b", "empty", 7), ("b", "end", 7), ("b", "gap", 6), ("b", "overlap", 3)]


def test_verdicts_drift_and_advisories(spark):
    v = lambda *ds: '{"decisions": [' + ",".join(f'{{"finding_id": "{i}", "verdict": "{x}", "risk": "{r}"}}' for i, x, r in ds) + "]}"
    rows = [(v(("b", "reject", "meaning"), ("a", "approve", "none")),), (v(("a", "approve", "none")),), (v(("a", "approve", "meaning"), ("b", "reject", "x")),), (v(("a", "approve", "none"), ("a", "reject", "x")),), ("no",), (None,)]
    got = [r.m for r in spark.createDataFrame(rows, "t string").select(edits.parsed_verdicts(F.col("t"), F.array(F.lit("a"), F.lit("b"))).alias("m")).collect()]
    assert got == [{"a": "approve", "b": "reject"}, None, None, None, None, None]
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None, "a": "1"})], "x map<string,string>, y map<string,string>")
    assert df.select(X.drifted(F.col("x"), F.col("y")).alias("d")).first().d == ["b"]
    g = spark.createDataFrame([("art", "арт"), ("a.b", "xyz")], "original string, translation string")
    b = spark.createDataFrame([(1, 0, "The ART of it", "ничего"), (1, 1, "a party", "ничего"), (1, 2, "a.b", "none"), (1, 3, "axb", "none"), (2, 0, None, "x")], "k int, n int, s string, t string")
    assert sorted(tuple(r) for r in quality.block_advisories(b, ["k"], "n", "s", "t", g).collect()) == [(1, 0, "art", "арт"), (1, 2, "a.b", "xyz")]
