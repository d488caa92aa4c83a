import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.operators.snapshots import snapshot_changes, text_hash, validity_intervals

SCHEMA = "b string, s string, k string, title string, content string, at long, g string, h string, ix string"


def events(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    out = snapshot_changes(df, "b", "s", "k", text_hash(F.col("title"), F.col("content")), ("at",))
    return sorted(map(tuple, out.collect()), key=str)


def row(s, k, content, at=1, title=None, b="x"):
    return (b, s, k, title, content, at, "clash", "clash", "clash")


def test_kinds_gaps_and_corrections(spark):
    rows = [
        row("1", "a", "One."), row("2", "a", "One"), row("5", "a", "One"),
        row("1", "b", "Two"), row("5", "b", "Two"),
        row("2", "c", "late", 1), row("2", "c", "right", 2), row("5", "c", "right"),
        row("5", "d", None), row("5", "d", None),
        row(None, "e", "no snapshot"),
    ]
    assert events(spark, rows) == sorted(
        [("x", "1", "2", "a", "changed"), ("x", "1", "2", "b", "removed"), ("x", "2", "5", "b", "added"), ("x", "1", "2", "c", "added"), ("x", "2", "5", "d", "added")], key=str
    )


def test_same_reading_is_no_change(spark):
    rows = [row("1", "a", "Café  au lait\r\n", title=None), row("2", "a", "Café au lait", title=""), row("3", "a", "café au lait")]
    assert events(spark, rows) == [("x", "2", "3", "a", "changed")]


def test_null_group_and_key_ties_and_empty(spark):
    rows = [row("1", None, "a", b=None), row("2", None, "b", None, b=None), row("2", None, "c", None, b=None)]
    assert events(spark, rows) == [(None, "1", "2", None, "changed")]
    assert events(spark, []) == []


def test_long_text(spark):
    long = "word " * 400_000
    assert events(spark, [row("1", "a", long), row("2", "a", long + "x")]) == [("x", "1", "2", "a", "changed")]


def test_intervals(spark):
    df = spark.createDataFrame([row("1", "a", "x"), row("2", "a", "x"), row("3", "b", "x"), row("4", "a", "x")], SCHEMA)
    out = validity_intervals(df, "b", "s", "k", text_hash(F.col("content"))).where("k = 'a'").orderBy("from_ix").collect()
    assert [(r.from_snapshot, r.to_snapshot, r.before_from, r.after_to) for r in out] == [("1", "2", None, "3"), ("4", "4", "3", None)]


@pytest.mark.parametrize("size", [12])
def test_against_brute_force(spark, size):
    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from("1234"), st.sampled_from("abc"), st.sampled_from(["p", "q", "é", "é"]), st.integers(1, 99)), max_size=size, unique_by=lambda r: (r[0], r[1], r[2], r[4])))
    def run(rows):
        state = {}
        for b, s, k, c, at in rows:
            if (b, s, k) not in state or state[b, s, k][0] < at:
                state[b, s, k] = (at, unicodedata.normalize("NFC", c))
        want = set()
        for b in "xy":
            snaps = sorted({s for bb, s, _ in state if bb == b})
            for f, t in zip(snaps, snaps[1:]):
                for k in "abc":
                    old, new = state.get((b, f, k)), state.get((b, t, k))
                    kind = "added" if new and not old else "removed" if old and not new else "changed" if old and new and old[1] != new[1] else None
                    if kind:
                        want.add((b, f, t, k, kind))
        assert set(events(spark, [row(s, k, c, at, b=b) for b, s, k, c, at in rows])) == want

    run()
