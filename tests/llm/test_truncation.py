import random
from collections import Counter

import numpy as np

from corpusflow.llm import truncation as U


def test_endings():
    done = [
        "It ends.", "He asks “why?”", "It ends.\n\n* * *", "Prose.\n\n## End of the first part", "Prose.\n\n— Anna Petrowa", "Prose.\n\n“But the door—”", "« Mais la porte— »",
        "(An aside…)", "Prose. [5](#note-3)", "It ends.​", "It ends. ", "Ｅｎｄｓ．", "<!-- bt-block:000002 -->", "", "   ",
    ]
    assert [U.ending(t)[0] for t in done] == ["done"] * len(done)
    opened = ["It stops in the mid", "It stops,", "It stops in the sal\\n\\", "It stops in &nb", "It stops �", "One line.\nanother that was wrapped and\nstops here in", "- a long item that is a sentence and was cut in the", "Prose [5](#no"]
    assert [U.ending(t)[0] for t in opened] == ["open"] * len(opened)
    assert [U.ending(t)[0] for t in ["Maybe it ends…", "Maybe it ends...", "Prose.\n\n- a key\n- the map", "Prose.\n\nBehind the wall\nUnder the stairs\nIn the attic"]] == ["dots", "dots", "list", "verse"]


def test_counts_by_brute_force():
    texts = ["the old cat sleeps in the attic. the old car stops in the road.", None, "", "the old ca", "We see the old cat"]
    total = Counter()
    U.count_tails(texts, total)
    assert total["^ the old", "cat", False] == 1 and total["^ the old", "car", False] == 1 and total["in the", "attic", True] == 1
    assert total["^ the old", "ca", False] == 0 and sum(n for (c, w, _), n in total.items() if c == "~ca" and w == "cat") == 1
    assert U.tail("We see the old cat") == ("open", "^ we see the old", "cat") and U.tail("Done.") is None


def test_operator(spark):
    whole = [(i, f"Copy number {i} says that the old captain hides the rusty knife in the attic.", "x") for i in range(8)]
    cut = [
        (100, "Once again the old captain hides the rusty kni…", "x"), (101, "Once again the old captain hides the rusty knife in the attic…", "x"), (102, "Once again the old captain hides the rusty...", "x"),
        (103, "Once again the old capt", "x"), (104, None, "x"), (105, "", "x"), (106, "Prose.\n\n- the knife\n- the att", "x"), (107, "Prose.\n\n- the attic\n- the knife", "x"), (103, "Once again the old capt", "x"),
        (108, "word " * 100_000, "x"),
    ]
    df = spark.createDataFrame(whole + cut, "id long, text string, cut string")
    got = {r.id: r.cut for r in U.truncated(df, ["id"], "text").collect()}
    assert got == {100: True, 101: False, 102: True, 103: True, 106: True, 107: False, 108: True}
    row = U.truncated(df, ["id"], "text").where("id = 100").first()
    assert (row.tail_word, row.n_longer, row.n_end) == ("kni", 9, 0)
    assert U.truncated(df.limit(0), ["id"], "text").count() == 0


def test_the_end_is_found_whatever_its_length():
    """Only the end of a text is read: the same as the patterns over all of it."""
    rnd = random.Random(3)
    parts = ["word ", "End. ", "…", "...", "\n", "  " * 40, "</b>", "\\n", "�", "[truncated]", "](http://x.y/" + "z" * 90 + ")", "”" * 70, "* * *", "&amp", "(cut)", "— "]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        core = U._JUNK.sub("", t)
        assert U._without_junk(t) == core
        assert not core or U._is_ended(core) == bool(U._ENDED.search(core))


def test_filter_loses_no_count():
    texts = ["The old cat sleeps in the attic, and the old dog sleeps in the barn. Once more: the old car stops…", "“Où est-il ?” – Il dort. ﬁn", None, "the old ca"] * 3
    every, some, bits = Counter(), Counter(), np.zeros(U.FILTER_BITS // 64, np.uint64)
    U.count_tails(texts, every)
    for c in (asked := {"^ ", "^ the old", "in the", "~ca", "sleeps in"}):
        h = U.context_hash(c)
        bits[h >> 6] |= np.uint64(1) << np.uint64(h & 63)
    U.count_tails(texts, some, bits, {})
    assert some == {k: n for k, n in every.items() if k[0] in asked} and len(some) >= 8


def test_filter_of_the_session(spark):
    df = spark.createDataFrame([("^ ",), ("^ le vieux",), ("в доме",), ("~ca",), ("~ca",)], "ctx string")
    bits = U._filter_of(df)
    assert all(U._passes(bits, np.array([U.context_hash(r.ctx)]))[0] for r in df.collect()) and sum(int(x).bit_count() for x in bits) == 4


def test_strict_prefixes_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("abé漢") for _ in range(rnd.randint(0, 7))), "x") for i in range(400)] + [(900, None, "x"), (901, "a", "x"), (901, "a", "x"), (902, "zz" * 30_000, "x"), (903, "zz" * 60_000, "x")]
    df = spark.createDataFrame(rows, "id long, text string, longer string").repartition(7)
    got = sorted((r.id, r.longer.id, r.n_chars, r.n_longer_chars) for r in U.strict_prefixes(df, ["id"], "text").collect())
    values = sorted({t for _, t, _ in rows if t}, key=lambda t: t.encode())
    least = {t: min(i for i, u, _ in rows if u == t) for t in values}
    want = set()
    for i, t, _ in rows:
        if t and (longer := [u for u in values if u.startswith(t) and u != t]):
            want.add((i, least[longer[0]], len(t), len(longer[0])))
    assert got == sorted(want) and len(want) > 100
    assert U.strict_prefixes(df.limit(0), ["id"], "text").count() == 0
