import itertools
import random
import unicodedata

import pytest

from corpusflow.llm import lookalike as L
from corpusflow.llm.glyphs import IN_SCRIPT, LOOKALIKES

TEXTS = ["The old captain hides the rusty knife behind the chapel", "Старый капитан прячет ржавый нож за часовней", "Ο παλιός καπετάνιος κρύβει το μαχαίρι", "déjà vu à côté du poêle"] * 3


MORE = ["every vivid view above quite reviews just jumping foxes over velvet maps kept by dukes and judges, voulu vulgaire vue"] * 5


@pytest.fixture(scope="module")
def bigrams():
    return L.bigram_scores(L.letter_pairs([*TEXTS, *MORE]))


def disguise(rnd, text):
    out = []
    for c in text:
        r = rnd.random()
        twins = [x for g in LOOKALIKES if c in g for x in g]
        if twins and r < 0.3:
            c = rnd.choice(twins)
        elif r < 0.4 and c.isascii() and c.isalpha():
            c = chr(ord(c) + 0xFEE0)
        elif r < 0.5:
            c = unicodedata.normalize("NFD", c)
        elif r < 0.6:
            c += rnd.choice("​‌­⁠﻿")
        if c == " ":
            c = rnd.choice("    　  ")
        out.append(c)
    return "".join(out)


def test_whatever_looks_alike_has_one_form(bigrams):
    rnd, c = random.Random(2), L.Canonical(bigrams)
    for text in TEXTS:
        own = L.own_script(text)
        for _ in range(40):
            assert c.form(disguise(rnd, text), own) == c.form(text, own) == unicodedata.normalize("NFC", text)


def test_visible_differences_stay(bigrams):
    c = L.Canonical(bigrams)
    assert len({c.form(t, "L") for t in ["resume", "résume", "Resume", "re sume", "resumé"]}) == 5
    assert c.form("ﬁne ﬂag", "L") == "fine flag" and c.form("", "L") == "" and c.form("a\n\nb", "L") == "a\n\nb"


def test_viterbi_against_brute_force(bigrams):
    def score(path, word, own):
        total, last, before = None, "^", None
        for c, s in zip(word, path):
            options = IN_SCRIPT.get(c) or {L.script(c): c}
            if s not in options:
                return None, ""
            if before is None:
                total = 0.0
            elif s != before:
                total -= L.SWITCH
                last = "^"
            total += L.OWN * (s == own) + L._pair(bigrams, s, last, options[s])
            last, before = options[s], s
        return total + L._pair(bigrams, before, last, "$"), "".join((IN_SCRIPT.get(c) or {L.script(c): c})[s] for c, s in zip(word, path))

    for word in ["cop", "оса", "рt", "Τhе", "сaт", "ху", "a", "жopа"]:
        for own in "LC":
            best = max((x for p in itertools.product(L.SCRIPTS, repeat=len(word)) if (x := score(p, word, own))[0] is not None), key=lambda x: x[0])
            got = L.resolve(word, own, bigrams)
            assert got == best[1] or abs(max(score(p, word, own)[0] or -1e9 for p in itertools.product(L.SCRIPTS, repeat=len(word)) if score(p, word, own)[1] == got) - best[0]) < 1e-6


def test_own_script():
    assert [L.own_script(t) for t in ["the fox", "лиса и", "", "a o p", "12"]] == ["L", "C", "", "", ""]


def test_operator(spark):
    rows = [(1, "Τhe old\xa0captain", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 50_000, "x"), (1, "Τhe old\xa0captain", "x")]
    df = spark.createDataFrame(rows, "id long, text string, form string")
    grams = L.fit_bigrams(df, "text")
    got = [(r.id, r.form) for r in L.canonical_texts(df, ["id"], "text", grams).collect()]
    assert sorted((i, (f or "")[:20], f is None) for i, f in got) == [(1, "The old captain", False)] * 2 + [(2, "", True), (3, "", False), (4, "word word word word ", False)]
    assert L.canonical_texts(df.limit(0), ["id"], "text", {}).count() == 0 and L.fit_bigrams(df.limit(0), "text") == {}


def test_found(spark, tmp_path):
    ch = [(1, "b", "u", "The оld captain ​hides it."), (1, "b", "u", "The оld captain ​hides it."), (2, "b", "v", None)]
    spark.createDataFrame(ch, "chapter_id long, book_slug string, unit_id string, content string").write.parquet(f"{tmp_path}/chapters.parquet")
    fi = [(1, "b", "u", ("old captain hides",)), (2, "b", "u", ("The оld",)), (3, "b", "u", ("new captain",)), (4, "b", "u", None), (5, "b", "v", ("x",)), (6, "b", "w", ("x",)), (7, "b", "u", ("",)), (1, "b", "u", ("old captain hides",))]
    spark.createDataFrame(fi, "finding_key long, book_slug string, unit_id string, source_anchor struct<quote:string>").write.parquet(f"{tmp_path}/findings.parquet")
    assert [r.finding_key for r in L.p5_found(spark, str(tmp_path)).collect()] == [1]
    assert L.p5_quotes(spark, str(tmp_path)).count() == 6


def test_find_quotes_in_blocks(spark):
    """Blocks of two quotes give what one block gives; nulls, several texts of a unit and a unit without text."""
    q = spark.createDataFrame([(i, "u", f"word{i} hеre" if i % 2 else f"word{i}") for i in range(25)] + [(90, "u", None), (91, None, "x"), (92, "v", "x"), (3, "u", "word3 hеre")], "k long, unit string, q string")
    u = spark.createDataFrame([("u", " ".join(f"word{i} here" for i in range(20))), ("u", "other text"), (None, "x"), ("w", "word1")], "unit string, t string")
    grams = L.bigram_scores(L.letter_pairs(TEXTS))
    rows = lambda **o: sorted((r.k, r.q, r.exact, r.found, r.quote_form is None) for r in L.find_quotes(q, "k", "q", u, "t", ["unit"], grams, **o).collect())
    every = rows()
    assert every == rows(block=2) and len(every) == 52 and not any(x[4] for x in every)
    best = {k: max(x[2:4] for x in every if x[0] == k) for k in {x[0] for x in every}}
    assert best[3] == (False, True) and best[4] == (True, True) and best[23] == best[91] == best[92] == (False, False)
    assert [x[:4] for x in rows(every_form=False)] == [x[:4] for x in every] and all(x[4] == x[2] for x in rows(every_form=False))
