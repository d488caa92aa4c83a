import random

from corpusflow.llm import leakage as L

WORDS = [f"w{a}{b}" for a in "bcdfg" for b in "aeiou"] * 2 + ["the", "of", "in"]


def brute(doc, item):
    """Longest stretch by dynamic programming over all starts: is there one close enough?"""
    need = min(L.STRETCH, len(item))
    for i in range(len(item)):
        for j in range(len(doc)):
            if item[i] != doc[j]:
                continue
            table = [[0] * (len(doc) - j + 1) for _ in range(len(item) - i + 1)]
            for x in range(len(item) - i + 1):
                for y in range(len(doc) - j + 1):
                    if x and y:
                        same = item[i + x - 1] == doc[j + y - 1]
                        table[x][y] = min(table[x - 1][y - 1] + (not same), table[x - 1][y] + 1, table[x][y - 1] + 1)
                        if same and x >= need and table[x][y] * L.PER_EDIT <= x + 3:
                            return True
                    else:
                        table[x][y] = x + y
    return False


def edited(rnd, words, rate):
    out = []
    for w in words:
        r = rnd.random()
        out += [] if r < rate / 3 else [w, rnd.choice(WORDS)] if r < rate * 2 / 3 else [rnd.choice(WORDS)] if r < rate else [w]
    return out


def test_against_brute_force():
    rnd, differs, found = random.Random(3), 0, 0
    for k in range(60):
        item = [rnd.choice(WORDS) for _ in range(30)]
        lo = rnd.randint(0, 8)
        copy = edited(rnd, item[lo : lo + rnd.randint(15, 30)], rnd.choice([0, 0.05, 0.1, 0.2]))
        doc = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 9))] + copy + [rnd.choice(WORDS) for _ in range(5)]
        got = bool(L.scan(L.ItemIndex([(1, " ".join(item))]), {}, [" ".join(doc)])[0])
        want = brute(doc, item)
        found += want
        differs += got != want
    assert found > 15 and differs <= 1  # an equal word at the edge may be reached by two paths


def test_what_does_not_matter():
    passage = "The old captain hides the rusty knife behind the chapel, says Mizu, and Savodan counts again the star chart on the market square tonight."
    noisy = "Before. THE <b>old</b>\n\ncaptain hides — the rusty\xa0knife [3](#note-1) behind the ch­apel says Мizu; and Sаvоdan <!-- bt-block:000002 --> counts again the [star](http://x.y/z) ｃｈａｒｔ on the mar​ket square tonight"
    out = L.scan(L.ItemIndex([(7, passage)]), {}, [noisy, None, "", "the rusty knife behind the chapel"])
    assert [(x[0], x[3], x[4]) for x in out[0]] == [(7, 24, 0)] and out[1:] == [[], [], []]
    lo, hi = out[0][0][1:3]
    assert noisy[lo:hi].startswith("THE") and noisy[lo:hi].endswith("tonight")


def test_short_passages_and_order():
    index = L.ItemIndex([(1, "alpha beta"), (2, "one two three four five six"), (3, None), (4, " . ")])
    out = L.scan(index, {}, ["x alpha, BETA y", "beta alpha", "six five four three two one", "one two three four five six"])
    assert [[x[0] for x in o] for o in out] == [[1], [], [], [2]]


def test_operator(spark):
    words = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(11, "intro. " + words + " end", "a"), (12, None, "a"), (13, "", "a"), (14, "x " * 200_000, "b"), (15, words, "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, words), (2, words), (3, None), (None, words)], "item_id long, passage string")
    out = L.leaked_spans(docs, "doc_id", "text", items, "item_id", "passage")
    assert sorted((r.doc_id, r.item_id) for r in out.collect()) == [(11, 1), (11, 2), (15, 1), (15, 2)]
    blocks = L.leaked_spans(docs, "doc_id", "text", items, "item_id", "passage", block_chars=100)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, out.collect()))
    clean = {r.doc_id: r.text for r in L.without_spans(docs, "doc_id", "text", out).collect()}
    assert clean[11] == "intro.  end" and clean[15] == "" and clean[12] is None and len(clean[14]) == 400_000
    assert L.leaked_spans(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0
    assert L.leaked_spans(docs.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0


def test_stretch_and_edits_are_parameters(spark):
    assert L.longest_run(20, 8) == 5 and L.longest_run(12, 4) == 2 and L.longest_run(3, 100) == 3
    words = [f"word{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "a " + " ".join(words[5:17]) + " b"), (2, " ".join(w if i % 5 else "other" for i, w in enumerate(words)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, passage string")
    found = lambda **o: sorted((r.doc_id, r.n_words) for r in L.leaked_spans(docs, "doc_id", "text", items, "item_id", "passage", **o).collect())
    assert found() == [] and found(stretch=12, per_edit=12) == [(1, 12)] and found(stretch=12, per_edit=4) == [(1, 12), (2, 39)]


def test_other_parameters_against_brute_force(monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 12)
    monkeypatch.setattr(L, "PER_EDIT", 5)
    rnd, differs, found = random.Random(8), 0, 0
    for k in range(40):
        item = [rnd.choice(WORDS) for _ in range(20)]
        doc = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 9))] + edited(rnd, item[: rnd.randint(8, 20)], rnd.choice([0, 0.1, 0.2])) + [rnd.choice(WORDS) for _ in range(5)]
        got = bool(L.scan(L.ItemIndex([(1, " ".join(item))], 12, 5), {}, [" ".join(doc)])[0])
        found += got
        differs += got != brute(doc, item)
    assert found > 10 and differs <= 1


def test_spans_are_removed_by_either_join(spark):
    docs = spark.createDataFrame([(1, "abcdef", 1), (1, "abcdef", 2), (2, "xyz", 3), (3, None, 4)], "doc_id long, text string, _doc int")
    spans = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (1, 1, 3), (3, 0, 1)], "doc_id long, char_from int, char_to int")
    for few in (0, 10):
        got = L.without_spans(docs, "doc_id", "text", spans, few)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "aef", 1), (1, "aef", 2), (2, "xyz", 3), (3, None, 4)]
