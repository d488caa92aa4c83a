import itertools
import random

import pandas as pd

from corpusflow.llm import alignment as A


def test_forms():
    assert A.roman("Дуса".lower()) == A.roman("dusa") and A.roman("мизу") == A.roman("mizu") and A.roman("belbelbel") == A.roman("белбелбел")
    assert A.tokens("He has 1,000 keys; ИХ") == ["he", "has", "1,000", "keys", "их"]


def test_longest_chain_against_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        points = list({(rnd.randint(0, 6), rnd.randint(0, 6)): None for _ in range(rnd.randint(0, 9))})
        points = [(i, j, rnd.choice([1.0, 2.0, 0.5])) for i, j in points]
        best = 0.0
        for k in range(len(points) + 1):
            for sub in itertools.combinations(sorted(points), k):
                if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(sub, sub[1:])):
                    best = max(best, sum(p[2] for p in sub))
        chain = A.longest_chain(points)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:])) and abs(sum(p[2] for p in chain) - best) < 1e-9


WORDS = {"cat": "katze", "dog": "hund", "tree": "baum", "house": "haus", "sees": "sieht", "buys": "kauft", "old": "alte", "red": "rote", "river": "fluss", "boat": "boot"}
LEX = {a: {b: 0.9} for a, b in WORDS.items()}


def both(words):
    return " ".join(words).capitalize() + ".", " ".join(WORDS[w] for w in words).capitalize() + "."


def test_omission_merge_and_move():
    s = [both(x.split()) for x in ["cat sees red boat", "dog buys old house", "old tree red river", "boat sees cat buys", "red cat buys tree"]]
    source = [a for a, _ in s]
    target = [s[0][1], s[1][1][:-1] + " und " + s[2][1].lower(), s[4][1]]
    assert [(i, j) for i, j, _ in A.align(A.Unit(source, target, LEX))] == [(0, 0), (1, 1), (2, 1), (4, 2)]
    moved = [s[k][1] for k in (1, 0, 2, 4, 3)]
    assert {(i, j) for i, j, _ in A.align(A.Unit(source, moved, LEX))} == {(0, 1), (1, 0), (2, 2), (3, 4), (4, 3)}
    assert A.align(A.Unit([], target, LEX)) == [] and A.align(A.Unit(source, [], LEX)) == [] and A.align(A.Unit(["", "."], [" "], LEX)) == []


def test_numbers_and_names_alone():
    source = ["Mizu counts 25 apples.", "Savodan sleeps.", "Then 300 letters come for Dantibel."]
    target = ["Мизу считает 25 яблок.", "Саводан спит.", "Потом 300 писем для Дантибел."]
    assert [(i, j) for i, j, _ in A.align(A.Unit(source, target))] == [(0, 0), (1, 1), (2, 2)]


def rows(n=40, seed=1):
    rnd, out, k = random.Random(seed), [], 0
    truth = set()
    for u in range(n):
        for pos in range(8):
            words = rnd.sample(sorted(WORDS), 4)
            a, b = both(words)
            a, b = f"{a[:-1]} {u * 100 + pos}.", f"{b[:-1]} {u * 100 + pos}."
            out += [(k, "b", f"u{u}", "source", pos + 1, "en", a, "x"), (k + 1, "b", f"u{u}", "target", pos + 1, "de" if pos else None, b, "x")]
            truth.add((k, k + 1))
            k += 2
    return out, truth


SCHEMA = "sent_id long, book_slug string, unit_id string, side string, pos int, lang string, sent_text string, pairs string"


def test_operator(spark, tmp_path, monkeypatch):
    data, truth = rows()
    extra = [(9001, "b", "only", "source", 1, "en", "Alone.", "x"), (9002, None, None, "source", 1, None, "Today Mizu sees 7.", "x"), (9003, None, None, "target", 1, None, "Heute sieht Mizu 7.", "x"), (9004, "b", "u0", "source", 9, "en", None, "x"), data[0]]
    df = spark.createDataFrame(data + extra, SCHEMA)
    df.write.parquet(f"{tmp_path}/sentences.parquet")
    got = {(r.sent_id_a, r.sent_id_b) for r in A.p3_found(spark, str(tmp_path)).collect()}
    assert got == truth | {(9002, 9003)}
    monkeypatch.setattr(A, "LONG", 3)
    units = A.bilingual_units(df, "book_slug", "unit_id", "sent_id", "side", "pos", "lang", "sent_text")
    assert units.where("u = 'u1'").count() == 3 and units.where("u = 'u1'").selectExpr("sum(size(src))").first()[0] == 8
    assert A.align_units(units.limit(0)).count() == 0


def test_long_unit_with_omission_and_moves(spark, monkeypatch):
    rnd, data, truth = random.Random(3), [], set()
    target = []
    for k in range(120):
        a, b = both(rnd.sample(sorted(WORDS), 4))
        data.append((k, "b", None, "source", k + 1, "en", f"{a[:-1]} {5000 + k}.", "x"))
        if k >= 50:  # the translation omits the first 50
            target.append((k, f"{b[:-1]} {5000 + k}."))
    target.append(target.pop(5))  # moved from the begin to the end, across all sections
    for j, (k, b) in enumerate(target):
        data.append((1000 + k, "b", None, "target", j + 1, "de", b, "x"))
        truth.add((k, 1000 + k))
    monkeypatch.setattr(A, "LONG", 10)
    units = A.bilingual_units(spark.createDataFrame(data, SCHEMA), "book_slug", "unit_id", "sent_id", "side", "pos", "lang", "sent_text")
    got = {(p.a, p.b) for r in A.align_units(units).collect() for p in r.pairs}
    assert got == truth


def test_borders_follow_the_chain():
    points = [(5000 + x, 1 + x, 1.0) for x in range(0, 95_000, 7)]
    cuts = A.section_borders(100_000, 95_001, points, A.LONG)
    assert [c[1] for c in cuts[:-1]] == [c[0] for c in cuts[1:]] and cuts[0][0] == 1 and cuts[-1][1] == 100_001 and max(b - a for a, b, _, _ in cuts) <= A.LONG
    for i in range(5000, 100_000, 311):
        (a, b, c, d) = next(x for x in cuts if x[0] <= i < x[1])
        assert c <= i - 4999 < d
    flat = A.section_borders(9000, 9000, [], 2000)
    assert len(flat) == 5 and flat[-1][1] == flat[-1][3] == 9001


def test_anchors_in_other_characters_and_without_counterpart(spark, tmp_path):
    data = rows()[0]
    text = {k: r[6] for r in data for k in [r[0]]}
    spark.createDataFrame([*data, (9001, "b", "u1", "source", 9, "en", "Nobody knows this.", "x")], SCHEMA).write.parquet(f"{tmp_path}/sentences.parquet")
    quotes = {
        1: ("u0", text[0]),
        2: ("u0", text[2].replace("e", "\u0435").replace(" ", "\u2003", 1)),  # Cyrillic letters, another space
        3: ("u0", text[4][:6] + "\u00ad" + text[4][6:]),
        4: ("u0", text[6][-12:] + "\n" + text[8][:12]),  # over two sentences
        5: ("u0", "not there"),
        6: ("u1", "Nobody knows"),
        7: ("alone", "in a unit of one language"),
    }
    findings = spark.createDataFrame([(k, "b", u, (q, 0)) for k, (u, q) in quotes.items()] + [(8, "b", "u0", ("", 0)), (9, "b", "u0", None)], "finding_key long, book_slug string, unit_id string, source_anchor struct<quote:string,occurrence:int>")
    findings.unionByName(findings.limit(1)).write.parquet(f"{tmp_path}/findings.parquet")
    got = sorted((tuple(r) for r in A.p3_anchors(spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, 0, 1, text[1]), (2, 2, 3, text[3]), (3, 4, 5, text[5]), (4, 6, 7, text[7]), (4, 8, 9, text[9]), (5, None, None, None), (6, 9001, None, None), (7, None, None, None)]


def test_target_in_two_sections_keeps_the_better_one(spark):
    side = lambda *ids: [(k, str(k)) for k in ids]
    data = [(None, "u", 0, "en", "de", side(1, 2, 3, 4), side(11, 12), [(1, 11, 0.5), (4, 12, 0.6)]), (None, "u", 1, "en", "de", side(5, 6), side(11, 12), [(5, 11, 0.9), (5, 12, 0.8)])]
    df = spark.createDataFrame(data, f"{A._UNIT}, pairs {A._PAIRS}")
    assert sorted((r.sec, p.a, p.b) for r in A._settled(df).collect() for p in r.pairs) == [(0, 4, 12), (1, 5, 11), (1, 5, 12)]


def across(spark, sections, words=WORDS):
    """Pairs across sections of one unit; ``sections`` have source and target sentences by id, and pairs."""
    data = [(None, "u", k, "en", "de", list(src.items()), list(tgt.items()), pairs) for k, (src, tgt, pairs) in enumerate(sections)]
    lexicon = spark.createDataFrame([("en", "de", a, b, 0.9) for a, b in words.items()], "ls string, lt string, w string, v string, d double")
    got = [(p.a, p.b) for r in A._across(spark.createDataFrame(data, f"{A._UNIT}, pairs {A._PAIRS}"), lexicon, {}).collect() for p in r.pairs]
    assert len(got) == len(set(got))
    return set(got)


def test_across_without_rare_words(spark, monkeypatch):
    s = dict(enumerate(both(x) for x in itertools.combinations(sorted(WORDS), 4)))  # 210, each word in 84 of them
    half = lambda side, low, high: {1000 * side + k: s[k][side] for k in range(low, high)}
    sections = [(half(0, 0, 100), half(1, 100, 210), []), (half(0, 100, 210), half(1, 0, 100), [])]
    monkeypatch.setattr(A, "BLOCK", 60, raising=False)
    assert across(spark, sections) == {(k, 1000 + k) for k in s}


def test_across_pairs_all_parts(spark):
    words = {f"{c}ol": f"un{c}a" for c in "bdfghklmnprstvae"}
    a, b, c, d = itertools.batched(words.items(), 4)
    part = lambda x, side: " ".join(w[side] for w in x).capitalize() + "."
    whole = lambda x, y, side: part(x + y, side)
    source = {1: whole(a, b, 0), 2: "He went.", 3: part(c, 0), 4: part(d, 0)}
    target = {11: whole(c, d, 1), 12: "Er ging.", 13: part(a, 1), 14: part(b, 1)}
    first, second = ({k: x for k, x in side.items() if k % 10 < 3} for side in (source, target))
    rest = [{k: x for k, x in side.items() if k % 10 > 2} for side in (source, target)]
    assert across(spark, [(first, second, [(2, 12, 0.5)]), (*rest, [])], words) == {(1, 13), (1, 14), (3, 11), (4, 11)}
    # A part whose other part was paired in its section.
    assert across(spark, [(first, rest[1], [(1, 13, 0.6)]), (rest[0], second, [(3, 11, 0.6)])], words) == {(1, 14), (4, 11)}


def test_meeting_against_brute_force():
    rnd = random.Random(11)
    lex = {**{a: {b: 0.8, "boot": 0.3} for a, b in list(WORDS.items())[:6]}, "moskva": {"москва": 0.5}}
    said = ["nation", "nationen", "Nation", "moskva", "Moskva", "Anna", "anna", "17", "1,7", "to", "the", "tree", "nature", *WORDS]
    heard = ["nation", "nationale", "National", "Nation", "москва", "Москва", "anna", "Анна", "Anna", "17", "to", "der", "tree", "Tree", *WORDS.values()]
    common = {"en": frozenset({"the"}), "de": frozenset({"der"})}
    for _ in range(30):
        source, target = [[" ".join(rnd.choice(ws) for _ in range(rnd.randint(0, 6))) for _ in range(25)] for ws in (said, heard)]
        lexica = [{w: lex[w] for w in A.tokens(t) if w in lex} for t in source]
        entries = [[{"w": w, "v": v, "d": d} for w, x in e.items() for v, d in x.items()] for e in lexica]
        bounds, truth, one = A.Meeting(source, lex, (common["en"], common["de"])), {}, range(1)
        for j, t in enumerate(target):
            most = bounds.bounds(t)
            for i, x in enumerate(source):
                u = A.Unit([x], [t], lexica[i], (common["en"], common["de"]))
                s = max(u.one(0, 0), 0.75 * max(u.covered(0, 0, one), u.covered(1, 0, one)))
                assert s <= most[i] + 1e-9, (x, t)
                if s >= A.LOOSE:
                    truth[i, j] = s
        frames = [pd.DataFrame({"g": "u", "ls": "en", "lt": "de", "id": range(25), "text": texts, "lex": entries}) for texts in (source, target)]
        got = {(r.x, r.y): r.score for r in A._meet(common)(*frames).itertuples()}
        assert got == truth and truth


def naive_gap(unit, n, m):
    """The best beads by trying every one that ends at every place, one by one."""
    best = {(0, 0): (0.0, None)}
    for i in range(n + 1):
        for j in range(m + 1):
            top = best.get((i, j), (-1.0, None))
            for before in ((i - 1, j), (i, j - 1)):
                if before in best and best[before][0] > top[0]:
                    top = (best[before][0], (*before, False))
            for a, b in A.BEADS if unit.lexicon is not None else A.BEADS[:3]:
                if (i - a, j - b) not in best:
                    continue
                rows, cols = range(i - a, i), range(j - b, j)
                if unit.lexicon is not None and (not unit.parts_covered(rows, cols) if a * b > 1 else (rows[0], cols[0]) not in unit.cells and unit.unknown[rows[0]] < A.STRANGE):
                    continue
                s = (unit.score(rows, cols) - A.FLOOR) * (a + b) / 2 - A.MERGE * (a + b - 2)
                if s > 0 and best[i - a, j - b][0] + s > top[0]:
                    top = (best[i - a, j - b][0] + s, (i - a, j - b, True))
            best[i, j] = top
    return best[n, m][0]


def worth(unit, beads):
    return sum((unit.score(r, c) - A.FLOOR) * (len(r) + len(c)) / 2 - A.MERGE * (len(r) + len(c) - 2) for r, c, _ in beads)


def test_gap_against_brute_force(monkeypatch):
    rnd = random.Random(9)
    names = ["mizu", "17", "18", "kapitan"]
    for cells in (1, 7, 1 << 16):  # whatever the rows worked out at a time
        monkeypatch.setattr(A, "CELLS", cells)
        for _ in range(60):
            source, target = [], []
            for _ in range(rnd.randint(0, 6)):
                words = rnd.sample(sorted(WORDS), rnd.randint(0, 4)) + rnd.sample(names, rnd.randint(0, 1))
                source.append(" ".join(words))
                kept = [WORDS.get(w, w) for w in words if rnd.random() < 0.8]
                if target and rnd.random() < 0.3:
                    target[-1] += " " + " ".join(kept)
                elif rnd.random() < 0.9:
                    target.append(" ".join(kept))
            for lexicon in (None, LEX, {k: LEX[k] for k in sorted(LEX)[:4]}):
                unit = A.Unit(source, target, lexicon)
                beads = A._gap(unit, 0, len(source), 0, len(target))
                assert abs(worth(unit, beads) - naive_gap(unit, len(source), len(target))) < 1e-9
                assert all(a[0].stop <= b[0].start and a[1].stop <= b[1].start for a, b in zip(beads, beads[1:]))


def test_counts_of_pairs_and_lexicon(spark):
    """What a round learns is what counting by hand gives."""
    data = [("en", "de", [("the cat sees", "katze sieht"), ("the cat buys", "katze kauft"), ("the dog sees", "hund sieht")]), ("en", "fr", [("cat", "chat"), ("cat", "chat")])]
    rows = [("b", f"u{i}", 0, ls, lt, [(10 * k, s) for k, (s, _) in enumerate(p)], [(10 * k + 1, t) for k, (_, t) in enumerate(p)], None) for i, (ls, lt, p) in enumerate(data)]
    df = spark.createDataFrame(rows, f"{A._UNIT}, lex array<struct<w:string,v:string,d:double>>")
    counts = {(r.ls, r.lt, r.w, r.v): r.n for r in df.mapInArrow(A._learner({"en": frozenset(["the"])}, True), A._COUNTS).collect()}
    assert counts["en", "fr", "cat", "chat"] == 2 and counts["en", "fr", "cat", None] == 2 and not any(k[2] == "the" for k in counts)
    made = spark.createDataFrame([(*k, n) for k, n in [(("a", "b", "w", "v"), 8), (("a", "b", "w", "x"), 1), (("a", "b", "u", "v"), 2), (("a", "b", "w", None), 10), (("a", "b", "u", None), 2), (("a", "b", None, "v"), 10), (("a", "b", None, "x"), 1)]], A._COUNTS)
    got = {(r.w, r.v): round(r.d, 4) for r in A.lexicon_of(made).collect()}
    assert got == {("w", "v"): 0.8}  # u and v: 2 * 2 / 12, less than half of what v has; w and x: seen once
