import hashlib
import random
import re

from pyspark.sql import functions as F

from corpusflow.operators import edits as E
from corpusflow.plans import edits as plans
from corpusflow.sinks import books
from corpusflow.sources.files import read_epub

PATCH = "t string, p array<struct<quote:string,occurrence:int,replacement:string>>"


def test_patches(spark):
    rows = [("a b a c", [("a", 1, "X"), ("b", 0, "YY")]), ("abc", [("ab", 0, "x"), ("bc", 0, "y")]), ("abc", [("z", 0, "y")]), ("abc", []), (None, [("a", 0, "b")])]
    got = [r.x for r in spark.createDataFrame(rows, PATCH).select(E.apply_patches(F.col("t"), F.col("p")).alias("x")).collect()]
    assert got == ["a YY X c", None, None, "abc", None]


def replaced(text, quotes):
    """By brute force: the characters of every place are marked, and each stretch of places that overlap is replaced."""
    places = []
    for q, n in quotes:
        at = [m.start() for m in re.finditer(re.escape(q), text)]
        if n < len(at):
            places.append((at[n], at[n] + len(q)))
    joined = {k for lo, hi in places for k in range(lo + 1, hi)}  # no cut before these characters
    inside = {k for lo, hi in places for k in range(lo, hi)}
    out = "".join("" if k in joined else "[…]" if k in inside else c for k, c in enumerate(text))
    return out, len(places)


def test_all_places_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ab \\E") for _ in range(n))
    rows = [(i, word(rnd.randint(0, 25)), [(word(rnd.randint(1, 4)), rnd.randint(0, 2)) for _ in range(rnd.randint(0, 6))]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, t string, p array<struct<quote:string,occurrence:int>>")
    got = {r.i: tuple(r.x) for r in df.select("i", E.replace_places(F.col("t"), F.col("p"), F.lit("[…]")).alias("x")).collect()}
    assert got == {i: replaced(t, p) for i, t, p in rows}


def test_chapter_with_several_findings(spark, tmp_path):
    text = {1: "The old cat sees the red boat.", 2: "Only one here.", 3: "Nothing here.", 4: None}
    spark.createDataFrame([(k, "b", f"u{k}", t) for k, t in text.items()], "chapter_id long, book_slug string, unit_id string, content string").write.parquet(f"{tmp_path}/chapters.parquet")
    quotes = [(1, "u1", "lost"), (2, "u1", "old cat"), (3, "u1", "cat sees"), (4, "u1", "boat"), (5, "u2", "one"), (6, "u3", "lost"), (7, "u4", "x"), (8, "u1", "")]
    found = spark.createDataFrame([(k, "b", u, (q, 0)) for k, u, q in quotes], "finding_key long, book_slug string, unit_id string, source_anchor struct<quote:string,occurrence:int>")
    found.unionByName(found).write.parquet(f"{tmp_path}/findings.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {tuple(r) for r in plans.fully_patched_chapters(spark, str(tmp_path)).collect()}
    assert got == {(1, 4, 3, sha("The […] the red […].")), (2, 1, 1, sha("Only […] here."))}


def test_masks():
    rnd = random.Random(1)
    for _ in range(100):
        text = "".join(rnd.choice(["word ", "[a](x)", "![i](y z)", "[b](<u v>)", "\n", "[no link] "]) for _ in range(rnd.randint(0, 8)))
        masked, links = E.mask(text)
        assert E.unmask(masked, links) == text
    assert E.unmask("⟦2⟧a⟦/2⟧", ["](x)"]) is None and E.unmask("lost", ["](x)"]) is None


def test_fuzzy(spark):
    assert [x for x, _ in E.near_lines("The old cat\nThe old car\nNothing alike 123\n", "The old cat!")] == ["The old cat", "The old car"]
    df = spark.createDataFrame([("The history of the old bridge", "The history of the old bridges"), ("Short", "Short"), (None, "x")], "a string, b string")
    assert [r.r for r in df.select(E.related_titles("a", "b").alias("r")).collect()] == [True, False, None]


def test_selectors_and_answers(spark):
    df = spark.createDataFrame([("3",), ("2-3",), ("3-2",), ("x",), (None,)], "s string")
    assert [r.u for r in df.select(E.selected_units(F.col("s")).alias("u")).collect()] == [["chapter-000003"], ["chapter-000002", "chapter-000003"], None, None, None]
    a = ['```json\n{"segments":[{"id":"b","translation":"x"},{"id":"a","translation":"y"}]}\n```', '{"segments":[{"id":"a","translation":" "},{"id":"b","translation":"y"}]}', "no json", '{"segments":[{"id":"a","translation":"x"}]}']
    got = [r.m for r in spark.createDataFrame([(x, ["a", "b"]) for x in a], "t string, e array<string>").select(E.parsed_batch(F.col("t"), F.col("e")).alias("m")).collect()]
    assert got == [{"a": "y", "b": "x"}, None, None, None]


def test_ranges_against_all_pairs(spark):
    rnd = random.Random(2)
    points = [(rnd.choice("ab"), rnd.randint(0, 60), i) for i in range(80)]
    ranges = [(rnd.choice("ab"), lo := rnd.randint(0, 50), lo + rnd.randint(0, 25), i) for i in range(30)]
    p, r = spark.createDataFrame(points, "k string, at int, i int"), spark.createDataFrame(ranges, "k string, lo int, hi int, j int")
    want = {(i, j) for k, at, i in points for kk, lo, hi, j in ranges if k == kk and lo <= at < hi}
    got = [(x.i, x.j) for x in E.in_ranges(p, r, ["k"], "at", "lo", "hi", 7).collect()]
    assert set(got) == want and len(got) == len(want)


def test_plain_and_lines(spark):
    df = spark.createDataFrame([("# Head\n\n- item *x*\n[l](u) \\*kept\\*",)], "t string")
    assert df.select(E.plain_prose(F.col("t")).alias("x")).first().x == "Head\n\nitem x\nl *kept*"
    one = spark.createDataFrame([("a\nb\nc", "b", "X")], "t string, o string, n string")
    row = one.select(E.line_range(F.col("t"), F.lit(2), F.lit(3)).alias("l"), E.replace_expected(F.col("t"), F.col("o"), F.col("n"), F.lit(1)).alias("r"), E.replace_expected(F.col("t"), F.col("o"), F.col("n"), F.lit(2)).alias("z")).first()
    assert tuple(row) == ("b\nc", "a\nX\nc", None)


def test_books(spark, tmp_path):
    units = [("b", i, f"T {i}", f"# T {i}\n\nText *it* & **b** [x](https://y.z)\n\n* * *\n\n- one\n- two") for i in (2, 1)] + [("c", 1, None, None)]
    df = spark.createDataFrame(units, "book string, n int, t string, c string")
    made = {r.book: r for r in books.epubs(df, "book", "n", "t", "c").collect()}
    back = read_epub(bytes(made["b"].epub))
    assert [d[1] for d in back["documents"]] == ["unit-000001", "unit-000002"] and made["c"].n_units == 1
    assert "<h1>T 1</h1><p>Text <em>it</em> &amp; <strong>b</strong> <a href=\"https://y.z\">x</a></p><hr/><ul><li>one</li><li>two</li></ul>" in back["documents"][0][3]
    assert books.epub_bytes("i", "t", "en", [("a", "b")]) == books.epub_bytes("i", "t", "en", [("a", "b")])
    books.write_markdown(df, f"{tmp_path}/md", "book", "n", "c")
    text = "".join(p.read_text() for p in sorted((tmp_path / "md" / "book=b").glob("*.txt")))
    assert text.index("# T 1") < text.index("# T 2") and not (tmp_path / "md" / "book=c").exists()
    books.write_units(df, f"{tmp_path}/units", "book")
    assert spark.read.parquet(f"{tmp_path}/units").count() == 3


def test_markdown_blocks():
    text = "# A\nplain *x*\nmore\n1. one\n2) two\n* a\n- b\n```py\n<x> *no*\n\n```\n<!-- bt-anchor:n1 -->\n[up](#n1) [out](https://a.b)\n***\n"
    body = books.markdown_xhtml("T", text, strict=True).split("<body>")[1]
    assert body.startswith('<h1>A</h1><p>plain <em>x</em><br/>more</p><ol><li>one</li><li>two</li></ol><ul><li>a</li><li>b</li></ul><pre><code>&lt;x&gt; *no*\n</code></pre><span id="n1"></span><p><a href="#n1">up</a> <a href="https://a.b">out</a></p><hr/>')
    for bad in ("```\nx", "[a](javascript:x)", "[a](#nowhere)", "<!-- bt-anchor:n -->\n<!-- bt-anchor:n -->\n[a](#n)"):
        assert "<body>" in books.markdown_xhtml("T", bad)
        try:
            books.markdown_xhtml("T", bad, strict=True)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_archives_are_checked(spark):
    import io
    import zipfile

    good = books.epub_bytes("i", "t", "en", [("a", "text"), ("b", "more")])
    assert books.archive_faults(good, 2) == [] and books.archive_faults(good, 3) == ["2 units instead of 3"] and books.archive_faults(b"x", 1) == ["no archive"]

    def changed(name, by):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(good)) as a, zipfile.ZipFile(out, "w") as b:
            for x in a.namelist():
                if x != name or by is not None:
                    b.writestr(x, by if x == name else a.read(x))
        return out.getvalue()

    assert books.archive_faults(changed("OEBPS/unit-000001.xhtml", b"<html><body> </body></html>"), 2) == ["unit-000001 is empty"]
    assert books.archive_faults(changed("OEBPS/unit-000001.xhtml", b"<html>"), 2) == ["unit-000001 is no XHTML"]
    assert books.archive_faults(changed("OEBPS/unit-000002.xhtml", None), 2) == ["OEBPS/unit-000002.xhtml is missing"]
    assert books.archive_faults(changed("mimetype", b"x"), 2) == ["mimetype"] and books.archive_faults(changed("OEBPS/nav.xhtml", b"<ol/>"), 2) == ["contents"]


def test_spine_and_fingerprints(spark):
    from corpusflow.sources import files

    data = books.epub_bytes("i", "t", "en", [("a", "# One\n\ntext " + "word " * 200), ("b", "More"), ("c", "more")])
    df = spark.createDataFrame([("x", data), ("y", b"no"), ("z", None)], "path string, content binary")
    rows = files.spine(df).orderBy("pos").collect()
    assert [(r.pos, r.n_blocks, r.first_tag, r.has_image) for r in rows] == [(0, 2, "h1", False), (1, 1, "p", False), (2, 1, "p", False)] and rows[1].sha256 == rows[2].sha256 != rows[0].sha256
    one = files.fingerprints(files.spine(df)).first()
    assert (one.n_documents, one.digests, one.first) == (3, [r.sha256 for r in rows], rows[0].sha256) and files.fingerprints(files.spine(df), most=2).first().digests is None
    names = spark.createDataFrame([("a.epub", data), ("a.epub", b"no"), ("b.MD", b""), ("c.pdf", b""), (None, None)], "p string, c binary")
    assert [r.f for r in names.select(files.probed_format("p", "c").alias("f")).collect()] == ["epub", None, "markdown", None, None]
