import io
import zipfile

from pyspark.sql import functions as F

from corpusflow.control import Conflict, Store
from corpusflow.sources import files, markup


def test_blocks():
    html = '<html><head><title>x</title></head><body><nav>skip</nav><h1>One</h1><p id="n1">A <em>b</em> *c* <a href="#n1">up</a><br>next</p><hr><ul><li>item</li></ul>tail</body></html>'
    assert markup.html_blocks(html, True, "d/a.xhtml") == [("h1", "One"), ("anchor", "<!-- bt-anchor:n1 -->"), ("p", "A *b* \\*c\\* [up](#n1)\nnext"), ("hr", markup.SCENE), ("li", "item"), ("text", "tail")]
    for bad in ("<p><table></table></p>", "<p><em>x</p><p></em></p>", '<p><a href="other.html#x">y</a></p>', "<p>x</em></p>"):
        try:
            markup.html_blocks(bad)
        except markup.Blocked:
            continue
        raise AssertionError(bad)
    assert markup.html_blocks("") == [] and markup.html_blocks("<p>[x](y)</p>") == [("p", "\\[x\\](y)")]


def test_sections(spark):
    df = spark.createDataFrame([("intro\n# A\na\n## sub\n# B\nb",), ("no heading",), ("## A\n1\n## B\n2",), ("",)], "t string")
    got = [[(s.title, s.content) for s in r.s] for r in df.select(markup.markdown_sections(F.col("t"), F.lit("T")).alias("s")).collect()]
    assert got == [[("T — front matter", "intro\n"), ("A", "# A\na\n## sub\n"), ("B", "# B\nb\n")], [("T", "no heading\n")], [("A", "## A\n1\n"), ("B", "## B\n2\n")], [("T", "\n")]]
    txt = spark.createDataFrame([("front\nChapter 1\na\nГлава II. Ночь\nb",), ("Chapter one",)], "t string")
    got = [[(s.title, s.content) for s in r.s] for r in txt.select(markup.text_sections(F.col("t"), F.lit("T")).alias("s")).collect()]
    assert got == [[("T — front matter", "front\n"), ("Chapter 1", "Chapter 1\na\n"), ("Глава II. Ночь", "Глава II. Ночь\nb\n")], [("T", "Chapter one\n")]]


def test_structure_round_trip(spark):
    texts = ["a [l](x) b", "  x  ", "", "<!-- bt-block:000001 -->\np ![i](y)", None, "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", markup.structure_parts("t"))
    rows = df.select("t", "p", markup.rendered(F.col("p")).alias("back")).collect()
    assert all(r.back == r.t for r in rows)
    assert [(p.kind, p.id) for p in rows[0].p] == [("text", "s00001"), ("link", None), ("text", "s00002")] and [p.kind for p in rows[3].p] == ["epub_marker", "text", "link"]


def test_markers(spark):
    df = spark.createDataFrame([(["a", "b\n\nc"],), (["x"],)], "b array<string>").withColumn("t", markup.numbered_blocks(F.col("b")))
    assert [[x.text for x in r.m] for r in df.select(markup.marked_blocks(F.col("t")).alias("m")).collect()] == [["a", "b\n\nc"], ["x"]]
    broken = spark.createDataFrame([("<!-- bt-block:000002 -->\nx",)], "t string")
    assert broken.select(markup.marked_blocks(F.col("t")).alias("m")).first().m is None


def book(spine=("c1", "nav", "c2"), drop=None):
    out = io.BytesIO()
    items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"{" properties=" + chr(34) + "nav" + chr(34) if i == "nav" else ""}/>' for i in ("c1", "nav", "c2"))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", f'<package xmlns:dc="d"><dc:title>T</dc:title><dc:creator>A</dc:creator><manifest>{items}</manifest><spine>{"".join(f"<itemref idref={chr(34)}{s}{chr(34)}/>" for s in spine)}</spine></package>')
        for i in ("c1", "nav", "c2"):
            if i != drop:
                z.writestr(f"O/{i}.xhtml", f"<html><body><h1>{i}</h1><p>Text {i}</p></body></html>")
    return out.getvalue()


def test_epub():
    e = files.read_epub(book())
    assert (e["status"], e["title"], e["author"], [d[1] for d in e["documents"]]) == ("ok", "T", "A", ["c1", "c2"])
    assert files.read_epub(book(spine=("c1", "zz")))["status"] == "blocked" and files.read_epub(book(drop="c2"))["reason"].endswith("missing") and files.read_epub(b"no zip")["status"] == "blocked"


def test_charsets():
    assert [files.decode_bytes(b) for b in ("ё".encode(), "﻿x".encode(), "ё".encode("utf-16"), "Привет!".encode("cp1251"))] == ["ё", "x", "ё", "Привет!"]


def test_extract(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a-book.epub").write_bytes(book())
    (tmp_path / "sub" / "b.md").write_text("# A\nx\n# B\ny\n")
    (tmp_path / "c.txt").write_text("only text")
    (tmp_path / "d.html").write_text("<p>one</p>")
    (tmp_path / "e.html").write_text("<table></table>")
    (tmp_path / "f.pdf").write_text("x")
    found = files.read_files(spark, str(tmp_path))
    rows = files.extract_units(found).orderBy("path", "place").collect()
    got = [(r.path.rsplit("/", 1)[-1], r.status, r.title, r.content) for r in rows]
    assert got == [
        ("a-book.epub", "ok", "c1", "# c1\n\nText c1\n"), ("a-book.epub", "ok", "c2", "# c2\n\nText c2\n"), ("c.txt", "ok", "c", "only text\n"), ("d.html", "ok", "d", "one\n"),
        ("e.html", "blocked", None, None), ("f.pdf", "blocked", None, None), ("b.md", "ok", "A", "# A\nx\n"), ("b.md", "ok", "B", "# B\ny\n"),
    ]


def test_store(tmp_path):
    s = Store(str(tmp_path))
    v = s.create("a/b.json", b"1")
    assert s.read("a/b.json") == (b"1", v) and s.read("x") is None and s.list() == ["a/b.json"] and s.list("z") == []
    for wrong in (lambda: s.create("a/b.json", b"2"), lambda: s.replace("a/b.json", b"2", "0"), lambda: s.delete("a/b.json", "0")):
        try:
            wrong()
        except Conflict:
            continue
        raise AssertionError
    s.delete("a/b.json", s.replace("a/b.json", b"2", v))
    assert s.list() == []
    try:
        s.read("../out")
    except ValueError:
        return
    raise AssertionError
