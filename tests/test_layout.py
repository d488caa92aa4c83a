import io
import zipfile

from pyspark.sql import functions as F

from corpusflow.sources import layout as L

PNG = b"\x89PNG data"


def book(change=None, order=("toc", "c1", "art", "c2")):
    head = f'<html xmlns="{L.XHTML}"><head><title>x</title></head><body>'
    files = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
        "O/toc.xhtml": head + '<h1>Contents</h1><p><a href="c1.xhtml">First</a></p><p><a href="c2.xhtml#x">Second</a></p></body></html>',
        "O/c1.xhtml": head + '<div class="w"><h2 id="a">One</h2><p class="i">A <em>slow</em> day</p><blockquote><p>Said</p></blockquote></div><p><img src="i.png" alt=""/></p></body></html>',
        "O/art.xhtml": head + '<div><img src="i.png"/></div></body></html>',
        "O/c2.xhtml": head + "<p>Two</p><ul><li>x</li><li>y <img src='https://a.b/c.png'/></li></ul></body></html>",
        "O/i.png": PNG,
        "O/s.css": "p {}",
    } | (change or {})
    items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ("toc", "c1", "art", "c2"))
    files["O/p.opf"] = f'<package xmlns:dc="d"><dc:title>T</dc:title><dc:language>en</dc:language><manifest>{items}<item id="i" href="i.png" media-type="image/png"/></manifest><spine>{"".join(f"<itemref idref={chr(34)}{s}{chr(34)}/>" for s in order)}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            if t is not None:
                z.writestr(n, t)
    return out.getvalue()


def test_inventory():
    found = L.inventory(book())
    assert found["status"] == "ok" and [d[1] for d in found["documents"]] == ["contents", "text", "artwork", "text"] and [d[2] for d in found["documents"]] == ["Contents", "First", "art", "Second"]
    assert found["documents"][1][3:5] == (["One", "A slow day", "Said"], ["O/i.png"]) and found["documents"][3][3:5] == (["Two", "x", "y"], ["https://a.b/c.png"])
    for change in ({"O/c1.xhtml": "<html><body>loose<p>x</p></body></html>"}, {"O/i.png": None}, {"O/c1.xhtml": "<html><body/></html>"}, {"O/c1.xhtml": "<html>"}, {"O/extra.xhtml": "<html><body><p>text</p></body></html>"}):
        assert L.inventory(book(change))["status"] == "blocked", change
    assert L.inventory(book(order=("c1", "c2")))["status"] == "ok" and L.inventory(b"no")["status"] == "blocked"


def test_exchange_keeps_all_else():
    data = book()
    new = L.exchanged(data, {"O/c1.xhtml": ["Eins", "Ein *langsamer* & **langer** \\*Tag", "Sagte"]})
    assert new == L.exchanged(data, {"O/c1.xhtml": ["Eins", "Ein *langsamer* & **langer** \\*Tag", "Sagte"]}) and L.layout_faults(data, new) == []
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        text = z.read("O/c1.xhtml").decode()
        assert z.namelist()[0] == "mimetype" and z.read("O/i.png") == PNG and '<p class="i">Ein <em>langsamer</em> &amp; <strong>langer</strong> *Tag</p>' in text and '<h2 id="a">Eins</h2>' in text
    assert L.inventory(new)["documents"][1][3] == ["Eins", "Ein langsamer & langer *Tag", "Sagte"]
    same = L.exchanged(data, {"O/c2.xhtml": ["Zwei", "x", "y"]})
    assert L.layout_faults(data, same) == []
    for texts in ({"O/c1.xhtml": ["one"]}, {"O/art.xhtml": []}, {"O/c2.xhtml": ["Two", "x", "changed"]}):
        try:
            L.exchanged(data, texts)
        except ValueError:
            continue
        raise AssertionError(texts)
    assert L.layout_faults(data, book({"O/i.png": b"other"})) == ["O/i.png changed"] and L.layout_faults(data, book({"O/c2.xhtml": f'<html xmlns="{L.XHTML}"><body><p>Two</p></body></html>'})) == ["O/c2.xhtml lost its form"]
    assert L.layout_faults(data, book({"O/s.css": None})) == ["files"] and L.layout_faults(data, b"x")[0].startswith("not readable")


def test_images():
    assert [L.safe_image_url(u) for u in ("https://a.b/c.png", "http://u@a.b/c", "javascript:x", "//a.b/c", "https://a/b", 'https://a.b/"')] == [True, False, False, False, False, False]
    svg = lambda inner: f'<svg xmlns="http://www.w3.org/2000/svg">{inner}</svg>'.encode()
    assert L.static_svg(svg('<path d="M0"/><use href="#a"/>')) and not any(map(L.static_svg, (svg("<script/>"), svg('<path onload="x"/>'), svg('<use href="http://x"/>'), b"<svg")))


def test_operators(spark):
    df = spark.createDataFrame([("a", book()), ("b", b"no"), ("c", None)], "book string, content binary")
    rows = L.layout(df, "book", "content").collect()
    assert sorted((r.book, r.status, r.pos, r.kind) for r in rows if r.book == "a") == [("a", "ok", 0, "contents"), ("a", "ok", 1, "text"), ("a", "ok", 2, "artwork"), ("a", "ok", 3, "text")]
    assert {r.book: r.status for r in rows if r.book != "a"} == {"b": "blocked", "c": None}
    texts = spark.createDataFrame([("a", "O/c1.xhtml", ["x", "y", "z"])], "book string, path string, blocks array<string>")
    got = {r.book: r for r in L.rebuild(df, texts, "book", "content").collect()}
    assert got["a"].fault is None and got["b"].epub is None and "EPUB" in got["b"].fault
    back = L.layout(spark.createDataFrame([("a", bytes(got["a"].epub))], "book string, content binary"), "book", "content").where(F.col("pos") == 1).first()
    assert back.blocks == ["x", "y", "z"]
