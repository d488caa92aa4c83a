import hashlib
import json
import unicodedata

from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.functions.names import free


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_tokens_words_numbers(spark):
    assert one(spark, "Été, it's 3.5—ok_1 ё", X.tokens) == ["Été", ",", "it", "'", "s", "3", ".", "5", "—", "ok_1", "ё"]
    assert one(spark, "It's Well-known STRASSE Straße _x_", X.words) == ["it's", "well-known", "strasse", "strasse", "x"]
    assert one(spark, "a1 12 3,400 5.6. 7b 8", X.numbers) == ["12", "3,400", "5.6", "8"]
    assert one(spark, None, X.tokens) is None


def test_white_space(spark):
    assert one(spark, " a \t b\r\n c ", X.squeeze_space) == "a b c"
    assert one(spark, "　 x y\n", X.strip) == "x y"
    assert one(spark, unicodedata.normalize("NFD", "é"), X.nfc) == "é"


def test_places(spark):
    df = spark.createDataFrame([("aaa bab", "aa", 0), ("xabxab", "ab", 1), ("xabxab", "ab", 2), ("x", "", 0)], "t string, q string, n int")
    got = [(r.c, r.p) for r in df.select(X.occurrences(F.col("t"), F.col("q")).alias("c"), X.nth_offset(F.col("t"), F.col("q"), F.col("n")).alias("p")).collect()]
    assert got == [(1, 0), (2, 4), (2, None), (0, None)]


def test_slugs_and_ids(spark):
    assert [one(spark, t, X.slugify) for t in ["  Hello, World_again -- ok! ", "Глава 1", "!!!", None]] == ["hello-world-again-ok", "глава-1", "book", None]
    assert one(spark, "a" * 118 + " bcd", X.stable_slug) == "a" * 118 + "-b"
    assert spark.range(7, 8).select(X.unit_id(F.col("id").cast("int"))).first()[0] == "chapter-000007"
    assert free("piece", ["Piece", "piece_"]) == "piece__"


def test_mismatch(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), (["a"], ["a", "b"]), (["a"], ["a"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.mismatch_index(F.col("a"), F.col("b"))).collect()] == [2, 2, None, None]


def test_digest_is_canonical_json(spark):
    row = spark.createDataFrame([(1, None, "ё")], "a int, b string, c string").select(X.digest(F.col("a"), F.col("b"), F.col("c")).alias("d")).first().d
    assert row == hashlib.sha256(json.dumps({"a": 1, "b": None, "c": "ё"}, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def test_times_and_links(spark):
    assert one(spark, "2025-01-02T03:04:05+02:00", lambda c: X.parse_utc(c).cast("long")) == 1735779845
    assert [one(spark, t, X.parse_utc) for t in ["2025-01-02", "2025-01-02T03:04:05", None]] == [None] * 3
    assert [one(spark, t, X.external_links_only) for t in ["[a](https://x.y) [b](http://z)", "[a](#x)", "![a](https://x.y)", "text [a](https://x.y)", ""]] == [True, False, False, False, False]
    assert [one(spark, t, X.external_href) for t in ["https://a.b/(c)", "www.a.com/x", "a/b.html"]] == ["https://a.b/%28c%29", "https://www.a.com/x", None]
