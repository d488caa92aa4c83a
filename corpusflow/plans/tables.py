"""The tables as the queries see them: exact repetitions of rows once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import table


def chapters(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return table(spark, root, "chapters").select("chapter_id", *[c for c in columns if c != "chapter_id"]).dropDuplicates(["chapter_id"])


def pairs(spark: SparkSession, root: str) -> DataFrame:
    """``translation_key, book_slug, unit_id, source, target``: units that exist in two languages."""
    t = table(spark, root, "translations").select("translation_key", "book_slug", "unit_id", F.col("markdown").alias("target")).dropDuplicates(["translation_key"])
    c = chapters(spark, root, "content").select(F.col("chapter_id").alias("translation_key"), F.col("content").alias("source"))
    return t.join(c, "translation_key")


def findings(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "findings").dropDuplicates(["finding_key"])


def per_quote(spark: SparkSession, root: str, what: Callable[[Column, Column, Column], dict[str, Column]], block: int = 200) -> DataFrame:
    """``finding_key, book_slug, unit_id, chapter_id`` and the columns that ``what`` makes of the content of a finding's unit, its quote
    and its occurrence; findings with a quote, in units with a chapter.

    The quotes of a unit meet its text together, ``block`` at a time, so a text travels once for so many of them, and a unit with any
    number of findings is spread over as many tasks.
    """
    f = findings(spark, root).where("source_anchor.quote <> ''").select("book_slug", "unit_id", F.struct("finding_key", F.col("source_anchor.quote").alias("q"), F.col("source_anchor.occurrence").alias("n")).alias("x"))
    # Units with more than one block are few, whatever the number of findings.
    many = f.groupBy("book_slug", "unit_id").agg(F.count("*").alias("k")).where(F.col("k") > block)
    blocked = f.join(many, ["book_slug", "unit_id"], "left").withColumn("s", F.pmod(F.xxhash64("x.finding_key"), F.ceil(F.coalesce("k", F.lit(1)) / block)))
    lists = blocked.groupBy("book_slug", "unit_id", "s").agg(F.collect_list("x").alias("xs"))
    met = lists.join(chapters(spark, root, "book_slug", "unit_id", "content"), ["book_slug", "unit_id"])
    made = lambda x: F.struct(x["finding_key"].alias("finding_key"), *[c.alias(n) for n, c in what(F.col("content"), x["q"], x["n"]).items()])
    return met.select("book_slug", "unit_id", "chapter_id", F.explode(F.transform("xs", made)).alias("y")).select("book_slug", "unit_id", "chapter_id", "y.*")


def responses(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "translator_responses").dropDuplicates(["response_id"])


def segments(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "structural_segments").dropDuplicates(["segment_key"])


PAIRS_SQL = """SELECT t.translation_key, t.book_slug, t.unit_id, c.content AS source, t.markdown AS target
FROM (SELECT DISTINCT translation_key, book_slug, unit_id, markdown FROM translations) t JOIN (SELECT DISTINCT chapter_id, content FROM chapters) c ON c.chapter_id = t.translation_key"""
WORD = r"[\p{L}\p{N}_]"
