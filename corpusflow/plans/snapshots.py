"""Queries of problem 2, what changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.snapshots import snapshot_changes, text_hash, validity_intervals
from corpusflow.session import table

BY = {"group": "book_slug", "snapshot": "revision_id", "key": "unit_id", "latest": ("delivered_at", "created_at")}


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "source_revisions")
    changes = snapshot_changes(rows, row_hash=text_hash(F.col("title"), F.col("content")), **BY)
    return changes.select("book_slug", F.col("from_snapshot").alias("from_revision"), F.col("to_snapshot").alias("to_revision"), "unit_id", "change_kind")


def p2_validity(spark: SparkSession, root: str) -> DataFrame:
    """Each unit's versions with the revisions in which they hold."""
    rows = table(spark, root, "source_revisions")
    spans = validity_intervals(rows, row_hash=text_hash(F.col("title"), F.col("content")), **BY)
    return spans.select(
        "book_slug", "unit_id", F.col("from_snapshot").alias("valid_from"), F.col("to_snapshot").alias("valid_to"), (F.col("to_ix") - F.col("from_ix") + 1).alias("n_snapshots")
    )


def p2_summary(spark: SparkSession, root: str) -> DataFrame:
    return p2_found(spark, root).groupBy("book_slug", "from_revision", "to_revision").agg(
        *[F.count_if(F.col("change_kind") == k).alias(f"n_{k}") for k in ("added", "removed", "changed")]
    )


QUERIES = {"p2_found": p2_found, "p2_validity": p2_validity, "p2_summary": p2_summary}

_NORM = r"trim(regexp_replace(nfc_normalize(coalesce({}, '')), '[\s\p{{Z}}\x85\x0b\x1c-\x1f]+', ' ', 'g'))"
_LATEST = f"""
WITH one AS (
  SELECT book_slug, revision_id, unit_id, {_NORM.format("title")} AS t, {_NORM.format("content")} AS c
  FROM source_revisions WHERE revision_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY book_slug, revision_id, unit_id ORDER BY delivered_at DESC NULLS LAST, created_at DESC NULLS LAST) = 1
), revs AS (
  SELECT book_slug, revision_id, lead(revision_id) OVER (PARTITION BY book_slug ORDER BY revision_id) AS nxt,
         row_number() OVER (PARTITION BY book_slug ORDER BY revision_id) AS ix
  FROM (SELECT DISTINCT book_slug, revision_id FROM one)
)"""
_FOUND = f"""{_LATEST}, pairs AS (
  SELECT r.book_slug, r.revision_id AS from_revision, r.nxt AS to_revision, u.unit_id
  FROM revs r JOIN (SELECT DISTINCT book_slug, unit_id FROM one) u USING (book_slug) WHERE r.nxt IS NOT NULL
)
SELECT * FROM (
  SELECT p.book_slug, p.from_revision, p.to_revision, p.unit_id,
    CASE WHEN a.c IS NULL AND b.c IS NOT NULL THEN 'added' WHEN a.c IS NOT NULL AND b.c IS NULL THEN 'removed'
         WHEN a.c <> b.c OR a.t <> b.t THEN 'changed' END AS change_kind
  FROM pairs p
  LEFT JOIN one a ON a.book_slug = p.book_slug AND a.revision_id = p.from_revision AND a.unit_id = p.unit_id
  LEFT JOIN one b ON b.book_slug = p.book_slug AND b.revision_id = p.to_revision AND b.unit_id = p.unit_id
) WHERE change_kind IS NOT NULL"""

ORACLE = {
    "p2_found": _FOUND,
    "p2_validity": f"""{_LATEST}, placed AS (
  SELECT o.book_slug, o.unit_id, o.revision_id, o.t, o.c, r.ix,
    CASE WHEN lag(r.ix) OVER w = r.ix - 1 AND lag(o.c) OVER w = o.c AND lag(o.t) OVER w = o.t THEN 0 ELSE 1 END AS fresh
  FROM one o JOIN revs r USING (book_slug, revision_id) WINDOW w AS (PARTITION BY o.book_slug, o.unit_id ORDER BY r.ix)
), isl AS (SELECT *, sum(fresh) OVER (PARTITION BY book_slug, unit_id ORDER BY ix) AS island FROM placed)
SELECT book_slug, unit_id, min(revision_id) AS valid_from, max(revision_id) AS valid_to, CAST(count(*) AS INTEGER) AS n_snapshots
FROM isl GROUP BY book_slug, unit_id, island""",
    "p2_summary": f"""SELECT book_slug, from_revision, to_revision, count(*) FILTER (change_kind = 'added') AS n_added,
  count(*) FILTER (change_kind = 'removed') AS n_removed, count(*) FILTER (change_kind = 'changed') AS n_changed
FROM ({_FOUND}) GROUP BY ALL""",
}
