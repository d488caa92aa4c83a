"""Queries over JSON documents: the rows of the tables written as documents of their kinds, and the rules that these break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import documents
from corpusflow.plans.tables import chapters, findings
from corpusflow.session import table


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _broken(df: DataFrame, key: str, kind: str) -> DataFrame:
    """``key, rule``: one row for each rule that a document breaks."""
    return documents.document_errors(df, [key], "doc", kind).select(key, F.explode("errors").alias("rule"))


def progress_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every chapter as the progress document of one unit."""
    c = chapters(spark, root, "book_slug", "unit_id", "chapter_no", "title", "source_path", "translation_path", "status")
    unit = F.struct(F.col("chapter_no").alias("number"), "title", X.slugify(F.col("title")).alias("slug"), "unit_id", "source_path", "translation_path", "status")
    return _broken(c.select("chapter_id", _json("book_slug", F.array(unit).alias("chapters")).alias("doc")), "chapter_id", "progress")


def manifest_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every chapter as the manifest of a source with one entry; chapter numbers are the counts that should be one."""
    c = chapters(spark, root, "unit_id", "chapter_no", "title", "source_format", "source_path", "sha256")
    entry = F.struct(F.col("chapter_no").alias("number"), "unit_id", "title", F.col("source_path").alias("path"), "sha256")
    return _broken(c.select("chapter_id", _json(F.col("source_path").alias("source_file"), "source_format", F.lower("sha256").alias("source_sha256"), F.col("chapter_no").alias("chapter_count"), F.array(entry).alias("extracted")).alias("doc")), "chapter_id", "source_manifest")


def revision_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every unit of a revision as a list of one revision; the unit's number stands for the next one's."""
    r = table(spark, root, "source_revisions").select("book_slug", "revision_id", "unit_id", "chapter_no", "title", "content", "sha256", "created_at").distinct()
    r = r.withColumn("row_key", F.concat_ws("/", "book_slug", "revision_id", "unit_id", F.xxhash64("title", "content", "sha256", "chapter_no").cast("string")))
    one = F.struct(
        "revision_id", F.lit(None).cast("string").alias("parent_revision_id"), F.when(F.col("title").isNull(), "none").otherwise("active").alias("state"), _iso("created_at").alias("created_at"), F.col("title").alias("source_file"), F.lit("epub").alias("source_format"), F.col("sha256").alias("source_sha256"),
        F.lit("embedded").alias("source_storage_mode"), F.length("content").alias("source_size_bytes"), F.concat_ws("/", "book_slug", "revision_id").alias("snapshot_path"), F.lit(None).cast("string").alias("delta_path"),
    )
    doc = _json("book_slug", F.col("revision_id").alias("active_revision"), F.col("chapter_no").alias("next_sequence"), F.lit(1).alias("next_unit_sequence"), F.array(one).alias("revisions"))
    errors = documents.document_errors(r.select("book_slug", doc.alias("doc")), ["book_slug"], "doc", "source_revisions").select("book_slug", F.explode("errors").alias("rule"))
    return errors.groupBy("book_slug", "rule").agg(F.count("*").alias("n"))


def finding_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every finding as a quality report of its own."""
    anchor = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.quote"), F.col(f"{c}.occurrence")))
    one = F.struct("id", "category", "severity", "detail", "resolved", anchor("source_anchor").alias("source_anchor"), anchor("translation_anchor").alias("translation_anchor"), F.when(F.col("resolves").isNotNull(), F.struct(F.col("resolves.record_id"), F.col("resolves.finding_id"))).alias("resolves"))
    checks = F.struct(*[F.lit(True).alias(n) for n in ("coverage", "meaning", "terminology", "style", "structure")])
    doc = _json(F.lit(2).alias("evidence_version"), F.lit("bounded_context").alias("context"), checks.alias("checks"), F.array(one).alias("findings"))
    return _broken(findings(spark, root).select("finding_key", doc.alias("doc")), "finding_key", "quality_report")


def report_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Findings as reports with an outcome after their severity, where the two contradict each other."""
    f = findings(spark, root).where("resolved IS NOT NULL AND severity IS NOT NULL")
    doc = _json(F.array(F.struct("severity", "resolved")).alias("findings"))
    outcome = F.when(F.col("category").isin("style", "register", "voice"), "PASS").otherwise("CORRECTIONS_REQUIRED")
    return documents.report_outcome_errors(f.select("finding_key", doc.alias("doc"), outcome.alias("outcome")), ["finding_key"], "doc", "outcome")


def _events(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return e.withColumns({"hex": F.md5(F.col("event_id").cast("string")), "unit": F.format_string("chapter-%06d", F.col("user_id"))})


def claim_documents(spark: SparkSession, root: str) -> DataFrame:
    """Events as claims: their kind is the role, their value how many minutes past half an hour the claim ends before it began."""
    e = _events(spark, root)
    role = F.when(F.col("event_type") == "view", "reviewer").when(F.col("event_type").isin("click", "signup"), "translator").otherwise(F.col("event_type"))
    ends = F.col("ts") + F.make_interval(mins=F.lit(30) - F.floor("value").cast("int"))
    doc = _json(F.col("hex").alias("claim_id"), F.col("unit").alias("unit_id"), role.alias("role"), F.col("user_id").cast("string").alias("session_id"), F.lit("b").alias("base_revision"), F.lit("w").alias("workflow_revision"), F.lit(None).cast("string").alias("base_commit"), _iso("ts").alias("claimed_at"), _iso(ends).alias("expires_at"))
    return _broken(e.select("event_id", doc.alias("doc")), "event_id", "claim")


def lock_documents(spark: SparkSession, root: str) -> DataFrame:
    """Events as locks of a book's end: promoted ones are purchases, the revision stands where the value is above fifty."""
    e = _events(spark, root)
    doc = _json(
        F.col("hex").alias("lock_id"), F.lit("b").alias("book_slug"), F.lit("w").alias("workflow_revision"), F.lit("p").alias("base_progress_revision"), F.sha2("hex", 256).alias("candidate_progress_sha256"), F.when(F.col("event_type") == "purchase", "promoted").when(F.col("event_type") == "error", "failed").otherwise("preparing").alias("phase"),
        F.when(F.col("value") > 50, F.col("hex")).alias("promoted_progress_revision"), F.lit("s").alias("session_id"), _iso("ts").alias("started_at"),
    )
    return _broken(e.select("event_id", doc.alias("doc")), "event_id", "finalization_lock")


def resolution_documents(spark: SparkSession, root: str) -> DataFrame:
    """Events as resolutions of proposals: sign-ups accept, clicks reject, the others have no status of the kind."""
    e = _events(spark, root)
    status = F.when(F.col("event_type") == "signup", "accepted").when(F.col("event_type") == "click", "rejected").otherwise(F.col("event_type"))
    doc = _json(
        F.lit(1).alias("schema_version"), F.col("hex").alias("proposal_id"), status.alias("status"), F.lit("glossary").alias("target"), F.lit("s").alias("resolved_by_session_id"), _iso("ts").alias("resolved_at"), F.struct(F.lit("g").alias("glossary"), F.lit("s").alias("style_guide")).alias("shared_state_revisions"),
        F.when(F.col("value") > 20, "r").alias("resulting_revision"), F.when(F.col("value") > 20, F.sha2("hex", 256)).alias("resulting_sha256"), F.when(F.col("value") <= 20, "why").alias("reason"),
    )
    return _broken(e.select("event_id", doc.alias("doc")), "event_id", "resolution")


def ledger_faults(spark: SparkSession, root: str) -> DataFrame:
    """Findings as records of a book's ledger in the order of their keys, each naming the record that it resolves as the one before."""
    f = findings(spark, root).select("book_slug", "unit_id", "finding_key", "id", F.col("resolves.finding_id").alias("before"), F.coalesce(~F.col("resolved"), F.lit(True)).alias("rejected"))
    f = f.withColumn("n", F.regexp_extract("id", r"(\d+)$", 1).try_cast("int"))
    return documents.ledger_errors(f, ["book_slug"], "finding_key", "id", "unit_id", "n", "before", "rejected", "n").select("book_slug", "id", F.explode("errors").alias("rule")).groupBy("book_slug", "rule").agg(F.count("*").alias("n_records"))


QUERIES = {f.__name__: f for f in (progress_documents, manifest_documents, revision_documents, finding_documents, report_outcomes, claim_documents, lock_documents, resolution_documents, ledger_faults)}

_C = "(SELECT DISTINCT ON (chapter_id) * FROM chapters)"
_F = "(SELECT DISTINCT ON (finding_key) * FROM findings)"
_PATH = "regexp_matches({0}, '^[^\\\\]+$') AND NOT starts_with({0}, '/') AND NOT regexp_matches({0}, '(^|/)\\.{{1,2}}(/|$)')"


def _filled(c: str) -> str:
    return rf"regexp_matches({c}, '[^\s\p{{Z}}]')"


def _rules(key: str, source: str, rules: dict[str, str]) -> str:
    """One row for each rule that is not kept; a rule that is null is broken."""
    cases = ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in rules.items())
    return f"SELECT {key}, rule FROM (SELECT {key}, unnest([{cases}]) AS rule FROM {source}) WHERE rule IS NOT NULL"


_SLUG = "regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g')"
_EVENTS = "(SELECT event_id, ts, event_type, value FROM events)"
_REVISIONS = "(SELECT DISTINCT book_slug, revision_id, unit_id, chapter_no, title, content, sha256, created_at FROM source_revisions)"
_REVISION_RULES = {
    "revisions[0].revision_id": "regexp_full_match(revision_id, 'source-[0-9]{6}')", "active_revision": "regexp_full_match(revision_id, 'source-[0-9]{6}')", "revisions[0].state": "title IS NOT NULL", "active": "title IS NOT NULL",
    "revisions[0].source_file": f"{_filled('title')} AND regexp_full_match(title, '[^/\\\\]+') AND title NOT IN ('.', '..')", "revisions[0].source_sha256": "regexp_full_match(sha256, '[0-9a-f]{64}')",
    "revisions[0].source_size_bytes": "content IS NOT NULL", "next_sequence": "chapter_no >= 1", "next": "chapter_no > CAST(right(revision_id, 6) AS INTEGER)",
}
ORACLE = {
    "progress_documents": _rules("chapter_id", _C, {
        "book_slug": _filled("book_slug"), "chapters[0].number": "chapter_no >= 1", "chapters[0].title": _filled("title"), "chapters[0].slug": "title IS NOT NULL", "chapters[0].unit_id": "regexp_full_match(unit_id, 'chapter-[0-9]{6}')",
        "chapters[0].source_path": _PATH.format("source_path"), "chapters[0].translation_path": _PATH.format("translation_path"), "chapters[0].status": "status IN ('pending', 'extracted', 'translated', 'reviewed')",
    }),
    "manifest_documents": _rules("chapter_id", _C, {
        "source_file": "regexp_full_match(source_path, '[^/\\\\]+')", "source_format": _filled("source_format"), "source_sha256": "regexp_full_match(lower(sha256), '[0-9a-f]{64}')", "chapter_count": "chapter_no >= 0", "count": "chapter_no = 1", "extracted[0].number": "chapter_no >= 1",
        "extracted[0].title": _filled("title"), "extracted[0].path": _PATH.format("source_path"), "extracted[0].sha256": "regexp_full_match(sha256, '[0-9a-f]{64}')", "extracted[0].unit_id": "regexp_full_match(unit_id, 'chapter-[0-9]{6}')",
    }),
    "revision_documents": f"SELECT book_slug, rule, count(*) AS n FROM ({_rules('book_slug', _REVISIONS, _REVISION_RULES)}) GROUP BY 1, 2",
    "finding_documents": _rules("finding_key", _F, {
        "findings[0].id": "regexp_full_match(id, '[a-z][a-z0-9-]{0,31}')", "findings[0].category": f"category IN ({', '.join(repr(c) for c in documents.CATEGORIES.split())})", "findings[0].severity": "severity IN ('minor', 'major', 'critical')",
        "findings[0].detail": f"{_filled('detail')} AND length(detail) <= 1000", "findings[0].resolved": "resolved IS NOT NULL", "findings[0].source_anchor.object": "source_anchor IS NOT NULL", "findings[0].source_anchor.quote": f"{_filled('source_anchor.quote')} AND length(source_anchor.quote) <= 300",
        "findings[0].source_anchor.occurrence": "source_anchor.occurrence BETWEEN 0 AND 9999", "anchors": "translation_anchor IS NOT NULL OR (category = 'omission' AND NOT coalesce(resolved, true))",
        "findings[0].translation_anchor.quote": f"translation_anchor IS NULL OR ({_filled('translation_anchor.quote')} AND length(translation_anchor.quote) <= 300)", "findings[0].translation_anchor.occurrence": "translation_anchor IS NULL OR translation_anchor.occurrence BETWEEN 0 AND 9999",
        "findings[0].resolves.record_id": "resolves IS NULL OR regexp_full_match(resolves.record_id, '[0-9a-f]{32}')", "findings[0].resolves.finding_id": "resolves IS NULL OR regexp_full_match(resolves.finding_id, '[a-z][a-z0-9-]{0,31}')",
    }),
    "report_outcomes": f"""SELECT finding_key, CASE WHEN category IN ('style', 'register', 'voice') THEN 'open_grave' ELSE 'nothing_open' END AS error FROM {_F}
WHERE resolved IS NOT NULL AND severity IS NOT NULL AND CASE WHEN category IN ('style', 'register', 'voice') THEN NOT resolved AND severity IN ('major', 'critical') ELSE resolved END""",
    "claim_documents": _rules("event_id", _EVENTS, {"role": "event_type IN ('view', 'click', 'signup')", "order": "30 - floor(value) > 0"}),
    "lock_documents": _rules("event_id", _EVENTS, {"phase": "event_type <> 'error'", "promoted": "(event_type NOT IN ('purchase', 'error')) = (value IS NULL OR value <= 50)"}),
    "resolution_documents": _rules("event_id", _EVENTS, {"status": "event_type IN ('signup', 'click')", "outcome": "CASE WHEN event_type = 'signup' THEN value > 20 ELSE value <= 20 END"}),
    "ledger_faults": f"""WITH f AS (SELECT book_slug, unit_id, finding_key, id, resolves.finding_id AS before, coalesce(NOT resolved, true) AS rejected, TRY_CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER) AS n FROM {_F}),
w AS (SELECT *, row_number() OVER (PARTITION BY book_slug ORDER BY finding_key) AS i, lag(id) OVER (PARTITION BY book_slug, unit_id ORDER BY finding_key) AS prior, sum(CAST(rejected AS INTEGER)) OVER (PARTITION BY book_slug, unit_id ORDER BY finding_key) AS k FROM f),
e AS (SELECT book_slug, unnest([CASE WHEN n IS DISTINCT FROM i THEN 'sequence' END, CASE WHEN before IS DISTINCT FROM prior THEN 'supersedes' END, CASE WHEN n IS DISTINCT FROM k THEN 'round' END]) AS rule FROM w)
SELECT book_slug, rule, count(*) AS n_records FROM e WHERE rule IS NOT NULL GROUP BY 1, 2""",
}
