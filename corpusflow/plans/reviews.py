"""Queries over findings and answers: records in order, anchors, scores, measures of calls, memory, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import memory, planning, records, validation
from corpusflow.plans.tables import chapters, findings, pairs, per_quote, responses
from corpusflow.session import table
from corpusflow.streaming import leases

WEIGHTS = {"minor": 1, "major": 3, "critical": 5}
CATEGORIES = "omission addition meaning modality referent structure voice terminology style register".split()
REQUIRED = CATEGORIES[:8]


def _scored(spark: SparkSession, root: str) -> DataFrame:
    """One row for each review record: its score, its open findings, and the time of its last one."""
    f = findings(spark, root).where("record_id IS NOT NULL")
    open_ = ~F.coalesce("resolved", F.lit(False))
    return f.groupBy("book_slug", "unit_id", "record_id").agg(
        F.max("reviewed_at").alias("at"), F.sum(F.when(open_, records.severity_weight(F.col("severity"), WEIGHTS)).otherwise(0)).alias("score"), F.count_if(open_).alias("n_open"), F.count_if(open_ & F.col("severity").isin("major", "critical")).alias("n_grave")
    )


def record_scores(spark: SparkSession, root: str) -> DataFrame:
    return _scored(spark, root).select("record_id", "book_slug", "unit_id", "score", "n_open", "n_grave")


def latest_records(spark: SparkSession, root: str) -> DataFrame:
    """The last review record of every unit."""
    return records.latest_by(_scored(spark, root), ["book_slug", "unit_id"], ["at", "record_id"]).select("book_slug", "unit_id", "record_id", "score")


def record_history(spark: SparkSession, root: str) -> DataFrame:
    """Review records numbered within their unit, with the one before, and the first of equal score."""
    h = records.with_history(_scored(spark, root), ["book_slug", "unit_id"], ["at", "record_id"], "record_id", ["score", "n_open"])
    return h.select("record_id", "sequence", "supersedes", "duplicate_of")


def stalled_units(spark: SparkSession, root: str) -> DataFrame:
    """Units whose last two records both hold open findings and do not get better."""
    s = _scored(spark, root).withColumn("rejected", F.col("n_open") > 0)
    return records.stalled(s, ["book_slug", "unit_id"], ["at", "record_id"], "score", "record_id", "rejected", 2)


def stalled_books(spark: SparkSession, root: str) -> DataFrame:
    """Books whose last two review records both hold open findings and do not get better."""
    s = _scored(spark, root).withColumn("rejected", F.col("n_open") > 0)
    return records.stalled(s, ["book_slug"], ["at", "record_id"], "score", "record_id", "rejected", 2)


def finding_triage(spark: SparkSession, root: str) -> DataFrame:
    """Findings by what they ask for, for each book."""
    grave = F.col("severity").isin("major", "critical") | F.col("category").isin(*REQUIRED)
    kind = F.when(grave, "required").when((F.col("severity") == "minor") & F.col("category").isin("style", "register"), "adjudicate").otherwise("review_required")
    return findings(spark, root).groupBy("book_slug", kind.alias("triage")).agg(F.count("*").alias("n"))


def anchor_places(spark: SparkSession, root: str) -> DataFrame:
    """Where the quote of every finding stands in the content of its unit: place, and whether it is there, absent or ambiguous."""

    def place(content: Column, q: Column, n: Column) -> dict[str, Column]:
        count = X.occurrences(content, q)
        state = F.when(count <= n, "absent").when((n == 0) & (count > 1), "ambiguous").otherwise("found")
        return {"n_places": count, "place": X.nth_offset(content, q, n), "state": state}

    return per_quote(spark, root, place).select("finding_key", "n_places", "place", "state")


def window_digests(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 of the hundred characters on both sides of every quote that stands once in its unit."""

    def digest(content: Column, q: Column, n: Column) -> dict[str, Column]:
        at = X.nth_offset(content, q, F.lit(0))
        lo = F.greatest(F.lit(0), at - 100)
        return {"sha256": F.when(X.occurrences(content, q) == 1, F.sha2(F.substring(content, lo + 1, at + F.length(q) + 100 - lo), 256))}

    return per_quote(spark, root, digest).where("sha256 IS NOT NULL").select("finding_key", "sha256")


def review_states(spark: SparkSession, root: str) -> DataFrame:
    """Units by the state of their last review for each book, with the share that passed."""
    units = chapters(spark, root, "book_slug", "unit_id").drop("chapter_id")
    seen = records.resolve_units(units, _scored(spark, root), ["book_slug", "unit_id"], [], ["at", "record_id"], F.col("n_open") == 0)
    n = lambda s: F.count_if(F.col("state") == s)
    return seen.groupBy("book_slug").agg(F.count("*").alias("n_units"), n("pass").alias("n_pass"), n("corrections_required").alias("n_open"), n("missing").alias("n_missing"), (n("pass") * 100.0 / F.count("*")).alias("pass_percent"))


def route_measures(spark: SparkSession, root: str) -> DataFrame:
    """Calls, outcomes, time and tokens of every route, however it is spelled."""
    route = F.lower(F.trim("route"))
    return responses(spark, root).groupBy(route.alias("route")).agg(
        F.count("*").alias("n_calls"), F.count_if(F.col("outcome") == "accepted").alias("n_accepted"), F.count_if(F.col("outcome").isNull()).alias("n_unknown"),
        F.sum("duration_ms").alias("duration_ms"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )


def attempt_medians(spark: SparkSession, root: str) -> DataFrame:
    """Exact medians for each number of attempts, and the speed against first attempts."""
    r = responses(spark, root).where("duration_ms > 0 AND completion_tokens IS NOT NULL").withColumn("rate", F.col("completion_tokens") * 1000.0 / F.col("duration_ms"))
    return records.grouped_medians(r, "attempt", 1, "rate", ["duration_ms"])


def latest_answers(spark: SparkSession, root: str) -> DataFrame:
    """The last answer for every span."""
    r = responses(spark, root).select("book_slug", "unit_id", "segment_id", "attempt", "response_id", "outcome")
    return records.latest_by(r, ["book_slug", "unit_id", "segment_id"], ["attempt", "response_id"])


def retry_times(spark: SparkSession, root: str) -> DataFrame:
    """When an answer that was rejected may be asked for again: the ladder's pause after its attempt."""
    ladder = F.array(*[F.lit(s) for s in (300, 900, 1800, 43200, 86400)])
    wait = F.element_at(ladder, F.least(F.col("attempt"), F.lit(5)).cast("int"))
    return responses(spark, root).where("outcome = 'rejected'").select("response_id", wait.alias("wait_s"), F.unix_seconds(F.col("started_at") + F.make_interval(secs=wait)).alias("retry_at"))


def fair_queue(spark: SparkSession, root: str) -> DataFrame:
    """The six books whose turn is next: each with its earliest unit that is not reviewed."""
    c = chapters(spark, root, "book_slug", "chapter_no", "status", "imported_at").where("status <> 'reviewed'")
    return planning.fair_queue(c.select("book_slug", "chapter_no", "chapter_id", "imported_at"), ["book_slug"], ["chapter_no", "chapter_id"], ["imported_at", "book_slug"], 6).select("book_slug", "chapter_id")


def session_plan(spark: SparkSession, root: str) -> DataFrame:
    """The units of each book in three runs of about equal length."""
    c = chapters(spark, root, "book_slug", "chapter_no", "content").select("book_slug", "chapter_no", "chapter_id", F.coalesce(F.length("content"), F.lit(0)).alias("n_chars"))
    return planning.contiguous_runs(c, ["book_slug"], ["chapter_no", "chapter_id"], "n_chars", 3).select("book_slug", "chapter_id", "n_chars", F.col("run_no").alias("session_no"))


def context_packs(spark: SparkSession, root: str) -> DataFrame:
    """For every unit the findings that go with it under a budget of 120 characters of detail, the gravest first."""
    priority = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "major", 1).otherwise(2)
    f = findings(spark, root).where("detail IS NOT NULL").select("book_slug", "unit_id", priority.alias("p"), "finding_key", F.length("detail").alias("cost"))
    packs = memory.context_packs(f, ["book_slug", "unit_id"], "p", "finding_key", "cost", 120)
    return packs.select("book_slug", "unit_id", F.array_join("entries", ",").alias("entries"), "used", "n_candidates")


def term_mentions(spark: SparkSession, root: str) -> DataFrame:
    """Which of some terms stand in a unit or its translation."""
    terms = spark.createDataFrame([(1, "copper lantern"), (2, "honey cake"), (3, "медный фонарь"), (4, "Mizu")], "entry int, term string")
    return memory.mentions(pairs(spark, root), ["translation_key"], ["source", "target"], terms, "entry", "term")


def superseded_findings(spark: SparkSession, root: str) -> DataFrame:
    """Findings of each record that a later one resolves, and those that stand."""
    f = findings(spark, root).select(F.concat_ws("/", "record_id", "id").alias("entry"), "finding_key", F.concat_ws("/", "resolves.record_id", "resolves.finding_id").alias("r"))
    return memory.superseded(f.withColumn("r", F.nullif("r", F.lit(""))), "entry", "r").groupBy("active").agg(F.count("*").alias("n"))


def broken_rules(spark: SparkSession, root: str) -> DataFrame:
    """Findings, chapters and answers that break a rule of their kind, by rule."""
    hex_ok = lambda c: F.col(c).rlike(validation.HEX64)
    f = validation.violations(findings(spark, root), ["finding_key"], {
        "record_id": F.col("record_id").rlike(validation.HEX32), "category": validation.one_of(F.col("category"), CATEGORIES), "severity": validation.one_of(F.col("severity"), list(WEIGHTS)),
        "detail": validation.bounded(F.col("detail"), 1, 1000), "quote": validation.bounded(F.col("source_anchor.quote"), 1, 300), "occurrence": F.col("source_anchor.occurrence").between(0, 9999),
        "translation_anchor": F.col("translation_anchor").isNotNull(), "order": F.col("received_at") >= F.col("reviewed_at"),
    })
    c = validation.violations(chapters(spark, root, "unit_id", "title", "status", "sha256", "chapter_no", "imported_at", "received_at"), ["chapter_id"], {
        "unit_id": F.col("unit_id").rlike(validation.UNIT), "title": validation.bounded(F.col("title"), 1, 1000), "status": validation.one_of(F.col("status"), ["pending", "extracted", "translated", "reviewed"]),
        "sha256": hex_ok("sha256"), "chapter_no": F.col("chapter_no").between(1, 999_999), "order": F.col("received_at") >= F.col("imported_at"),
    })
    r = validation.violations(responses(spark, root), ["response_id"], {
        "segment_id": F.col("segment_id").rlike(validation.SEGMENT), "route": F.col("route") == F.lower(F.trim("route")), "outcome": validation.one_of(F.col("outcome"), ["accepted", "rejected"]),
        "tokens": F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull(), "attempt": F.col("attempt") >= 1,
    })
    parts = [x.select(F.lit(kind).alias("record_kind"), F.explode("errors").alias("rule")) for kind, x in (("finding", f), ("chapter", c), ("response", r))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("record_kind", "rule").agg(F.count("*").alias("n"))


def repeated_rows(spark: SparkSession, root: str) -> DataFrame:
    """How many keys of each table more than one row has."""
    names = {"chapters": "chapter_id", "structural_segments": "segment_key", "findings": "finding_key", "translator_responses": "response_id", "translations": "translation_key"}
    parts = [validation.repeated_keys(table(spark, root, t), [k]).agg(F.count("*").alias("n_keys")).select(F.lit(t).alias("table_name"), "n_keys") for t, k in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def route_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Spans whose answers differ in language."""
    return validation.conflicting(responses(spark, root), ["book_slug", "unit_id", "segment_id"], "target_language")


def outcome_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Spans whose answers differ in outcome."""
    return validation.conflicting(responses(spark, root), ["book_slug", "unit_id", "segment_id"], "outcome")


def event_counts(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return leases.windowed_counts(e.withColumn("value", F.floor("value")), "ts", "event_type", "value").select(F.unix_seconds("start").alias("start_s"), "event_type", "n", "total")


def lease_spans(spark: SparkSession, root: str) -> DataFrame:
    e = leases.lease_spans(table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours")
    return e.select("user_id", F.unix_seconds("claimed_at").alias("claimed_s"), "n_renewals")


def active_leases(spark: SparkSession, root: str) -> DataFrame:
    """The leases that had not run out at the time of the last event, the earliest to end first in order of their holders."""
    e = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return leases.lease_spans(e, "ts", "user_id", "6 hours").join(F.broadcast(now)).where("expires_at > now").select("user_id", F.unix_seconds("claimed_at").alias("claimed_s"), F.unix_seconds("expires_at").alias("expires_s"))


def lease_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Events as requests for exclusive leases of their user, by a stream over the file: the kind of event is the session, a click or view
    asks for the lease, a purchase renews it, any other gives it back."""
    stream = spark.readStream.schema(table(spark, root, "events").schema).option("pathGlobFilter", "events.parquet").parquet(root)
    action = F.when(F.col("event_type").isin("click", "view"), "acquire").when(F.col("event_type") == "purchase", "renew").otherwise("release")
    session = F.when(F.col("event_type").isin("click", "purchase", "error"), "a").otherwise("b")
    requests = stream.select(F.col("user_id").cast("string").alias("unit"), F.col("ts").cast("timestamp").alias("at"), session.alias("session"), action.alias("action"))
    done = leases.replay(spark, leases.exclusive_leases(requests, 48 * 3600), "lease-outcomes")
    return done.groupBy("session", "action", "outcome").agg(F.count("*").alias("n"))


def streamed_event_counts(spark: SparkSession, root: str) -> DataFrame:
    """The hourly counts once more, by a stream over the same file, closed windows only."""
    schema = table(spark, root, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    counts = leases.windowed_counts(stream.withColumns({"ts": F.col("ts").cast("timestamp"), "value": F.floor("value")}), "ts", "event_type", "value")
    return leases.replay(spark, counts, "event-counts").select(F.unix_seconds("start").alias("start_s"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (
        record_scores, latest_records, record_history, stalled_units, stalled_books, finding_triage, anchor_places, window_digests, review_states, route_measures, attempt_medians, latest_answers, retry_times, fair_queue,
        session_plan, context_packs, term_mentions, superseded_findings, broken_rules, repeated_rows, route_conflicts, outcome_conflicts, event_counts, lease_spans, active_leases, lease_outcomes, streamed_event_counts,
    )
}

_F = "(SELECT DISTINCT ON (finding_key) * FROM findings)"
_R = "(SELECT DISTINCT ON (response_id) * FROM translator_responses)"
_C = "(SELECT DISTINCT ON (chapter_id) * FROM chapters)"
_SCORED = f"""SELECT book_slug, unit_id, record_id, max(reviewed_at) AS at_, CAST(sum(CASE WHEN coalesce(resolved, false) THEN 0 WHEN severity = 'minor' THEN 1 WHEN severity = 'major' THEN 3 WHEN severity = 'critical' THEN 5 ELSE 0 END) AS BIGINT) AS score,
 count(*) FILTER (NOT coalesce(resolved, false)) AS n_open, count(*) FILTER (NOT coalesce(resolved, false) AND severity IN ('major', 'critical')) AS n_grave FROM {_F} WHERE record_id IS NOT NULL GROUP BY 1, 2, 3"""
_PLACES = "CASE WHEN length(q) = 0 THEN 0 ELSE (length(content) - length(replace(content, q, ''))) // length(q) END"
_ANCHOR = f"SELECT finding_key, f.source_anchor.quote AS q, f.source_anchor.occurrence AS n, c.content FROM {_F} f JOIN {_C} c USING (book_slug, unit_id) WHERE f.source_anchor.quote <> ''"
_EVENTS = "SELECT CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS start_s, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY 1, 2"

ORACLE = {
    "record_scores": f"SELECT record_id, book_slug, unit_id, score, n_open, n_grave FROM ({_SCORED})",
    "latest_records": f"SELECT book_slug, unit_id, record_id, score FROM ({_SCORED}) QUALIFY row_number() OVER (PARTITION BY book_slug, unit_id ORDER BY at_ DESC, record_id DESC) = 1",
    "record_history": f"""SELECT record_id, CAST(row_number() OVER w AS INTEGER) AS sequence, lag(record_id) OVER w AS supersedes, CASE WHEN first_value(record_id) OVER d <> record_id THEN first_value(record_id) OVER d END AS duplicate_of
FROM ({_SCORED}) WINDOW w AS (PARTITION BY book_slug, unit_id ORDER BY at_, record_id), d AS (PARTITION BY book_slug, unit_id, score, n_open ORDER BY at_, record_id)""",
    "stalled_units": f"""SELECT book_slug, unit_id, min(score) FILTER (k = 2) AS first_score, min(score) FILTER (k = 1) AS last_score FROM (SELECT *, row_number() OVER (PARTITION BY book_slug, unit_id ORDER BY at_ DESC, record_id DESC) AS k FROM ({_SCORED})) WHERE k <= 2
GROUP BY 1, 2 HAVING count(*) = 2 AND bool_and(n_open > 0) AND min(score) FILTER (k = 1) >= min(score) FILTER (k = 2)""",
    "stalled_books": f"""SELECT book_slug, min(score) FILTER (k = 2) AS first_score, min(score) FILTER (k = 1) AS last_score FROM (SELECT *, row_number() OVER (PARTITION BY book_slug ORDER BY at_ DESC, record_id DESC) AS k FROM ({_SCORED})) WHERE k <= 2
GROUP BY 1 HAVING count(*) = 2 AND bool_and(n_open > 0) AND min(score) FILTER (k = 1) >= min(score) FILTER (k = 2)""",
    "outcome_conflicts": f"SELECT book_slug, unit_id, segment_id, count(DISTINCT coalesce(outcome, '?')) AS n_values FROM {_R} GROUP BY 1, 2, 3 HAVING count(DISTINCT coalesce(outcome, '?')) > 1",
    "session_plan": f"""WITH RECURSIVE u AS (SELECT book_slug, chapter_id, coalesce(length(content), 0) AS n, CAST(greatest(coalesce(length(content), 0), 1) AS DOUBLE) AS w, row_number() OVER (PARTITION BY book_slug ORDER BY chapter_no, chapter_id) AS i, count(*) OVER (PARTITION BY book_slug) AS m, sum(greatest(coalesce(length(content), 0), 1)) OVER (PARTITION BY book_slug) AS total FROM {_C}),
r AS (SELECT book_slug, chapter_id, n, i, m, 1 AS g, w AS filled, CAST(total AS DOUBLE) AS rest FROM u WHERE i = 1
 UNION ALL SELECT u.book_slug, u.chapter_id, u.n, u.i, u.m, CASE WHEN f.fresh THEN r.g + 1 ELSE r.g END, CASE WHEN f.fresh THEN u.w ELSE r.filled + u.w END, CASE WHEN f.fresh THEN r.rest - r.filled ELSE r.rest END
 FROM r JOIN u ON u.book_slug = r.book_slug AND u.i = r.i + 1, LATERAL (SELECT (u.m - u.i + 1 <= least(3, u.m) - r.g) OR (r.filled >= r.rest / (least(3, u.m) - r.g + 1)) AS fresh) f)
SELECT book_slug, chapter_id, CAST(n AS INTEGER) AS n_chars, g AS session_no FROM r""",
    "context_packs": f"""WITH RECURSIVE f AS (SELECT book_slug, unit_id, finding_key, length(detail) AS c, row_number() OVER (PARTITION BY book_slug, unit_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, finding_key) AS i FROM {_F} WHERE detail IS NOT NULL),
r AS (SELECT book_slug, unit_id, i, CASE WHEN c <= 120 THEN c ELSE 0 END AS used, CASE WHEN c <= 120 THEN [finding_key] ELSE [] END AS kept FROM f WHERE i = 1
 UNION ALL SELECT f.book_slug, f.unit_id, f.i, CASE WHEN r.used + f.c <= 120 THEN r.used + f.c ELSE r.used END, CASE WHEN r.used + f.c <= 120 THEN list_append(r.kept, f.finding_key) ELSE r.kept END FROM r JOIN f ON f.book_slug = r.book_slug AND f.unit_id = r.unit_id AND f.i = r.i + 1)
SELECT book_slug, unit_id, array_to_string(kept, ',') AS entries, used, i AS n_candidates FROM r QUALIFY row_number() OVER (PARTITION BY book_slug, unit_id ORDER BY i DESC) = 1""",
    "superseded_findings": f"""WITH f AS (SELECT finding_key, record_id || '/' || id AS e, resolves.record_id || '/' || resolves.finding_id AS r FROM {_F}) SELECT coalesce(e NOT IN (SELECT r FROM f WHERE r IS NOT NULL), true) AS active, count(*) AS n FROM f GROUP BY 1""",
    "broken_rules": f"""WITH v AS (SELECT 'finding' AS record_kind, unnest(list_filter([CASE WHEN NOT coalesce(regexp_full_match(record_id, '[0-9a-f]{{32}}'), false) THEN 'record_id' END, CASE WHEN NOT coalesce(category IN ({', '.join(repr(c) for c in CATEGORIES)}), false) THEN 'category' END,
 CASE WHEN NOT coalesce(severity IN ('minor', 'major', 'critical'), false) THEN 'severity' END, CASE WHEN NOT coalesce(length(detail) BETWEEN 1 AND 1000, false) THEN 'detail' END, CASE WHEN NOT coalesce(length(source_anchor.quote) BETWEEN 1 AND 300, false) THEN 'quote' END,
 CASE WHEN NOT coalesce(source_anchor.occurrence BETWEEN 0 AND 9999, false) THEN 'occurrence' END, CASE WHEN translation_anchor IS NULL THEN 'translation_anchor' END, CASE WHEN NOT coalesce(received_at >= reviewed_at, false) THEN 'order' END], lambda x: x IS NOT NULL)) AS rule FROM {_F}
 UNION ALL SELECT 'chapter', unnest(list_filter([CASE WHEN NOT coalesce(regexp_full_match(unit_id, 'chapter-\\d{{6}}'), false) THEN 'unit_id' END, CASE WHEN NOT coalesce(length(title) BETWEEN 1 AND 1000, false) THEN 'title' END, CASE WHEN NOT coalesce(status IN ('pending', 'extracted', 'translated', 'reviewed'), false) THEN 'status' END,
 CASE WHEN NOT coalesce(regexp_full_match(sha256, '[0-9a-f]{{64}}'), false) THEN 'sha256' END, CASE WHEN NOT coalesce(chapter_no BETWEEN 1 AND 999999, false) THEN 'chapter_no' END, CASE WHEN NOT coalesce(received_at >= imported_at, false) THEN 'order' END], lambda x: x IS NOT NULL)) FROM {_C}
 UNION ALL SELECT 'response', unnest(list_filter([CASE WHEN NOT coalesce(regexp_full_match(segment_id, 's\\d{{5}}'), false) THEN 'segment_id' END, CASE WHEN NOT coalesce(route = lower(trim(route)), false) THEN 'route' END, CASE WHEN NOT coalesce(outcome IN ('accepted', 'rejected'), false) THEN 'outcome' END,
 CASE WHEN prompt_tokens IS NULL OR completion_tokens IS NULL THEN 'tokens' END, CASE WHEN NOT coalesce(attempt >= 1, false) THEN 'attempt' END], lambda x: x IS NOT NULL)) FROM {_R})
SELECT record_kind, rule, count(*) AS n FROM v GROUP BY 1, 2""",
    "streamed_event_counts": f"SELECT * FROM ({_EVENTS}) WHERE start_s + 3600 <= (SELECT floor(epoch(max(ts))) FROM events) - 600",
    "finding_triage": f"""SELECT book_slug, CASE WHEN severity IN ('major', 'critical') OR category IN ({', '.join(repr(c) for c in REQUIRED)}) THEN 'required' WHEN severity = 'minor' AND category IN ('style', 'register') THEN 'adjudicate' ELSE 'review_required' END AS triage, count(*) AS n FROM {_F} GROUP BY 1, 2""",
    "anchor_places": f"""SELECT finding_key, CAST({_PLACES} AS INTEGER) AS n_places, CASE WHEN {_PLACES} > n THEN CAST(list_sum(list_transform(string_split(content, q)[1:n + 1], lambda x: length(x))) + n * length(q) AS INTEGER) END AS place,
 CASE WHEN {_PLACES} <= n THEN 'absent' WHEN n = 0 AND {_PLACES} > 1 THEN 'ambiguous' ELSE 'found' END AS state FROM ({_ANCHOR})""",
    "window_digests": f"SELECT finding_key, sha256(substr(content, greatest(0, instr(content, q) - 101) + 1, instr(content, q) - 1 + length(q) + 100 - greatest(0, instr(content, q) - 101))) AS sha256 FROM ({_ANCHOR}) WHERE {_PLACES} = 1",
    "review_states": f"""WITH l AS (SELECT book_slug, unit_id, n_open FROM ({_SCORED}) QUALIFY row_number() OVER (PARTITION BY book_slug, unit_id ORDER BY at_ DESC, record_id DESC) = 1)
SELECT c.book_slug, count(*) AS n_units, count(*) FILTER (l.n_open = 0) AS n_pass, count(*) FILTER (l.n_open > 0) AS n_open, count(*) FILTER (l.n_open IS NULL) AS n_missing, count(*) FILTER (l.n_open = 0) * 100.0 / count(*) AS pass_percent FROM {_C} c LEFT JOIN l USING (book_slug, unit_id) GROUP BY 1""",
    "route_measures": f"SELECT lower(trim(route)) AS route, count(*) AS n_calls, count(*) FILTER (outcome = 'accepted') AS n_accepted, count(*) FILTER (outcome IS NULL) AS n_unknown, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM {_R} GROUP BY 1",
    "attempt_medians": f"""WITH m AS (SELECT attempt, count(*) AS samples, median(completion_tokens * 1000.0 / duration_ms) AS median_rate, median(duration_ms) AS median_duration_ms FROM {_R} WHERE duration_ms > 0 AND completion_tokens IS NOT NULL GROUP BY 1)
SELECT *, median_rate / (SELECT median_rate FROM m WHERE attempt = 1) AS speedup FROM m""",
    "latest_answers": f"SELECT book_slug, unit_id, segment_id, attempt, response_id, outcome FROM {_R} QUALIFY row_number() OVER (PARTITION BY book_slug, unit_id, segment_id ORDER BY attempt DESC, response_id DESC) = 1",
    "retry_times": f"SELECT response_id, [300, 900, 1800, 43200, 86400][least(attempt, 5)] AS wait_s, CAST(floor(epoch(started_at) + [300, 900, 1800, 43200, 86400][least(attempt, 5)]) AS BIGINT) AS retry_at FROM {_R} WHERE outcome = 'rejected'",
    "fair_queue": f"SELECT book_slug, chapter_id FROM (SELECT * FROM {_C} WHERE status <> 'reviewed' QUALIFY row_number() OVER (PARTITION BY book_slug ORDER BY chapter_no, chapter_id) = 1) ORDER BY imported_at, book_slug LIMIT 6",
    "term_mentions": """SELECT DISTINCT t.translation_key, CAST(g.entry AS INTEGER) AS entry FROM (SELECT DISTINCT translation_key, markdown FROM translations) t JOIN (SELECT DISTINCT chapter_id, content FROM chapters) c ON c.chapter_id = t.translation_key,
(VALUES (1, 'copper lantern'), (2, 'honey cake'), (3, 'медный фонарь'), (4, 'Mizu')) g(entry, term) WHERE contains(lower(content), lower(term)) OR contains(lower(markdown), lower(term))""",
    "repeated_rows": " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM (SELECT {k} FROM {t} GROUP BY 1 HAVING count(*) > 1)) AS n_keys" for t, k in (("chapters", "chapter_id"), ("structural_segments", "segment_key"), ("findings", "finding_key"), ("translator_responses", "response_id"), ("translations", "translation_key"))),
    "route_conflicts": f"SELECT book_slug, unit_id, segment_id, count(DISTINCT target_language) AS n_values FROM {_R} GROUP BY 1, 2, 3 HAVING count(DISTINCT target_language) > 1",
    "event_counts": _EVENTS,
    "active_leases": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), l AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS z FROM s GROUP BY user_id, k)
SELECT user_id, CAST(floor(epoch(a)) AS BIGINT) AS claimed_s, CAST(floor(epoch(z)) AS BIGINT) AS expires_s FROM l WHERE z > (SELECT max(ts) FROM events)""",
    "lease_outcomes": """WITH RECURSIVE e AS (SELECT user_id, ts, session, action, row_number() OVER (PARTITION BY user_id ORDER BY ts, session, action) AS i FROM (SELECT user_id, ts, CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'a' ELSE 'b' END AS session,
 CASE WHEN event_type IN ('click', 'view') THEN 'acquire' WHEN event_type = 'purchase' THEN 'renew' ELSE 'release' END AS action FROM events)),
r AS (SELECT user_id, i, session, action, CASE WHEN action = 'acquire' THEN 'granted' ELSE 'missing' END AS outcome, CASE WHEN action = 'acquire' THEN session END AS owner, CASE WHEN action = 'acquire' THEN ts + INTERVAL 48 HOUR END AS until FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.i, e.session, e.action, o.outcome, CASE WHEN o.outcome IN ('granted', 'renewed') THEN e.session WHEN o.outcome <> 'released' THEN r.owner END, CASE WHEN o.outcome IN ('granted', 'renewed') THEN e.ts + INTERVAL 48 HOUR ELSE r.until END
 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1, LATERAL (SELECT coalesce(r.owner IS NOT NULL AND r.until > e.ts, false) AS live) v, LATERAL (SELECT CASE WHEN v.live AND r.owner <> e.session THEN 'conflict' WHEN e.action = 'acquire' OR (e.action = 'renew' AND v.live) THEN CASE WHEN v.live THEN 'renewed' ELSE 'granted' END WHEN e.action = 'release' AND v.live THEN 'released' ELSE 'missing' END AS outcome) o)
SELECT session, action, outcome, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "lease_spans": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS claimed_s, count(*) - 1 AS n_renewals FROM s GROUP BY user_id, k""",
}
