"""Queries over counts, memory and addresses: measures of roles, queues, warnings, terms, snapshots, blocks and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions import text as X
from corpusflow.operators import editions, edits, memory, planning, quality, records
from corpusflow.plans import texts
from corpusflow.plans.reviews import _scored
from corpusflow.plans.tables import PAIRS_SQL, chapters, findings, pairs, per_quote, responses, segments
from corpusflow.session import table


def role_measures(spark: SparkSession, root: str) -> DataFrame:
    """Calls, answers, failures, time, bytes and tokens of every role."""
    return responses(spark, root).groupBy("role_name").agg(
        F.count("*").alias("n_calls"), F.count_if(F.length("translation") > 0).alias("n_answers"), F.count_if(F.coalesce(F.col("outcome") == "rejected", F.lit(False))).alias("n_rejected"), F.count_if(F.col("outcome") == "accepted").alias("n_accepted"),
        F.sum("duration_ms").alias("duration_ms"), F.sum(F.octet_length("translation")).alias("n_bytes"), F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("n_tokens"),
    )


def unit_queues(spark: SparkSession, root: str) -> DataFrame:
    """How many units of each book wait for what: text, translation, review, corrections, or nothing."""
    last = records.latest_by(_scored(spark, root), ["book_slug", "unit_id"], ["at", "record_id"]).select(F.col("book_slug").alias("b"), F.col("unit_id").alias("u"), "n_open")
    c = chapters(spark, root, "book_slug", "unit_id", "status").join(last, (F.col("book_slug") == F.col("b")) & (F.col("unit_id") == F.col("u")), "left")
    queue = F.when(F.col("status") == "reviewed", "done").when(F.col("n_open") > 0, "corrections").when(F.col("status") == "translated", "review").when(F.col("status") == "extracted", "translation").otherwise("text")
    return c.groupBy("book_slug", queue.alias("queue")).agg(F.count("*").alias("n"))


def _book_states(spark: SparkSession, root: str) -> DataFrame:
    """Units with the state of their last review of the text that they have now: one reviewed before it was imported is of another."""
    c = chapters(spark, root, "book_slug", "unit_id", "status", "imported_at").drop("chapter_id").withColumn("fresh", F.lit(True))
    r = _scored(spark, root).join(c.select("book_slug", "unit_id", "imported_at"), ["book_slug", "unit_id"]).withColumn("fresh", F.col("at") >= F.col("imported_at"))
    seen = records.resolve_units(c, r, ["book_slug", "unit_id"], ["fresh"], ["at", "record_id"], F.col("n_open") == 0)
    return seen.withColumn("state", F.when(F.col("status").isin("pending", "extracted"), "untranslated").otherwise(F.col("state")))


def book_status(spark: SparkSession, root: str) -> DataFrame:
    """For each book: its units by status, by the state of their review, and the share that passed."""
    seen = _book_states(spark, root)
    of = lambda c, names: [F.count_if(F.col(c) == n).alias(f"n_{n}") for n in names]
    status, state = ("pending", "extracted", "translated", "reviewed"), ("pass", "corrections_required", "stale", "missing", "untranslated")
    return seen.groupBy("book_slug").agg(F.count("*").alias("n_units"), *of("status", status), *of("state", state), F.round(F.count_if(F.col("state") == "pass") * 100 / F.count("*"), 2).alias("coverage"))


def book_reports(spark: SparkSession, root: str) -> DataFrame:
    """The status of every book as a report in Markdown."""
    n = lambda c: F.col(f"n_{c}").cast("string")
    rows = [F.concat(F.lit(f"- {c}: "), n(c)) for c in ("pending", "extracted", "translated", "reviewed")]
    gates = [F.concat(F.when(F.col(f"n_{c}") == 0, "- [x] no unit is ").otherwise("- [ ] no unit is "), F.lit(c)) for c in ("untranslated", "missing", "stale", "corrections_required")]
    lines = [F.concat(F.lit("# "), F.col("book_slug")), F.lit("## Units"), *rows, F.lit("## Gates"), *gates]
    return book_status(spark, root).select("book_slug", F.concat_ws("\n", *lines).alias("report"))


def link_targets(spark: SparkSession, root: str) -> DataFrame:
    """Where the links of the chapters lead: outside, with the address in one form, or not; and whether a chapter is nothing but links out."""
    c = chapters(spark, root, "content").where("content IS NOT NULL")
    each = c.select("chapter_id", X.external_links_only(F.col("content")).alias("links_only"), F.explode(F.regexp_extract_all("content", F.lit(X.LINK), F.lit(3))).alias("t"))
    return each.groupBy("links_only", F.coalesce(X.external_href(F.col("t")), F.lit("inside")).alias("href")).agg(F.count("*").alias("n"), F.countDistinct("chapter_id").alias("n_chapters"))


def review_counts(spark: SparkSession, root: str) -> DataFrame:
    """Review records of every book that found nothing open, and that did, counted once for each unit and record."""
    return _scored(spark, root).groupBy("book_slug").agg(F.count_if(F.col("n_open") == 0).alias("n_pass"), F.count_if(F.col("n_open") > 0).alias("n_corrections"), F.countDistinct("unit_id").alias("n_units"))


def combined_reports(spark: SparkSession, root: str) -> DataFrame:
    """The findings of each unit as one report: how many different details of each category, and whether anything is open."""
    f = findings(spark, root)
    return f.groupBy("book_slug", "unit_id").agg(F.count("*").alias("n_findings"), F.countDistinct(F.struct("category", "detail")).alias("n_different"), F.when(F.bool_or(~F.coalesce("resolved", F.lit(False))), "CORRECTIONS_REQUIRED").otherwise("PASS").alias("outcome"))


def preflight_warnings(spark: SparkSession, root: str) -> DataFrame:
    """Warnings of every translated unit: numbers, structure and glossary."""
    glossary = spark.createDataFrame([(texts.GLOSSARY,)], "t string").select(F.explode(quality.glossary_rows(F.col("t"))).alias("r")).select("r.*")
    return quality.preflight(pairs(spark, root), ["translation_key"], "source", "target", glossary)


def block_advisories(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs of units with as many in both languages whose terms are words of their own and lack their rendering."""
    glossary = spark.createDataFrame([(texts.GLOSSARY,)], "t string").select(F.explode(quality.glossary_rows(F.col("t"))).alias("r")).select("r.*")
    p = pairs(spark, root).withColumns({"a": X.paragraphs(F.col("source")), "b": X.paragraphs(F.col("target"))}).where("size(a) = size(b)")
    each = p.select("translation_key", F.posexplode(F.arrays_zip("a", "b")).alias("block_no", "x")).select("translation_key", "block_no", F.col("x.a").alias("source"), F.col("x.b").alias("target"))
    return quality.block_advisories(each, ["translation_key"], "block_no", "source", "target", glossary)


def disjoint_findings(spark: SparkSession, root: str) -> DataFrame:
    """The findings of every unit that may be corrected at once: the first eight whose quotes stand once and do not overlap. Those without
    a quote end the list as well."""
    once = lambda content, q, n: {"lo": F.when(X.occurrences(content, q) == 1, F.instr(content, q) - 1), "hi": F.when(X.occurrences(content, q) == 1, F.instr(content, q) - 1 + F.length(q))}
    quoted = per_quote(spark, root, once).select("finding_key", "book_slug", "unit_id", "lo", "hi")
    units = chapters(spark, root, "book_slug", "unit_id").drop("chapter_id").distinct()
    none = F.lit(None).cast("int")
    bare = findings(spark, root).where("source_anchor.quote IS NULL OR source_anchor.quote = ''").join(units, ["book_slug", "unit_id"], "left_semi").select("finding_key", "book_slug", "unit_id", none.alias("lo"), none.alias("hi"))
    return planning.prefix_disjoint(quoted.unionByName(bare), ["book_slug", "unit_id"], ["finding_key"], "lo", "hi", 8).select("finding_key", "book_slug", "unit_id")


def segment_cover(spark: SparkSession, root: str) -> DataFrame:
    """Spans laid one after another by their length, one with a null part of unknown length: where they do not cover their unit."""
    s = segments(spark, root).withColumn("n", F.length(F.concat("text_before", "source", "text_after")))
    line = Window.partitionBy("book_slug", "unit_id").orderBy("id", "segment_key")
    laid = s.withColumn("hi", F.sum(F.coalesce("n", F.lit(1))).over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumns({"lo": F.col("hi") - F.coalesce("n", F.lit(0)), "total": F.sum(F.coalesce("n", F.lit(1))).over(Window.partitionBy("book_slug", "unit_id"))})
    return planning.cover_faults(laid, ["book_slug", "unit_id"], "lo", "hi", "total").groupBy("book_slug", "fault").agg(F.count("*").alias("n"))


def source_paths(spark: SparkSession, root: str) -> DataFrame:
    """Every path that a chapter or a source document names, once, and how many do."""
    c = chapters(spark, root, "source_path").select(F.col("source_path").alias("path"))
    d = table(spark, root, "source_documents").dropDuplicates(["document_key"]).select("path")
    return c.unionByName(d).where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n"))


def drifted_titles(spark: SparkSession, root: str) -> DataFrame:
    """Fields in which the chapters differ from the last revision of their unit."""
    r = table(spark, root, "source_revisions").groupBy("book_slug", "unit_id").agg(F.max_by(F.struct("title", "chapter_no"), F.struct("revision_id", "delivered_at", "created_at", "title")).alias("r"))
    as_map = lambda t, n: F.create_map(F.lit("title"), F.coalesce(t, F.lit("")), F.lit("chapter_no"), n.cast("string"))
    c = chapters(spark, root, "book_slug", "unit_id", "title", "chapter_no").join(r, ["book_slug", "unit_id"])
    return c.select("chapter_id", F.array_join(X.drifted(as_map(F.col("title"), F.col("chapter_no")), as_map(F.col("r.title"), F.col("r.chapter_no"))), ",").alias("fields")).where("fields <> ''")


def record_classes(spark: SparkSession, root: str) -> DataFrame:
    """Review records by whether their category is the one of their book's latest record: current, superseded or stale."""
    f = findings(spark, root).where("record_id IS NOT NULL").groupBy("book_slug", "record_id").agg(F.max("reviewed_at").alias("at"), F.min("category").alias("category"))
    now = records.latest_by(f, ["book_slug"], ["at", "record_id"]).select("book_slug", "category")
    return records.classified(f, ["book_slug"], ["at", "record_id"], "record_id", ["category"], now).select("record_id", "classification", "duplicate_of")


def history_digests(spark: SparkSession, root: str) -> DataFrame:
    """One digest over the paths and texts of every book's revisions."""
    r = table(spark, root, "source_revisions").where("content IS NOT NULL").select("book_slug", F.concat_ws("/", "revision_id", "unit_id").alias("path"), "content").distinct()
    return editions.seal(r, "book_slug", ["path"], "content").select("book_slug", "n_units", "seal")


def finding_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The findings of each book as a snapshot named by its content."""
    f = findings(spark, root).where("detail IS NOT NULL")
    return editions.seal(f, "book_slug", ["record_id", "id", "category"], "detail").select("book_slug", F.col("n_units").alias("n_entries"), F.col("seal").alias("revision"))


def style_additions(spark: SparkSession, root: str) -> DataFrame:
    """Remarks of open findings that no resolved finding of the book has made: each once, with the first finding."""
    f = findings(spark, root).where("detail IS NOT NULL").select("book_slug", "detail", "finding_key", "resolved")
    return memory.append_missing(f.where("resolved"), f.where("NOT coalesce(resolved, false)").drop("resolved"), ["book_slug", "detail"], ["finding_key"])


def first_remarks(spark: SparkSession, root: str) -> DataFrame:
    """Every remark of a book once: from its resolved findings if they make it, else from the open ones."""
    f = findings(spark, root).where("detail IS NOT NULL").select("book_slug", "detail", "finding_key", F.coalesce("resolved", F.lit(False)).alias("resolved"))
    return memory.union_once(f.where("resolved"), f.where("NOT resolved"), ["book_slug", "detail"], ["finding_key"])


def grounded_quotes(spark: SparkSession, root: str) -> DataFrame:
    """Findings that quote both sides, by whether the quotes stand in the texts of their unit."""
    f = findings(spark, root).where("source_anchor IS NOT NULL AND translation_anchor IS NOT NULL").select("finding_key", "book_slug", "unit_id", F.col("source_anchor.quote").alias("a"), F.col("translation_anchor.quote").alias("b"))
    return memory.grounded(f, pairs(spark, root), ["book_slug", "unit_id"], "a", "b", "source", "target").select("finding_key", "state")


def term_updates(spark: SparkSession, root: str) -> DataFrame:
    """The titles of the revisions against those of the chapters, as terms with the book as their value: kept, inserted or in conflict."""
    current = chapters(spark, root, "book_slug", "title").where("title IS NOT NULL")
    rows = table(spark, root, "source_revisions").where("title IS NOT NULL").groupBy("title", "book_slug").agg(F.min("created_at").alias("at"))
    return memory.upsert_terms(current, rows, "title", "book_slug", ["at", "title", "book_slug"]).groupBy("state").agg(F.count("*").alias("n"))


def block_addresses(spark: SparkSession, root: str) -> DataFrame:
    """Quotes by the paragraph that holds them once, and which occurrence in the whole text they are."""

    def places(content: Column, q: Column, n: Column) -> dict[str, Column]:
        parts = F.split(content, "\n\n")
        starts = F.transform(parts, lambda p, i: F.struct((i + 1).alias("block"), F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x) + 2).alias("lo"), F.length(p).alias("n")))
        held = F.filter(starts, lambda b: F.contains(F.substring(content, b["lo"] + 1, b["n"]), q))
        return {"b": F.transform(held, lambda b: F.struct(b["block"].alias("block"), edits.global_occurrence(content, q, b["lo"], b["lo"] + b["n"]).alias("occurrence")))}

    return per_quote(spark, root, places).select("finding_key", F.explode("b").alias("b")).select("finding_key", "b.*")


def event_digests(spark: SparkSession, root: str) -> DataFrame:
    """The digest of every event's canonical form, without its time and value."""
    e = table(spark, root, "events")
    return e.select("event_id", F.sha2(X.canonical(event_type=F.col("event_type"), event_id=F.col("event_id"), user_id=F.col("user_id")), 256).alias("sha256"))


def unit_names(spark: SparkSession, root: str) -> DataFrame:
    """Units by name, or by number where the pending ones have no name yet."""
    c = chapters(spark, root, "unit_id", "chapter_no", "status")
    return c.select("chapter_id", X.unit_or_number(F.when(F.col("status") != "pending", F.col("unit_id")), F.col("chapter_no")).alias("name"))


def bounded_spans(spark: SparkSession, root: str) -> DataFrame:
    """Chapters in spans of at most 600 characters: how many, the longest, and whether they make up the text."""
    c = chapters(spark, root, "content").where("content IS NOT NULL").withColumn("s", edits.spans_within(F.col("content"), 600))
    text = F.filter("s", lambda x: x["kind"] == "text")
    return c.select("chapter_id", F.size(text).alias("n_spans"), F.array_max(F.transform(text, lambda x: F.length(x["value"]))).alias("longest"), (F.array_join(F.transform("s", lambda x: x["value"]), "") == F.col("content")).alias("exact"))


def reusable_windows(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs of each unit's last revision that the one before has at the same place with the same text, and no finding of the unit
    quotes."""
    r = table(spark, root, "source_revisions").groupBy("book_slug", "unit_id", "revision_id").agg(F.max(F.struct("delivered_at", "created_at", "title", "content")).alias("row"))
    ends = r.groupBy("book_slug").agg(F.max("revision_id").alias("hi"), F.max_by("revision_id", "revision_id").alias("x")).drop("x")
    before = r.select("book_slug", "revision_id").distinct().join(ends, "book_slug").where("revision_id < hi").groupBy("book_slug").agg(F.max("revision_id").alias("lo"))
    parts = r.select("book_slug", "unit_id", "revision_id", F.posexplode(F.split("row.content", "\n\n")).alias("part", "t")).select("book_slug", "unit_id", "revision_id", "part", F.sha2("t", 256).alias("h"))
    old = parts.join(before, "book_slug").where("revision_id = lo").drop("revision_id", "lo")
    new = parts.join(ends, "book_slug").where("revision_id = hi").drop("revision_id", "hi")
    open_ = findings(spark, root).where("NOT coalesce(resolved, false)").select("book_slug", "unit_id", F.lit(0).alias("part"))
    return records.reusable(old, new, ["book_slug", "unit_id"], "part", ["h"], open_).groupBy("book_slug").agg(F.count("*").alias("n_parts"), F.count_if("reuse").alias("n_reused"))


def glossary_contexts(spark: SparkSession, root: str) -> DataFrame:
    """The glossary as compact JSON, and its terms with two renderings."""
    g = spark.createDataFrame([(texts.GLOSSARY,)], "t string")
    clash = quality.glossary_conflicts(g.select(F.explode(quality.glossary_rows(F.col("t"))).alias("r")).select("r.original", "r.translation", F.lit("term").alias("type")))
    return g.select(F.length(quality.glossary_json(F.col("t"))).alias("n_chars"), F.size(quality.glossary_rows(F.col("t"))).alias("n_rows")).join(F.broadcast(clash.agg(F.count("*").alias("n_conflicts"))))


QUERIES = {
    f.__name__: f
    for f in (
        role_measures, unit_queues, book_status, book_reports, link_targets, review_counts, combined_reports, preflight_warnings, record_classes, history_digests, finding_snapshots, style_additions, first_remarks, grounded_quotes, term_updates, block_addresses, event_digests, unit_names,
        bounded_spans, reusable_windows, glossary_contexts, block_advisories, disjoint_findings, segment_cover, source_paths, drifted_titles,
    )
}

_C = "(SELECT DISTINCT ON (chapter_id) * FROM chapters)"
_F = "(SELECT DISTINCT ON (finding_key) * FROM findings)"
_R = "(SELECT DISTINCT ON (response_id) * FROM translator_responses)"
_RECORDS = f"(SELECT book_slug, unit_id, record_id, max(reviewed_at) AS at_, count(*) FILTER (NOT coalesce(resolved, false)) AS n_open FROM {_F} WHERE record_id IS NOT NULL GROUP BY 1, 2, 3)"
_SEALED = """SELECT book_slug, CAST(sum(k) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY x)) AS seal FROM (SELECT book_slug, left(d, 3) AS x, count(*) AS k, sha256(string_agg(d, '' ORDER BY d)) AS d FROM d GROUP BY 1, 2) GROUP BY 1"""
_STATUS = f"""WITH r AS (SELECT r.book_slug, r.unit_id, r.record_id, at_, n_open, at_ >= imported_at AS fresh FROM {_RECORDS} r JOIN {_C} c ON c.book_slug = r.book_slug AND c.unit_id = r.unit_id),
l AS (SELECT * FROM r WHERE fresh QUALIFY row_number() OVER (PARTITION BY book_slug, unit_id ORDER BY at_ DESC, record_id DESC) = 1),
s AS (SELECT c.book_slug, c.status, CASE WHEN c.status IN ('pending', 'extracted') THEN 'untranslated' WHEN l.n_open = 0 THEN 'pass' WHEN l.n_open > 0 THEN 'corrections_required' WHEN EXISTS (SELECT 1 FROM r WHERE r.book_slug = c.book_slug AND r.unit_id = c.unit_id) THEN 'stale' ELSE 'missing' END AS state
 FROM {_C} c LEFT JOIN l ON l.book_slug = c.book_slug AND l.unit_id = c.unit_id),
b AS (SELECT book_slug, count(*) AS n_units, {', '.join(f"count(*) FILTER (status = '{x}') AS n_{x}" for x in ('pending', 'extracted', 'translated', 'reviewed'))}, {', '.join(f"count(*) FILTER (state = '{x}') AS n_{x}" for x in ('pass', 'corrections_required', 'stale', 'missing', 'untranslated'))},
 round(count(*) FILTER (state = 'pass') * 100.0 / count(*), 2) AS coverage FROM s GROUP BY 1)"""
ORACLE = {
    "book_status": f"{_STATUS} SELECT * FROM b",
    "book_reports": f"""{_STATUS} SELECT book_slug, concat_ws(chr(10), '# ' || book_slug, '## Units', {', '.join(f"'- {x}: ' || n_{x}" for x in ('pending', 'extracted', 'translated', 'reviewed'))}, '## Gates',
 {', '.join(f"CASE WHEN n_{x} = 0 THEN '- [x]' ELSE '- [ ]' END || ' no unit is {x}'" for x in ('untranslated', 'missing', 'stale', 'corrections_required'))}) AS report FROM b""",
    "link_targets": rf"""WITH c AS (SELECT chapter_id, content, regexp_replace(content, '{texts._MARK}', '', 'g') AS bare FROM {_C} WHERE content IS NOT NULL),
e AS (SELECT chapter_id, unnest(regexp_extract_all(content, '{texts._LINK}', 3)) AS t, len(regexp_extract_all(bare, '{texts._LINK}')) > 0 AND len(list_filter(regexp_extract_all(bare, '{texts._LINK}'), lambda x: starts_with(x, '!'))) = 0
 AND len(list_filter(regexp_extract_all(bare, '{texts._LINK}', 3), lambda x: NOT regexp_matches(x, '^(?i)<?https?:'))) = 0 AND NOT regexp_matches(regexp_replace(bare, '{texts._LINK}', '', 'g'), '[^\s\p{{Z}}]') AS links_only FROM c)
SELECT links_only, CASE WHEN regexp_full_match(t, '(?i)www\.[^\s/?#]+\.[^\s]+') THEN replace(replace('https://' || t, '(', '%28'), ')', '%29') WHEN regexp_full_match(t, '(?i)https?://[^\s/?#]+\.?[^\s]*') THEN replace(replace(t, '(', '%28'), ')', '%29') ELSE 'inside' END AS href,
 count(*) AS n, count(DISTINCT chapter_id) AS n_chapters FROM e GROUP BY 1, 2""",
    "role_measures": f"""SELECT role_name, count(*) AS n_calls, count(*) FILTER (length(translation) > 0) AS n_answers, count(*) FILTER (outcome = 'rejected') AS n_rejected, count(*) FILTER (outcome = 'accepted') AS n_accepted, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
 CAST(sum(octet_length(encode(translation))) AS BIGINT) AS n_bytes, CAST(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS BIGINT) AS n_tokens FROM {_R} GROUP BY 1""",
    "unit_queues": f"""WITH l AS (SELECT * FROM {_RECORDS} QUALIFY row_number() OVER (PARTITION BY book_slug, unit_id ORDER BY at_ DESC, record_id DESC) = 1)
SELECT c.book_slug, CASE WHEN status = 'reviewed' THEN 'done' WHEN n_open > 0 THEN 'corrections' WHEN status = 'translated' THEN 'review' WHEN status = 'extracted' THEN 'translation' ELSE 'text' END AS queue, count(*) AS n FROM {_C} c LEFT JOIN l ON l.book_slug = c.book_slug AND l.unit_id = c.unit_id GROUP BY 1, 2""",
    "review_counts": f"SELECT book_slug, count(*) FILTER (n_open = 0) AS n_pass, count(*) FILTER (n_open > 0) AS n_corrections, count(DISTINCT unit_id) AS n_units FROM {_RECORDS} GROUP BY 1",
    "combined_reports": f"SELECT book_slug, unit_id, count(*) AS n_findings, count(DISTINCT (category, detail)) AS n_different, CASE WHEN bool_or(NOT coalesce(resolved, false)) THEN 'CORRECTIONS_REQUIRED' ELSE 'PASS' END AS outcome FROM {_F} GROUP BY 1, 2",
    "preflight_warnings": f"""SELECT translation_key, kind, value || ': ' || n AS detail FROM ({texts.ORACLE['number_differences']})
UNION ALL SELECT translation_key, 'structure', 'heading: source=' || source_headings || ', translation=' || target_headings FROM ({texts.ORACLE['structure_differences']}) WHERE source_headings <> target_headings
UNION ALL SELECT translation_key, 'structure', 'scene_break: source=' || source_breaks || ', translation=' || target_breaks FROM ({texts.ORACLE['structure_differences']}) WHERE source_breaks <> target_breaks
UNION ALL SELECT translation_key, kind, original || ' -> ' || translation FROM ({texts.ORACLE['glossary_mismatches']})""",
    "record_classes": f"""WITH f AS (SELECT book_slug, record_id, max(reviewed_at) AS at_, min(category) AS category FROM {_F} WHERE record_id IS NOT NULL GROUP BY 1, 2), n AS (SELECT book_slug, category AS now_ FROM f QUALIFY row_number() OVER (PARTITION BY book_slug ORDER BY at_ DESC, record_id DESC) = 1)
SELECT record_id, CASE WHEN category IS DISTINCT FROM now_ THEN 'stale' WHEN row_number() OVER (PARTITION BY f.book_slug, category ORDER BY at_ DESC, record_id DESC) = 1 THEN 'current' ELSE 'superseded' END AS classification, nullif(first_value(record_id) OVER (PARTITION BY f.book_slug, category ORDER BY at_, record_id), record_id) AS duplicate_of FROM f JOIN n USING (book_slug)""",
    "history_digests": f"""WITH d AS (SELECT DISTINCT book_slug, revision_id || '/' || unit_id AS path, content FROM source_revisions WHERE content IS NOT NULL), e AS (SELECT book_slug, sha256('{{"u0":"' || path || '","c":"' || sha256(content) || '"}}') AS d FROM d) SELECT book_slug, n AS n_units, seal FROM ({_SEALED.replace('FROM d GROUP', 'FROM e GROUP')})""",
    "finding_snapshots": f"""WITH d AS (SELECT book_slug, sha256('{{"u0":' || coalesce('"' || record_id || '"', 'null') || ',"u1":' || coalesce('"' || id || '"', 'null') || ',"u2":' || coalesce('"' || category || '"', 'null') || ',"c":"' || sha256(detail) || '"}}') AS d FROM {_F} WHERE detail IS NOT NULL) SELECT book_slug, n AS n_entries, seal AS revision FROM ({_SEALED})""",
    "style_additions": f"SELECT book_slug, detail, min(finding_key) AS finding_key FROM {_F} f WHERE detail IS NOT NULL AND NOT coalesce(resolved, false) AND NOT EXISTS (SELECT 1 FROM {_F} g WHERE g.resolved AND g.book_slug IS NOT DISTINCT FROM f.book_slug AND g.detail = f.detail) GROUP BY 1, 2",
    "first_remarks": f"SELECT book_slug, detail, finding_key, coalesce(resolved, false) AS resolved FROM {_F} WHERE detail IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_slug, detail ORDER BY coalesce(resolved, false) DESC, finding_key) = 1",
    "grounded_quotes": f"""SELECT finding_key, CASE WHEN p.source IS NULL AND p.target IS NULL THEN 'no_unit' WHEN NOT coalesce(contains(replace(lower(p.source), 'ß', 'ss'), replace(lower(f.source_anchor.quote), 'ß', 'ss')), false) THEN 'source_missing'
 WHEN NOT coalesce(contains(replace(lower(p.target), 'ß', 'ss'), replace(lower(f.translation_anchor.quote), 'ß', 'ss')), false) THEN 'target_missing' ELSE 'grounded' END AS state
FROM {_F} f LEFT JOIN ({PAIRS_SQL}) p ON p.book_slug = f.book_slug AND p.unit_id = f.unit_id WHERE f.source_anchor IS NOT NULL AND f.translation_anchor IS NOT NULL""",
    "block_advisories": rf"""WITH p AS (SELECT translation_key, regexp_split_to_array(source, '\n[ \t]*\n') AS a, regexp_split_to_array(target, '\n[ \t]*\n') AS b FROM ({PAIRS_SQL})), e AS (SELECT translation_key, unnest(range(0, len(a))) AS block_no, a, b FROM p WHERE len(a) = len(b))
SELECT DISTINCT translation_key, CAST(block_no AS INTEGER) AS block_no, original, translation FROM e, {texts._GLOSSARY_SQL} g
WHERE regexp_matches(a[block_no + 1], '(?i)(^|[^\p{{L}}\p{{N}}_])' || original || '([^\p{{L}}\p{{N}}_]|$)') AND NOT contains(lower(b[block_no + 1]), lower(translation))""",
    "disjoint_findings": f"""WITH a AS (SELECT finding_key, f.book_slug, f.unit_id, f.source_anchor.quote AS q, content FROM {_F} f JOIN {_C} c ON c.book_slug = f.book_slug AND c.unit_id = f.unit_id),
p AS (SELECT *, CASE WHEN length(q) > 0 AND len(string_split(content, q)) = 2 THEN instr(content, q) - 1 END AS lo, row_number() OVER (PARTITION BY book_slug, unit_id ORDER BY finding_key) AS i FROM a),
b AS (SELECT book_slug, unit_id, min(i) AS bad FROM p WHERE lo IS NULL OR EXISTS (SELECT 1 FROM p o WHERE o.book_slug = p.book_slug AND o.unit_id = p.unit_id AND o.i < p.i AND p.lo < o.lo + length(o.q) AND o.lo < p.lo + length(p.q)) GROUP BY 1, 2)
SELECT finding_key, p.book_slug, p.unit_id FROM p LEFT JOIN b ON b.book_slug = p.book_slug AND b.unit_id = p.unit_id WHERE i = 1 OR (i <= 8 AND (bad IS NULL OR i < bad))""",
    "segment_cover": """WITH s AS (SELECT DISTINCT ON (segment_key) * FROM structural_segments), n AS (SELECT *, length(text_before || source || text_after) AS n FROM s),
l AS (SELECT *, sum(coalesce(n, 1)) OVER (PARTITION BY book_slug, unit_id ORDER BY id, segment_key ROWS UNBOUNDED PRECEDING) AS hi FROM n), m AS (SELECT *, hi - coalesce(n, 0) AS lo FROM l),
w AS (SELECT *, lag(hi) OVER (PARTITION BY book_slug, unit_id ORDER BY lo, hi) AS before, sum(coalesce(n, 1)) OVER (PARTITION BY book_slug, unit_id) AS total, lead(lo) OVER (PARTITION BY book_slug, unit_id ORDER BY lo, hi) AS next_ FROM m),
f AS (SELECT book_slug, unnest([CASE WHEN lo >= hi THEN 'empty' END, CASE WHEN before IS NULL AND lo <> 0 THEN 'beginning' END, CASE WHEN next_ IS NULL AND hi <> total THEN 'end' END, CASE WHEN lo > before THEN 'gap' END, CASE WHEN lo < before THEN 'overlap' END]) AS fault FROM w)
SELECT book_slug, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1, 2""",
    "source_paths": f"SELECT path, count(*) AS n FROM (SELECT source_path AS path FROM {_C} UNION ALL SELECT path FROM (SELECT DISTINCT ON (document_key) * FROM source_documents)) WHERE path IS NOT NULL GROUP BY 1",
    "drifted_titles": f"""WITH r AS (SELECT book_slug, unit_id, title, chapter_no FROM source_revisions QUALIFY row_number() OVER (PARTITION BY book_slug, unit_id ORDER BY revision_id DESC, delivered_at DESC, created_at DESC, title DESC NULLS LAST) = 1)
SELECT * FROM (SELECT chapter_id, array_to_string(list_filter([CASE WHEN c.chapter_no <> r.chapter_no THEN 'chapter_no' END, CASE WHEN coalesce(c.title, '') <> coalesce(r.title, '') THEN 'title' END], lambda x: x IS NOT NULL), ',') AS fields FROM {_C} c JOIN r ON r.book_slug = c.book_slug AND r.unit_id = c.unit_id) WHERE fields <> ''""",
    "event_digests": """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' || chr(10)) AS sha256 FROM events""",
    "unit_names": f"SELECT chapter_id, coalesce(CASE WHEN status <> 'pending' THEN unit_id END, printf('chapter-%06d', chapter_no)) AS name FROM {_C}",
    "block_addresses": f"""WITH j AS (SELECT finding_key, f.source_anchor.quote AS q, content, string_split(content, chr(10) || chr(10)) AS p FROM {_F} f JOIN {_C} c ON c.book_slug = f.book_slug AND c.unit_id = f.unit_id WHERE f.source_anchor.quote <> '' AND contains(content, f.source_anchor.quote)),
e AS (SELECT *, unnest(range(1, len(p) + 1)) AS block FROM j), b AS (SELECT *, coalesce(list_sum(list_transform(p[1:block - 1], lambda x: length(x) + 2)), 0) AS lo FROM e WHERE contains(p[block], q)),
a AS (SELECT finding_key, block, q, content, (length(p[block]) - length(replace(p[block], q, ''))) // length(q) AS k, CAST(lo + instr(p[block], q) - 1 AS BIGINT) AS at_ FROM b),
n AS (SELECT *, (at_ - length(replace(left(content, at_), q, ''))) // length(q) AS n FROM a)
SELECT finding_key, CAST(block AS INTEGER) AS block, CASE WHEN k = 1 AND list_sum(list_transform(string_split(content, q)[1:n + 1], lambda x: length(x))) + n * length(q) = at_ AND len(string_split(content, q)) - 1 > n THEN CAST(n AS INTEGER) END AS occurrence FROM n""",
    "reusable_windows": f"""WITH r AS (SELECT book_slug, revision_id, unit_id, content FROM source_revisions QUALIFY row_number() OVER (PARTITION BY book_slug, revision_id, unit_id ORDER BY delivered_at DESC, created_at DESC) = 1),
v AS (SELECT book_slug, revision_id, row_number() OVER (PARTITION BY book_slug ORDER BY revision_id DESC) AS k FROM (SELECT DISTINCT book_slug, revision_id FROM r)),
p AS (SELECT r.book_slug, r.unit_id, v.k, string_split(content, chr(10) || chr(10)) AS t FROM r JOIN v ON v.book_slug = r.book_slug AND v.revision_id = r.revision_id WHERE k <= 2), e AS (SELECT book_slug, unit_id, k, t, unnest(range(1, len(t) + 1)) AS i FROM p)
SELECT n.book_slug, count(*) AS n_parts, count(*) FILTER (o.i IS NOT NULL AND NOT (n.i = 1 AND EXISTS (SELECT 1 FROM {_F} f WHERE NOT coalesce(f.resolved, false) AND f.book_slug = n.book_slug AND f.unit_id = n.unit_id))) AS n_reused
FROM (SELECT * FROM e WHERE k = 1) n LEFT JOIN (SELECT * FROM e WHERE k = 2) o ON o.book_slug = n.book_slug AND o.unit_id = n.unit_id AND o.i = n.i AND o.t[o.i] = n.t[n.i] GROUP BY 1""",
}
