"""Queries over edits, audits, ranges and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import edits, editions, planning
from corpusflow.plans.tables import PAIRS_SQL, chapters, findings, pairs, per_quote, segments
from corpusflow.session import table
from corpusflow.sinks import books
from corpusflow.sources import files, layout
from corpusflow.sources.markup import marked_blocks, numbered_blocks


def _quoted(spark: SparkSession, root: str) -> DataFrame:
    f = findings(spark, root).select("finding_key", "book_slug", "unit_id", F.col("source_anchor.quote").alias("q"), F.col("source_anchor.occurrence").alias("n")).where("q <> ''")
    return f.join(chapters(spark, root, "book_slug", "unit_id", "content"), ["book_slug", "unit_id"])


def patched_chapters(spark: SparkSession, root: str) -> DataFrame:
    """Chapters with the quote of their first finding replaced, where it stands there."""
    one = _quoted(spark, root).groupBy("chapter_id").agg(F.min_by(F.struct("q", "n", "content"), "finding_key").alias("x"))
    patches = F.array(F.struct(F.col("x.q").alias("quote"), F.col("x.n").alias("occurrence"), F.lit("[…]").alias("replacement")))
    done = one.select("chapter_id", edits.apply_patches(F.col("x.content"), patches).alias("t"))
    return done.where("t IS NOT NULL").select("chapter_id", F.sha2("t", 256).alias("sha256"))


def fully_patched_chapters(spark: SparkSession, root: str) -> DataFrame:
    """Chapters with the quotes of all their findings replaced, overlapping ones together, and how many findings have a place there."""
    f = findings(spark, root).select("book_slug", "unit_id", F.struct(F.col("source_anchor.quote").alias("quote"), F.col("source_anchor.occurrence").alias("occurrence")).alias("p")).where("p.quote <> ''")
    c = f.groupBy("book_slug", "unit_id").agg(F.collect_list("p").alias("p")).join(chapters(spark, root, "book_slug", "unit_id", "content"), ["book_slug", "unit_id"])
    done = c.select("chapter_id", F.size("p").alias("n_findings"), edits.replace_places(F.col("content"), F.col("p"), F.lit("[…]")).alias("x")).where("x.n_placed > 0")
    return done.select("chapter_id", "n_findings", "x.n_placed", F.sha2("x.text", 256).alias("sha256"))


def quote_excerpts(spark: SparkSession, root: str) -> DataFrame:
    """Every quote that stands in its unit, with forty characters on both sides."""

    def around(content: Column, q: Column, n: Column) -> dict[str, Column]:
        at = X.nth_offset(content, q, n)
        return {"excerpt": F.when(at.isNotNull(), edits.excerpt(content, at, F.length(q), 40))}

    return per_quote(spark, root, around).where("excerpt IS NOT NULL").select("finding_key", "excerpt")


def quote_suggestions(spark: SparkSession, root: str) -> DataFrame:
    """Lines that resemble the quotes that do not stand in their unit."""
    lost = _quoted(spark, root).where(~F.contains("content", "q"))
    return lost.select("finding_key", F.posexplode(edits.suggestions("content", "q")).alias("rank", "s")).select("finding_key", "rank", "s.line", "s.ratio")


def findings_in_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Findings by the piece of their unit that holds the quote, pieces of about 1500 characters cut at paragraph ends."""
    points = per_quote(spark, root, lambda content, q, n: {"at": X.nth_offset(content, q, n)}).select("finding_key", "chapter_id", "at").where("at IS NOT NULL")
    c = chapters(spark, root, "content").where("length(content) > 1500")
    cuts = c.select("chapter_id", planning.paragraph_cuts(F.col("content"), F.ceil(F.length("content") / 1500).cast("int"), 100).alias("c")).where("c IS NOT NULL")
    ranges = cuts.select("chapter_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(i.alias("chunk"), F.get("c", i - 1).alias("lo"), F.get("c", i).alias("hi")))).alias("r")).select("chapter_id", "r.*")
    return edits.in_ranges(points, ranges, ["chapter_id"], "at", "lo", "hi").select("finding_key", "chapter_id", "chunk")


def masked_translations(spark: SparkSession, root: str) -> DataFrame:
    """Translations with the tokens of their source's links, where both have as many: how many tokens there are."""
    p = pairs(spark, root).select("translation_key", edits.masked_like("source", "target").alias("m"))
    return p.select("translation_key", F.size(F.regexp_extract_all("m", F.lit("⟦\\d+!?⟧"), F.lit(0))).alias("n_tokens"))


def unit_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """The findings of each unit as verdicts, approved where resolved, without risk where minor: how many can be read."""
    f = findings(spark, root).where("id IS NOT NULL")
    one = F.struct(F.col("id").alias("finding_id"), F.when(F.coalesce("resolved", F.lit(False)), "approve").otherwise("reject").alias("verdict"), F.when(F.col("severity") == "minor", "none").otherwise("meaning").alias("risk"))
    units = f.groupBy("book_slug", "unit_id").agg(F.to_json(F.struct(F.collect_list(one).alias("decisions"))).alias("answer"), F.collect_set("id").alias("ids"))
    read = F.size(F.map_keys(edits.parsed_verdicts(F.col("answer"), F.col("ids"))))
    return units.select("book_slug", "unit_id", F.coalesce(F.when(read >= 0, read), F.lit(0)).alias("n_read"))


def path_formats(spark: SparkSession, root: str) -> DataFrame:
    """Chapters by the format that their path's suffix names, and the one they are said to have."""
    c = chapters(spark, root, "source_path", "source_format")
    return c.groupBy(files.format_of(F.col("source_path")).alias("by_path"), "source_format").agg(F.count("*").alias("n"))


def expected_edits(spark: SparkSession, root: str) -> DataFrame:
    """Chapters with a finding's quote replaced, where it stands there exactly once."""
    done = per_quote(spark, root, lambda content, q, n: {"sha256": F.sha2(edits.replace_expected(content, q, F.lit("…"), F.lit(1)), 256)})
    return done.where("sha256 IS NOT NULL").select("finding_key", "sha256")


def line_ranges(spark: SparkSession, root: str) -> DataFrame:
    """The second to fourth line of every chapter."""
    return chapters(spark, root, "content").where("content IS NOT NULL").select("chapter_id", F.sha2(edits.line_range(F.col("content"), F.lit(2), F.lit(4)), 256).alias("sha256"))


def link_masks(spark: SparkSession, root: str) -> DataFrame:
    """Chapters with masked link targets, and whether unmasking gives them back."""
    c = chapters(spark, root, "content").where("content IS NOT NULL").withColumn("m", edits.masked("content"))
    return c.select("chapter_id", F.size("m.links").alias("n_links"), (edits.unmasked("m.text", "m.links") == F.col("content")).alias("exact"))


def plain_chapters(spark: SparkSession, root: str) -> DataFrame:
    """Length of every chapter without Markdown's marks."""
    return chapters(spark, root, "content").select("chapter_id", F.length(edits.plain_prose(F.col("content"))).alias("n_chars"))


def block_audit(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of the blocks of every source document against those of its text with markers, read back."""
    d = table(spark, root, "source_documents").dropDuplicates(["document_key"]).where("size(blocks) > 0").withColumn("b", F.transform("blocks", lambda b: F.coalesce(b, F.lit(""))))
    d = d.withColumn("expected", F.array_join("b", " ")).withColumn("actual", F.array_join(F.transform(marked_blocks(numbered_blocks(F.col("b"))), lambda x: x["text"]), " "))
    return edits.token_audit(d, ["document_key"], "expected", "actual")


def selected_units(spark: SparkSession, root: str) -> DataFrame:
    """Chapters of the units that some selectors name."""
    s = spark.createDataFrame([("3",), ("5-7",), ("9-8",), ("x",)], "selector string")
    named = s.select("selector", F.explode(edits.selected_units(F.col("selector"))).alias("unit_id"))
    return chapters(spark, root, "unit_id").join(F.broadcast(named), "unit_id").groupBy("selector", "unit_id").agg(F.count("*").alias("n"))


def span_values(spark: SparkSession, root: str) -> DataFrame:
    """Spans by their place in the unit: the digest of the text, null where they differ, and how many different ones there are."""
    s = segments(spark, root).where("source IS NOT NULL")
    return edits.merged_parts(s.withColumn("h", F.sha2("source", 256)), ["book_slug", "unit_id", "id"], "h")


def book_archives(spark: SparkSession, root: str) -> DataFrame:
    """An EPUB of each book's reviewed chapters, made, read again and checked."""
    made = books.check_epubs(_archives(spark, root)).withColumnRenamed("book", "book_slug")
    return made.select("book_slug", "n_units", "n_read", F.array_join("faults", "; ").alias("faults"))


def _archives(spark: SparkSession, root: str) -> DataFrame:
    c = chapters(spark, root, "book_slug", "chapter_no", "title", "content", "status").where("status = 'reviewed' AND content IS NOT NULL")
    return books.epubs(c, "book_slug", "chapter_no", "title", "content")


def archive_spines(spark: SparkSession, root: str) -> DataFrame:
    """The documents of those archives in reading order: whether any holds an image, and how many."""
    s = files.spine(_archives(spark, root), "book", "epub")
    return s.groupBy(F.col("path").alias("book_slug")).agg(F.count("*").alias("n_documents"), F.max("pos").alias("last"), F.bool_or("has_image").alias("has_image"), F.countDistinct("name").alias("n_names"))


def archive_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """The digests of the documents of those archives."""
    f = files.fingerprints(files.spine(_archives(spark, root), "book", "epub"))
    return f.select(F.col("path").alias("book_slug"), "n_documents", F.size("digests").alias("n_digests"), F.col("first").isNotNull().alias("has_first"), F.sha2(F.array_join("digests", ""), 256).alias("sha256"))


def layout_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Those archives with every block's text in capitals: how many documents and blocks they have, and what would not let itself be
    exchanged, or was lost."""
    archives = _archives(spark, root)
    docs = layout.layout(archives, "book", "epub")
    texts = docs.where("kind = 'text'").select("book", "path", F.transform("blocks", lambda b: F.upper(b)).alias("blocks"))
    counts = docs.groupBy("book").agg(F.count("pos").alias("n_documents"), F.sum(F.size("blocks")).alias("n_blocks"))
    return layout.rebuild(archives, texts, "book", "epub").join(counts, "book").select(F.col("book").alias("book_slug"), "n_documents", "n_blocks", F.regexp_replace(F.coalesce("fault", F.lit("")), "^.*: ", "").alias("fault"))


def rendered_chapters(spark: SparkSession, root: str) -> DataFrame:
    """Chapters as XHTML: how many could be written, and why the others could not."""
    r = chapters(spark, root, "title", "content").where("content IS NOT NULL").select("chapter_id", books.rendered_xhtml("title", "content").alias("r"))
    return r.select("chapter_id", "r.status", F.regexp_replace("r.reason", "^.* (is|leads) ", "").alias("reason"))


def paired_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Units whose text and translation have as many paragraphs, cut into two before the same ones; those that hold block markers already
    are left alone."""
    p = pairs(spark, root).where(~F.col("source").rlike(r"<!--\s*bt-block:") & ~F.col("target").rlike(r"<!--\s*bt-block:")).withColumns({"a": X.paragraphs(F.col("source")), "b": X.paragraphs(F.col("target"))}).where("size(a) = size(b) AND size(a) >= 2")
    cuts = p.select("translation_key", planning.paired_chunks(numbered_blocks(F.col("a")), numbered_blocks(F.col("b")), F.lit(2)).alias("c"))
    first = F.get("c", F.lit(0))
    return cuts.where("c IS NOT NULL").select("translation_key", first["source_to"].alias("source_cut"), first["target_to"].alias("target_cut"), F.size("c").alias("n"))


def title_matches(spark: SparkSession, root: str) -> DataFrame:
    """Chapters found in the revisions: by book and title, else by title alone, where that is unique."""
    r = table(spark, root, "source_revisions").select("book_slug", X.identity_form("title").alias("t"), F.concat_ws("/", "book_slug", "unit_id").alias("revised")).where("t IS NOT NULL").distinct()
    c = chapters(spark, root, "book_slug", "title").select("chapter_id", "book_slug", X.identity_form("title").alias("t"))
    return editions.tiered_match(c, r, "chapter_id", "revised", [["book_slug", "t"], ["t"]])


QUERIES = {f.__name__: f for f in (patched_chapters, fully_patched_chapters, quote_excerpts, quote_suggestions, findings_in_chunks, masked_translations, unit_verdicts, path_formats, expected_edits, line_ranges, link_masks, plain_chapters, block_audit, selected_units, span_values, book_archives, archive_spines, archive_fingerprints, layout_round_trip, rendered_chapters, paired_chunks, title_matches)}

_F = "(SELECT DISTINCT ON (finding_key) finding_key, book_slug, unit_id, source_anchor FROM findings)"
_F2 = "(SELECT DISTINCT ON (finding_key) * FROM findings)"
_C = "(SELECT DISTINCT ON (chapter_id) * FROM chapters)"
_Q = f"SELECT f.finding_key, c.chapter_id, c.content, f.source_anchor.quote AS q, f.source_anchor.occurrence AS n FROM {_F} f JOIN {_C} c USING (book_slug, unit_id) WHERE f.source_anchor.quote <> ''"
_LINK = r"(!?)\[([^\]\n]*)\]\((<[^>\n]+>|[^)\s]+)([ \t]+[^)\n]*)?\)"
_AT = "CASE WHEN (length(content) - length(replace(content, q, ''))) // length(q) > n THEN list_sum(list_transform(string_split(content, q)[1:n + 1], lambda x: length(x))) + n * length(q) END"
ORACLE = {
    "patched_chapters": f"""SELECT chapter_id, sha256(left(content, CAST(at_ AS BIGINT)) || '[…]' || substr(content, CAST(at_ + length(q) + 1 AS BIGINT))) AS sha256
FROM (SELECT *, {_AT} AS at_ FROM ({_Q}) QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY finding_key) = 1) WHERE at_ IS NOT NULL""",
    "quote_excerpts": f"""SELECT finding_key, substr(content, CAST(greatest(0, at_ - 40) + 1 AS BIGINT), CAST(least(length(content), at_ + length(q) + 40) - greatest(0, at_ - 40) AS BIGINT)) AS excerpt FROM (SELECT *, {_AT} AS at_ FROM ({_Q})) WHERE at_ IS NOT NULL""",
    "selected_units": f"""SELECT s.selector, c.unit_id, count(*) AS n FROM (VALUES ('3', 3, 3), ('5-7', 5, 7)) s(selector, a, b) JOIN {_C} c ON CAST(right(c.unit_id, 6) AS INTEGER) BETWEEN a AND b GROUP BY 1, 2""",
    "title_matches": r"""WITH r AS (SELECT DISTINCT book_slug, trim(regexp_replace(lower(title), '[\s\p{Z}]+', ' ', 'g')) AS t, book_slug || '/' || unit_id AS v FROM source_revisions WHERE title IS NOT NULL),
c AS (SELECT DISTINCT chapter_id, book_slug, trim(regexp_replace(lower(title), '[\s\p{Z}]+', ' ', 'g')) AS t FROM chapters),
a AS (SELECT c.chapter_id, count(DISTINCT v) AS n_matches, min(v) AS v, 1 AS tier FROM c JOIN r ON r.book_slug = c.book_slug AND r.t = c.t GROUP BY 1),
b AS (SELECT c.chapter_id, count(DISTINCT v) AS n_matches, min(v) AS v, 2 AS tier FROM c JOIN r ON r.t = c.t WHERE c.chapter_id NOT IN (SELECT chapter_id FROM a) GROUP BY 1)
SELECT chapter_id, CASE WHEN n_matches = 1 THEN v END AS revised, CAST(tier AS INTEGER) AS tier, n_matches FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "span_values": "SELECT book_slug, unit_id, id, CASE WHEN count(DISTINCT source) = 1 THEN sha256(min(source)) END AS h, count(DISTINCT source) AS n_values FROM structural_segments WHERE source IS NOT NULL GROUP BY 1, 2, 3",
    "paired_chunks": rf"""WITH p AS (SELECT translation_key, regexp_split_to_array(source, '\n[ \t]*\n') AS a, regexp_split_to_array(target, '\n[ \t]*\n') AS b FROM ({PAIRS_SQL}) WHERE NOT regexp_matches(source, '<!--\s*bt-block:') AND NOT regexp_matches(target, '<!--\s*bt-block:')),
q AS (SELECT *, list_transform(a, lambda x: length(x) + 27) AS na, list_transform(b, lambda x: length(x) + 27) AS nb FROM p WHERE len(a) = len(b) AND len(a) >= 2),
k AS (SELECT translation_key, list_sum(na) + list_sum(nb) - 4 AS total, na, nb, unnest(range(1, len(a))) AS k FROM q),
c AS (SELECT translation_key, total, k, list_sum(na[1:k]) AS x, list_sum(nb[1:k]) AS y FROM k)
SELECT translation_key, CAST(x AS INTEGER) AS source_cut, CAST(y AS INTEGER) AS target_cut, 2 AS n FROM c QUALIFY row_number() OVER (PARTITION BY translation_key ORDER BY abs(x + y - total / 2.0), k) = 1""",
    "masked_translations": rf"""WITH n AS (SELECT translation_key, len(regexp_extract_all(source, '{_LINK}')) AS a, len(regexp_extract_all(target, '{_LINK}')) AS b FROM ({PAIRS_SQL})) SELECT translation_key, CAST(CASE WHEN a > 0 AND a = b THEN b ELSE 0 END AS INTEGER) AS n_tokens FROM n""",
    "unit_verdicts": f"SELECT book_slug, unit_id, CAST(CASE WHEN count(*) = count(DISTINCT id) AND bool_and(coalesce(resolved, false) = coalesce(severity = 'minor', false)) THEN count(*) ELSE 0 END AS INTEGER) AS n_read FROM {_F2} WHERE id IS NOT NULL GROUP BY 1, 2",
    "path_formats": f"""SELECT CASE regexp_extract(lower(source_path), '\\.([^./]+)$', 1) WHEN 'epub' THEN 'epub' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'xhtml' THEN 'xhtml' WHEN 'txt' THEN 'txt' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' END AS by_path, source_format, count(*) AS n FROM {_C} GROUP BY 1, 2""",
    "expected_edits": f"SELECT finding_key, sha256(replace(content, q, '…')) AS sha256 FROM ({_Q}) WHERE len(string_split(content, q)) = 2",
    "line_ranges": f"SELECT chapter_id, sha256(array_to_string(string_split(content, chr(10))[2:4], chr(10))) AS sha256 FROM {_C} WHERE content IS NOT NULL",
    "link_masks": rf"SELECT chapter_id, CAST(len(regexp_extract_all(content, '{_LINK}')) AS INTEGER) AS n_links, true AS exact FROM {_C} WHERE content IS NOT NULL",
    "plain_chapters": rf"""WITH a AS (SELECT chapter_id, regexp_replace(regexp_replace(replace(regexp_replace(content, '(?m)^[ \t]*#{{1,6}}[ \t]+', '', 'g'), '<!-- bt-scene-break -->', '  '), '(?m)^[ \t]*-[ \t]+', '', 'g'), '{_LINK}', '\2', 'g') AS t FROM {_C}),
b AS (SELECT chapter_id, regexp_replace(t, '(?m)^<!-- bt-(?:anchor|block):[A-Za-z0-9_.:-]* -->\s*\n?', '', 'g') AS t FROM a)
SELECT chapter_id, CAST(length(translate(regexp_replace(t, '\\([*`\[\]\\])', chr(57344), 'g'), '*`', '')) AS INTEGER) AS n_chars FROM b""",
    "fully_patched_chapters": f"""WITH RECURSIVE q AS ({_Q}), n AS (SELECT chapter_id, count(*) AS n_findings FROM q GROUP BY 1),
p AS (SELECT DISTINCT chapter_id, content, CAST({_AT} AS BIGINT) AS lo, CAST({_AT} + length(q) AS BIGINT) AS hi FROM q WHERE {_AT} IS NOT NULL),
m AS (SELECT chapter_id, count(*) AS n_placed FROM q WHERE {_AT} IS NOT NULL GROUP BY 1),
f AS (SELECT *, CASE WHEN lo < max(hi) OVER (PARTITION BY chapter_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM p),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY chapter_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM f),
s AS (SELECT chapter_id, content, k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY 1, 2, 3),
t AS (SELECT chapter_id, content, k, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY chapter_id ORDER BY k) AS before, max(k) OVER (PARTITION BY chapter_id) AS last FROM s),
u AS (SELECT chapter_id, string_agg(substr(content, before + 1, lo - before) || '[…]' || CASE WHEN k = last THEN substr(content, hi + 1) ELSE '' END, '' ORDER BY k) AS x FROM t GROUP BY 1)
SELECT u.chapter_id, CAST(n_findings AS INTEGER) AS n_findings, CAST(n_placed AS INTEGER) AS n_placed, sha256(x) AS sha256 FROM u JOIN n USING (chapter_id) JOIN m USING (chapter_id)""",
    "book_archives": f"SELECT book_slug, CAST(count(*) AS INTEGER) AS n_units, CAST(count(*) AS INTEGER) AS n_read, '' AS faults FROM {_C} WHERE status = 'reviewed' AND content IS NOT NULL GROUP BY 1",
    "archive_spines": f"SELECT book_slug, count(*) AS n_documents, CAST(count(*) - 1 AS INTEGER) AS last, false AS has_image, count(*) AS n_names FROM {_C} WHERE status = 'reviewed' AND content IS NOT NULL GROUP BY 1",
    "block_audit": r"SELECT DISTINCT ON (document_key) document_key, len(regexp_extract_all(nfc_normalize(array_to_string(list_transform(blocks, lambda b: coalesce(b, '')), ' ')), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n_expected, len(regexp_extract_all(nfc_normalize(array_to_string(list_transform(blocks, lambda b: coalesce(b, '')), ' ')), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n_actual, CAST(NULL AS BIGINT) AS mismatch FROM source_documents WHERE len(blocks) > 0",
}
