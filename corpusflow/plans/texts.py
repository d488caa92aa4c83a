"""Queries over texts: fingerprints, structure, comparison with translations, repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusflow.functions import text as X
from corpusflow.operators import editions, planning, quality
from corpusflow.plans.tables import PAIRS_SQL, chapters, pairs, segments
from corpusflow.session import table
from corpusflow.sources import markup

#: A glossary as it is kept, in a Markdown table.
GLOSSARY = r"""| Original | Translation | Type | Notes |
|---|---|---|---|
| iron key | железный ключ | term | |
| copper lantern | медный фонарь | term | of the harbour |
| honey cake | медовый пирог | term | |
| star chart | звёздную карту | term | |
| old piano | старое пианино | term | |
| toll collector | сборщик пошлин | role | |
| chess board | шахматную доску | term | |
| iron key | iron \| key | note | two names |
| Mizu | Mizu | name | |
"""
_GLOSSARY_SQL = r"""(SELECT trim(replace(c[2], '\|', '|')) AS original, trim(replace(c[3], '\|', '|')) AS translation FROM (SELECT string_split(replace(line, '\|', chr(1)), '|') AS c FROM (SELECT unnest(string_split('{}', chr(10))) AS line))
WHERE len(c) >= 4 AND trim(c[2]) NOT IN ('', 'Original') AND NOT regexp_matches(c[2], '^[-:\s]+$'))""".replace("'\\|', '|'", "chr(1), '|'").format(GLOSSARY.replace("'", "''"))
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def document_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("n_chars"), F.size(X.tokens(F.col("text"))).alias("n_tokens"))


def duplicate_documents(spark: SparkSession, root: str) -> DataFrame:
    """Groups of equal texts: how many, and the least id. Only digests are shuffled."""
    d = table(spark, root, "documents").where("text IS NOT NULL")
    return d.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


def document_words(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").where("text IS NOT NULL")
    w = X.words(F.col("text"))
    return d.select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))


def title_slugs(spark: SparkSession, root: str) -> DataFrame:
    c = chapters(spark, root, "title", "chapter_no")
    return c.select("chapter_id", X.slugify(F.col("title")).alias("slug"), X.stable_slug(F.col("title"), 16).alias("short_slug"), X.unit_id(F.col("chapter_no")).alias("canonical_unit"))


def chapter_structure(spark: SparkSession, root: str) -> DataFrame:
    c = chapters(spark, root, "content")
    t = F.col("content")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return c.select("chapter_id", count(X.HEADING).alias("n_headings"), count(X.SCENE_BREAK).alias("n_breaks"), count(X.MARKER).alias("n_markers"), X.paragraph_count(t).alias("n_paragraphs"), X.line_count(t).alias("n_lines"))


def number_differences(spark: SparkSession, root: str) -> DataFrame:
    return quality.number_differences(pairs(spark, root), ["translation_key"], "source", "target")


def structure_differences(spark: SparkSession, root: str) -> DataFrame:
    p = pairs(spark, root).select("translation_key", *[c.alias(n) for n, c in quality.structure_counts(F.col("source"), F.col("target")).items()])
    return p.where("source_headings <> target_headings OR source_breaks <> target_breaks OR source_markers <> target_markers")


def coverage_alerts(spark: SparkSession, root: str) -> DataFrame:
    s, t = F.col("source"), F.col("target")
    p = pairs(spark, root)
    return p.select("translation_key", F.length(s).alias("source_chars"), F.length(t).alias("target_chars"), quality.coverage_alert(s, t, 1200, 3, 95).alias("by_paragraphs"), quality.lines_alert(s, t, 1200, 95).alias("by_lines"))


def glossary_mismatches(spark: SparkSession, root: str) -> DataFrame:
    glossary = spark.createDataFrame([(GLOSSARY,)], "t string").select(F.explode(quality.glossary_rows(F.col("t"))).alias("r")).select("r.*")
    return quality.glossary_mismatches(pairs(spark, root), ["translation_key"], "source", "target", glossary)


def marker_sequences(spark: SparkSession, root: str) -> DataFrame:
    """Units whose links or markers differ in number or order from those of their translation."""
    s, t = F.col("source"), F.col("target")
    same = pairs(spark, root).select("translation_key", quality.same_sequence(s, t, X.MARKER).alias("markers"), quality.same_sequence(s, t, X.LINK).alias("links"))
    return same.where("NOT (markers AND links)")


def echoed_phrases(spark: SparkSession, root: str) -> DataFrame:
    """Phrases of two to four words that a document says twice in a row."""
    d = table(spark, root, "documents").where("text IS NOT NULL").withColumn("w", X.words(F.col("text")))
    return d.select("doc_id", F.explode(quality.adjacent_repeats(F.col("w"))).alias("phrase")).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def repeated_phrases(spark: SparkSession, root: str) -> DataFrame:
    """Phrases of five words that one chapter holds twice or more."""
    c = chapters(spark, root, "content").withColumn("w", X.words(F.col("content")))
    return quality.phrase_counts(c, ["chapter_id"], "w", 5).where("n > 1")


def _successive(spark: SparkSession, root: str) -> DataFrame:
    """Content of each unit in a revision and in the book's next one that has the unit. Revisions are compared by their digests; texts
    are moved only where those differ."""
    r = table(spark, root, "source_revisions").select("book_slug", "unit_id", "revision_id", "delivered_at", "created_at", "title", "content")
    line = ["delivered_at", "created_at", "title", "h"]
    hashed = r.withColumn("h", F.sha2("content", 256))
    one = hashed.groupBy("book_slug", "unit_id", "revision_id").agg(F.max(F.struct(*line)).alias("row"))
    order = Window.partitionBy("book_slug", "unit_id").orderBy("revision_id")
    pairs = one.select("book_slug", "unit_id", "revision_id", F.col("row.h").alias("after_h"), F.lag("row.h").over(order).alias("before_h"), F.lag("revision_id").over(order).alias("before_id"))
    changed = pairs.where("before_h <> after_h")
    text = hashed.select(F.col("book_slug").alias("b"), F.col("unit_id").alias("u"), F.col("revision_id").alias("r"), "h", "content").dropDuplicates(["b", "u", "r", "h"])
    at = lambda side, r, h: (F.col("book_slug") == F.col(f"{side}.b")) & (F.col("unit_id") == F.col(f"{side}.u")) & (F.col(r) == F.col(f"{side}.r")) & (F.col(h) == F.col(f"{side}.h"))
    both = changed.join(text.alias("new"), at("new", "revision_id", "after_h")).join(text.alias("old"), at("old", "before_id", "before_h"))
    return both.select("book_slug", "unit_id", "revision_id", F.col("new.content").alias("after"), F.col("old.content").alias("before"))


def revision_repetitions(spark: SparkSession, root: str) -> DataFrame:
    """Phrases that a revision of a unit made more frequent."""
    return quality.new_repetitions(_successive(spark, root), ["book_slug", "unit_id", "revision_id"], "before", "after")


def revision_changes(spark: SparkSession, root: str) -> DataFrame:
    """Which paragraphs a revision of a unit touched, and whether a look at them alone is enough."""
    c = quality.paragraph_changes(_successive(spark, root), ["book_slug", "unit_id", "revision_id"], "before", "after")
    mode = quality.change_mode(F.col("changed_fraction"), F.col("change_groups"), F.col("n_bytes"))
    return c.select("book_slug", "unit_id", "revision_id", mode.alias("mode"), "changed_fraction", "change_groups")


def edition_matches(spark: SparkSession, root: str) -> DataFrame:
    """Units of each book's first revision matched with those of its last: in order, by content and by title."""
    r = table(spark, root, "source_revisions").select("book_slug", "revision_id", "unit_id", F.struct("delivered_at", "created_at", "title", F.sha2("content", 256).alias("h"), "chapter_no").alias("row"))
    one = r.groupBy("book_slug", "revision_id", "unit_id").agg(F.max("row").alias("row")).select("book_slug", "revision_id", "unit_id", F.col("row.title").alias("title"), F.col("row.h").alias("h"), F.col("row.chapter_no").alias("chapter_no"))
    ends = one.groupBy("book_slug").agg(F.min("revision_id").alias("lo"), F.max("revision_id").alias("hi"))
    placed = one.join(ends, "book_slug")
    return editions.match_editions(placed.where("revision_id = lo"), placed.where("revision_id = hi"), "book_slug", "unit_id", "h", "title", "chapter_no")


def edition_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many units of each book are unchanged, changed, new and deleted between its first and its last revision."""
    return edition_matches(spark, root).groupBy("book_slug").agg(*[F.count_if(F.col("classification") == k).alias(f"n_{k}") for k in ("unchanged", "changed", "new", "deleted")])


def book_seals(spark: SparkSession, root: str) -> DataFrame:
    """One digest over the units of every book."""
    c = chapters(spark, root, "book_slug", "unit_id", "content").where("content IS NOT NULL")
    return editions.seal(c, "book_slug", ["unit_id"], "content")


def seal_differences(spark: SparkSession, root: str) -> DataFrame:
    """The units of each book's first revision against its last: those missing, unknown before, or different by digest."""
    r = table(spark, root, "source_revisions").select("book_slug", "revision_id", "unit_id", F.struct("delivered_at", "created_at", "title", F.sha2("content", 256).alias("h")).alias("row"))
    one = r.groupBy("book_slug", "revision_id", "unit_id").agg(F.max("row").alias("row")).select("book_slug", "revision_id", "unit_id", F.col("row.h").alias("h"))
    ends = one.groupBy("book_slug").agg(F.min("revision_id").alias("lo"), F.max("revision_id").alias("hi"))
    placed = one.join(ends, "book_slug")
    return editions.verify_seal(placed.where("revision_id = lo"), placed.where("revision_id = hi"), "book_slug", "unit_id", "h")


def hash_audit(spark: SparkSession, root: str) -> DataFrame:
    """How the stored hashes of the chapters relate to their content, for each format."""
    c = chapters(spark, root, "source_format", "sha256", "content")
    return c.groupBy("source_format", editions.hash_state(F.col("sha256"), F.col("content")).alias("state")).agg(F.count("*").alias("n"))


def structure_spans(spark: SparkSession, root: str) -> DataFrame:
    """Per chapter: its parts by kind, and whether they make up its text again."""
    c = chapters(spark, root, "content").where("content IS NOT NULL").withColumn("p", markup.structure_parts("content"))
    kind = lambda k: F.size(F.filter("p", lambda x: x["kind"] == k))
    return c.select("chapter_id", kind("text").alias("n_text"), kind("link").alias("n_links"), kind("epub_marker").alias("n_markers"), (markup.rendered(F.col("p")) == F.col("content")).alias("exact"))


def markdown_sections(spark: SparkSession, root: str) -> DataFrame:
    c = chapters(spark, root, "title", "content").where("content IS NOT NULL")
    return c.select("chapter_id", F.posexplode(markup.markdown_sections(F.col("content"), F.coalesce("title", F.lit("Unit")))).alias("section_no", "s")).select("chapter_id", "section_no", "s.title", F.length("s.content").alias("n_chars"))


def marked_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of source documents written under markers and read back."""
    d = table(spark, root, "source_documents").dropDuplicates(["document_key"]).where("size(blocks) > 0")
    back = markup.marked_blocks(markup.numbered_blocks(F.transform("blocks", lambda b: F.coalesce(b, F.lit("")))))
    return d.select("document_key", F.size("blocks").alias("n_blocks"), F.size(back).alias("n_read"))


def review_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chapters of more than 2000 characters in even pieces cut at paragraph ends."""
    c = chapters(spark, root, "content").where("length(content) > 2000")
    count = F.ceil(F.length("content") / 2000).cast("int")
    cuts = c.select("chapter_id", count.alias("k"), planning.paragraph_cuts(F.col("content"), count, 200).alias("cuts"))
    return cuts.select("chapter_id", "k", F.size(F.coalesce("cuts", F.array().cast("array<int>"))).alias("n_cuts"), F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("cuts") - 1, F.lit(1))), lambda i: F.get("cuts", i) - F.get("cuts", i - 1))), F.lit(0)).alias("longest"))


def span_batches(spark: SparkSession, root: str) -> DataFrame:
    """Spans of every unit in batches of at most 24 spans and 3500 characters."""
    s = segments(spark, root).where("source IS NOT NULL").withColumn("size", F.length("source"))
    b = planning.batches_within(s, ["book_slug", "unit_id"], ["id", "segment_key"], "size", 24, 3500)
    return b.groupBy("book_slug", "unit_id", "batch_no").agg(F.count("*").alias("n_spans"), F.sum("size").alias("n_chars"))


def next_spans(spark: SparkSession, root: str) -> DataFrame:
    """The first spans of every unit within 6 spans and 1500 characters."""
    s = segments(spark, root).where("source IS NOT NULL")
    p = planning.prefix_within(s, ["book_slug", "unit_id"], ["id", "segment_key"], F.length("source"), 6, 1500)
    return p.select("segment_key", "book_slug", "unit_id", "id")


def incomplete_answers(spark: SparkSession, root: str) -> DataFrame:
    """Answers that are short for their span."""
    s = segments(spark, root).select("book_slug", "unit_id", F.col("id").alias("segment_id"), "source").dropDuplicates(["book_slug", "unit_id", "segment_id"])
    r = table(spark, root, "translator_responses").dropDuplicates(["response_id"]).select("response_id", "book_slug", "unit_id", "segment_id", "translation")
    return r.join(s, ["book_slug", "unit_id", "segment_id"]).where(quality.incomplete_span(F.col("source"), F.col("translation"), 120)).select("response_id")


def utc_times(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", X.parse_utc(F.col("iso")).cast(T.LongType()).alias("seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        document_fingerprints, duplicate_documents, document_words, title_slugs, chapter_structure, number_differences, structure_differences, coverage_alerts, glossary_mismatches,
        marker_sequences, echoed_phrases, repeated_phrases, revision_repetitions, revision_changes, edition_matches, edition_counts, book_seals, seal_differences, hash_audit, structure_spans, markdown_sections,
        marked_blocks, review_chunks, span_batches, next_spans, incomplete_answers, utc_times,
    )
}

_CH = "(SELECT DISTINCT {} FROM chapters)"
_WORDS = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{N}}]+)*')"
_HEAD, _BREAK, _MARK = r"(?m)^#{1,6}[ \t]+\S", r"(?m)^[ \t]*(?:\* ?\* ?\*|- ?- ?-|_{3,})[ \t]*$", r"<!--\s*bt-(?:anchor|block|inline|media):[^>]*-->"
_PARAS = r"len(list_filter(regexp_split_to_array({}, '\n\s*\n'), lambda p: regexp_matches(p, '[^\s\p{{Z}}]')))"
_LINES = r"len(list_filter(regexp_split_to_array({}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda p: regexp_matches(p, '[^\s\p{{Z}}]')))"
_N = "len(regexp_extract_all({}, '{}'))"
_SLUG = r"CASE WHEN {0} = '' THEN 'book' ELSE {0} END"
_SLUG0 = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}_\s\p{Z}-]', '', 'g'), '[\s\p{Z}_]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g')"
_REV = "SELECT book_slug, revision_id, unit_id, title, content FROM source_revisions QUALIFY row_number() OVER (PARTITION BY book_slug, revision_id, unit_id ORDER BY delivered_at DESC, created_at DESC) = 1"

_LINK = r"(!?)\[([^\]\n]*)\]\((<[^>\n]+>|[^)\s]+)([ \t]+[^)\n]*)?\)"
_LETTERED = r"[\p{L}\p{N}_]*(?:\p{L}|\p{Nl}|\p{No}|_)[\p{L}\p{N}_]*"  # words that are more than digits
_MATCHES = f"""WITH one AS ({_REV}), e AS (SELECT book_slug, min(revision_id) AS lo, max(revision_id) AS hi FROM one GROUP BY 1),
k AS (SELECT o.*, sha256(content) AS h, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS t, revision_id = lo AS is_old, revision_id = hi AS is_new FROM one o JOIN e USING (book_slug)),
a AS (SELECT *, count(*) OVER (PARTITION BY book_slug, h) AS nh FROM k WHERE is_old), b AS (SELECT *, count(*) OVER (PARTITION BY book_slug, h) AS nh FROM k WHERE is_new),
s AS (SELECT a.book_slug, a.unit_id AS o, b.unit_id AS n FROM a JOIN b ON a.book_slug = b.book_slug AND a.h = b.h AND a.nh = 1 AND b.nh = 1),
a2 AS (SELECT *, count(*) OVER (PARTITION BY book_slug, t) AS nt FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.book_slug = a.book_slug AND s.o = a.unit_id)),
b2 AS (SELECT *, count(*) OVER (PARTITION BY book_slug, t) AS nt FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.book_slug = b.book_slug AND s.n = b.unit_id)),
m AS (SELECT a2.book_slug, a2.unit_id AS o, b2.unit_id AS n FROM a2 JOIN b2 ON a2.book_slug = b2.book_slug AND a2.t = b2.t AND a2.nt = 1 AND b2.nt = 1),
x AS (SELECT book_slug, o AS old_unit, n AS new_unit, 'unchanged' AS classification FROM s UNION ALL SELECT book_slug, o, n, 'changed' FROM m
 UNION ALL SELECT book_slug, unit_id, NULL, 'deleted' FROM a2 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.book_slug = a2.book_slug AND m.o = a2.unit_id)
 UNION ALL SELECT book_slug, NULL, unit_id, 'new' FROM b2 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.book_slug = b2.book_slug AND m.n = b2.unit_id))"""
_SUCCESSIVE = f"SELECT * FROM (SELECT book_slug, unit_id, revision_id, content AS after, lag(content) OVER (PARTITION BY book_slug, unit_id ORDER BY revision_id) AS before FROM ({_REV})) WHERE before <> after"

ORACLE = {
    "revision_repetitions": f"""WITH s AS (SELECT book_slug, unit_id, revision_id, {_WORDS.format('before')} AS b, {_WORDS.format('after')} AS a FROM ({_SUCCESSIVE})),
n AS (SELECT *, unnest(range(2, 13)) AS n FROM s),
p AS (SELECT *, unnest(range(1, len(a) - n + 2)) AS i FROM n WHERE len(a) >= n),
g AS (SELECT DISTINCT book_slug, unit_id, revision_id, n, a[i:i + n - 1] AS p, b, a FROM p),
c AS (SELECT *, CASE WHEN n < 5 THEN len(list_filter(range(1, len(b) - 2 * n + 2), lambda k: b[k:k + n - 1] = p AND b[k + n:k + 2 * n - 1] = p)) ELSE len(list_filter(range(1, len(b) - n + 2), lambda k: b[k:k + n - 1] = p)) END AS previous,
 CASE WHEN n < 5 THEN len(list_filter(range(1, len(a) - 2 * n + 2), lambda k: a[k:k + n - 1] = p AND a[k + n:k + 2 * n - 1] = p)) ELSE len(list_filter(range(1, len(a) - n + 2), lambda k: a[k:k + n - 1] = p)) END AS now FROM g),
k AS (SELECT * FROM c WHERE now > previous AND (n < 5 OR now > 1))
SELECT book_slug, unit_id, revision_id, array_to_string(p, ' ') AS phrase, CAST(previous AS INTEGER) AS previous, CAST(now AS INTEGER) AS now, n < 5 AS adjacent FROM k
WHERE NOT EXISTS (SELECT 1 FROM k q WHERE q.book_slug = k.book_slug AND q.unit_id = k.unit_id AND q.revision_id = k.revision_id AND q.n > k.n AND contains(' ' || array_to_string(q.p, ' ') || ' ', ' ' || array_to_string(k.p, ' ') || ' '))""",
    "document_fingerprints": r"SELECT doc_id, sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS n_chars, CASE WHEN text IS NULL THEN -1 ELSE len(regexp_extract_all(nfc_normalize(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) END AS n_tokens FROM documents",
    "duplicate_documents": "SELECT sha256(text) AS sha256, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "document_words": f"SELECT doc_id, len({_WORDS.format('text')}) AS n_words, len(list_distinct({_WORDS.format('text')})) AS n_distinct FROM documents WHERE text IS NOT NULL",
    "title_slugs": f"SELECT chapter_id, {_SLUG.format(_SLUG0)} AS slug, regexp_replace(left({_SLUG.format(_SLUG0)}, 16), '-+$', '') AS short_slug, printf('chapter-%06d', chapter_no) AS canonical_unit FROM {_CH.format('chapter_id, title, chapter_no')}",
    "chapter_structure": f"SELECT chapter_id, {_N.format('content', _HEAD)} AS n_headings, {_N.format('content', _BREAK)} AS n_breaks, {_N.format('content', _MARK)} AS n_markers, {_PARAS.format('content')} AS n_paragraphs, {_LINES.format('content')} AS n_lines FROM {_CH.format('chapter_id, content')}",
    "coverage_alerts": f"""SELECT translation_key, CAST(length(source) AS INTEGER) AS source_chars, CAST(length(target) AS INTEGER) AS target_chars,
  length(source) >= 1200 AND {_PARAS.format('source')} >= 3 AND length(target) * 100 < length(source) * 95 AND {_PARAS.format('target')} * 100 < {_PARAS.format('source')} * 95 AS by_paragraphs,
  length(source) >= 1200 AND length(target) * 100 < length(source) * 95 AND {_LINES.format('target')} * 100 < {_LINES.format('source')} * 95 AS by_lines FROM ({PAIRS_SQL})""",
    "structure_differences": f"SELECT * FROM (SELECT translation_key, {', '.join(f'{_N.format(side, pattern)} AS {side}_{name}' for name, pattern in (('headings', _HEAD), ('breaks', _BREAK), ('markers', _MARK)) for side in ('source', 'target'))} FROM ({PAIRS_SQL})) WHERE source_headings <> target_headings OR source_breaks <> target_breaks OR source_markers <> target_markers",
    "glossary_mismatches": f"""SELECT translation_key, original, translation, CASE WHEN lower(original) = lower(translation) THEN 'glossary_decision_review' ELSE 'glossary_candidate' END AS kind
FROM ({PAIRS_SQL}) p, {_GLOSSARY_SQL} g WHERE contains(lower(source), lower(original)) AND NOT contains(lower(target), lower(translation))""",
    "echoed_phrases": f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, w, unnest([2, 3, 4]) AS k FROM w), i AS (SELECT doc_id, w, k, unnest(range(1, len(w) - 2 * k + 2)) AS i FROM s)
SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM i WHERE w[i:i + k - 1] = w[i + k:i + 2 * k - 1] GROUP BY 1, 2""",
    "repeated_phrases": f"""WITH w AS (SELECT chapter_id, {_WORDS.format('content')} AS w FROM {_CH.format('chapter_id, content')}), i AS (SELECT chapter_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
SELECT chapter_id, array_to_string(w[i:i + 4], ' ') AS phrase, count(*) AS n FROM i GROUP BY 1, 2 HAVING count(*) > 1""",
    "book_seals": f"""WITH d AS (SELECT book_slug, length(content) AS n, sha256('{{"u0":"' || unit_id || '","c":"' || sha256(content) || '"}}') AS d FROM {_CH.format('chapter_id, book_slug, unit_id, content')} WHERE content IS NOT NULL),
p AS (SELECT book_slug, left(d, 3) AS x, count(*) AS k, sum(n) AS n, sha256(string_agg(d, '' ORDER BY d)) AS d FROM d GROUP BY 1, 2)
SELECT book_slug, CAST(sum(k) AS BIGINT) AS n_units, CAST(sum(n) AS BIGINT) AS n_chars, sha256(string_agg(d, '' ORDER BY x)) AS seal FROM p GROUP BY 1""",
    "hash_audit": f"SELECT source_format, CASE WHEN sha256 IS NULL THEN 'missing' WHEN sha256 = sha256(content) THEN 'same' WHEN lower(sha256) = sha256(content) THEN 'other_case' WHEN NOT regexp_matches(sha256, '^[0-9a-fA-F]{{64}}$') THEN 'malformed' ELSE 'different' END AS state, count(*) AS n FROM {_CH.format('chapter_id, source_format, sha256, content')} GROUP BY 1, 2",
    "edition_matches": f"{_MATCHES} SELECT * FROM x",
    "edition_counts": f"{_MATCHES} SELECT book_slug, count(*) FILTER (classification = 'unchanged') AS n_unchanged, count(*) FILTER (classification = 'changed') AS n_changed, count(*) FILTER (classification = 'new') AS n_new, count(*) FILTER (classification = 'deleted') AS n_deleted FROM x GROUP BY 1",
    "seal_differences": f"""WITH one AS ({_REV}), e AS (SELECT book_slug, min(revision_id) AS lo, max(revision_id) AS hi FROM one GROUP BY 1),
a AS (SELECT o.* FROM one o JOIN e ON o.book_slug = e.book_slug AND revision_id = lo), b AS (SELECT o.* FROM one o JOIN e ON o.book_slug = e.book_slug AND revision_id = hi)
SELECT coalesce(a.book_slug, b.book_slug) AS book_slug, coalesce(a.unit_id, b.unit_id) AS unit_id, CASE WHEN b.unit_id IS NULL THEN 'missing' WHEN a.unit_id IS NULL THEN 'unknown' ELSE 'different' END AS problem
FROM a FULL JOIN b ON a.book_slug = b.book_slug AND a.unit_id = b.unit_id WHERE a.unit_id IS NULL OR b.unit_id IS NULL OR a.content IS DISTINCT FROM b.content""",
    "marked_blocks": "SELECT DISTINCT document_key, len(blocks) AS n_blocks, len(blocks) AS n_read FROM source_documents WHERE len(blocks) > 0",
    "span_batches": """WITH RECURSIVE s AS (SELECT book_slug, unit_id, length(source) AS z, row_number() OVER (PARTITION BY book_slug, unit_id ORDER BY id, segment_key) AS i FROM (SELECT DISTINCT segment_key, book_slug, unit_id, id, source FROM structural_segments WHERE source IS NOT NULL)),
r AS (SELECT book_slug, unit_id, i, z, 1 AS batch_no, 1 AS k, z AS total FROM s WHERE i = 1
 UNION ALL SELECT s.book_slug, s.unit_id, s.i, s.z, CASE WHEN r.k >= 24 OR r.total + s.z > 3500 THEN r.batch_no + 1 ELSE r.batch_no END, CASE WHEN r.k >= 24 OR r.total + s.z > 3500 THEN 1 ELSE r.k + 1 END, CASE WHEN r.k >= 24 OR r.total + s.z > 3500 THEN s.z ELSE r.total + s.z END
 FROM r JOIN s ON s.book_slug = r.book_slug AND s.unit_id = r.unit_id AND s.i = r.i + 1)
SELECT book_slug, unit_id, batch_no, count(*) AS n_spans, CAST(sum(z) AS BIGINT) AS n_chars FROM r GROUP BY 1, 2, 3""",
    "next_spans": """SELECT segment_key, book_slug, unit_id, id FROM (SELECT *, row_number() OVER w AS n, sum(length(source)) OVER w AS total FROM (SELECT DISTINCT segment_key, book_slug, unit_id, id, source FROM structural_segments WHERE source IS NOT NULL)
WINDOW w AS (PARTITION BY book_slug, unit_id ORDER BY id, segment_key ROWS UNBOUNDED PRECEDING)) WHERE n = 1 OR (n <= 6 AND total <= 1500)""",
    "number_differences": rf"""WITH p AS ({PAIRS_SQL}), n AS (SELECT translation_key, unnest(regexp_extract_all(regexp_replace(source, '{_LETTERED}', 'w', 'g'), '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*')) AS value, 1 AS d FROM p
 UNION ALL SELECT translation_key, unnest(regexp_extract_all(regexp_replace(target, '{_LETTERED}', 'w', 'g'), '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*')), -1 FROM p), s AS (SELECT translation_key, value, sum(d) AS d FROM n GROUP BY 1, 2)
SELECT translation_key, value, CASE WHEN d > 0 THEN 'number_missing' ELSE 'number_added' END AS kind, CAST(abs(d) AS INTEGER) AS n FROM s WHERE d <> 0""",
    "marker_sequences": f"SELECT * FROM (SELECT translation_key, regexp_extract_all(source, '{_MARK}') = regexp_extract_all(target, '{_MARK}') AS markers, regexp_extract_all(source, '{_LINK}') = regexp_extract_all(target, '{_LINK}') AS links FROM ({PAIRS_SQL})) WHERE NOT (markers AND links)",
    "structure_spans": rf"""SELECT chapter_id, CAST(len(list_filter(regexp_split_to_array(content, '{_LINK}|{_MARK}'), lambda x: regexp_matches(x, '[^\s\p{{Z}}]'))) AS INTEGER) AS n_text,
 CAST(len(list_filter(regexp_extract_all(content, '{_LINK}|{_MARK}'), lambda x: NOT starts_with(x, '<!--'))) AS INTEGER) AS n_links, CAST(len(list_filter(regexp_extract_all(content, '{_LINK}|{_MARK}'), lambda x: starts_with(x, '<!--'))) AS INTEGER) AS n_markers, true AS exact
FROM {_CH.format('chapter_id, content')} WHERE content IS NOT NULL""",
    "incomplete_answers": rf"""WITH s AS (SELECT DISTINCT ON (book_slug, unit_id, segment_id) book_slug, unit_id, id AS segment_id, source FROM structural_segments),
r AS (SELECT DISTINCT response_id, book_slug, unit_id, segment_id, translation FROM translator_responses),
j AS (SELECT response_id, length(source) AS n, length(translation) AS m, len(regexp_split_to_array(source, '\n[ \t]*\n')) AS p, len(regexp_split_to_array(translation, '\n[ \t]*\n')) AS q FROM r JOIN s USING (book_slug, unit_id, segment_id))
SELECT response_id FROM j WHERE n >= 120 AND (m * 100 < n * 55 OR (p >= 4 AND q * 100 < p * 60))""",
    "markdown_sections": rf"""WITH c AS (SELECT chapter_id, coalesce(title, 'Unit') AS title, regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM {_CH.format('chapter_id, title, content')} WHERE content IS NOT NULL),
h AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^#\s+\S')) AS a, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^##\s+\S')) AS b FROM c),
s AS (SELECT chapter_id, title, l, CASE WHEN len(a) >= 2 THEN a WHEN len(b) >= 2 THEN b ELSE [] END AS s FROM h),
e AS (SELECT chapter_id, title, l, s, unnest(CASE WHEN len(s) = 0 THEN [0] ELSE range(0, len(s) + 1) END) AS k FROM s),
x AS (SELECT chapter_id, k, CASE WHEN len(s) = 0 THEN title WHEN k = 0 THEN title || ' — front matter' ELSE {_STRIP.format("regexp_replace(l[s[k]], '^#{1,2}[ ]+', '')")} END AS title,
 {_STRIP.format("array_to_string(CASE WHEN len(s) = 0 THEN l WHEN k = 0 THEN l[1:s[1] - 1] WHEN k = len(s) THEN l[s[k]:] ELSE l[s[k]:s[k + 1] - 1] END, chr(10))")} AS t, len(s) AS n FROM e)
SELECT chapter_id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY k) - 1 AS INTEGER) AS section_no, title, CAST(length(t) + 1 AS INTEGER) AS n_chars FROM x WHERE n = 0 OR t <> ''""",
    "utc_times": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events",
}
