"""Rules of JSON documents, kind by kind, over a column of their texts.

A kind is a table of fields. Each field names what its value must be; the texts are parsed once, as variants, so that a boolean is never
taken for a number, and every rule is an expression over them. All rules that a document breaks come out, named by their field.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



class Exact(dict):
    """Fields of an object that may have no others."""


# Patterns and lists of the formats.
PATTERNS = {
    "sha256": "^[0-9a-f]{64}$",
    "commit": "^[0-9a-f]{40}$",
    "hex32": "^[0-9a-f]{32}$",
    "unit": "^chapter-[0-9]{6}$",
    "source": "^source-[0-9]{6}$",
    "finding": "^[a-z][a-z0-9-]{0,31}$",
    "memory": "^[a-z][a-z0-9-]{0,63}$",
    "time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|\+00:00)$",
    "name": r"^(?!\.{1,2}$)[^/\\]+$",
    "path": r"^(?!/)(?!(?:.*/)?\.{1,2}(?:/|$))[^\\]+$",
}
STATUSES = "pending extracted translated reviewed"
CATEGORIES = "omission addition meaning modality referent terminology register voice style structure"
SHARED = Exact({"glossary": "text", "style_guide": "text"})
ANCHOR = Exact({"quote": "text 1 300", "occurrence": "int 0 9999"})
FINDING = Exact({
    "id": "finding", "category": f"in {CATEGORIES}", "severity": "in minor major critical", "detail": "text 1 1000", "resolved": "bool",
    "source_anchor": ANCHOR, "translation_anchor": ("null", ANCHOR),
    "resolves": ("null", Exact({"record_id": "hex32", "finding_id": "finding", "~recheck_reason": "in glossary_reconciliation", "~glossary_revision": "sha256"})),
})
ACCEPTANCE = Exact({
    "schema_version": "= 1", "unit_id": "unit", "claim_id": "hex32", "claim_revision": "text", "role": "in translator", "session_id": "text", "base_revision": "text", "base_commit": "text or null",
    "workflow_revision": "text", "accepted_from_progress_revision": "text", "shared_state_revisions": ("null", SHARED), "source_sha256": "sha256", "translation_sha256": "sha256", "accepted_at": "time",
})
ENTRY = Exact({
    "memory_id": "memory", "kind": "in term character character_voice relationship event narrative_style ambiguity translation_decision", "subject": "text 1 2000", "statement": "text 1 2000",
    "translation_decision": "text 1 1000 or null", "evidence": Exact({"unit_id": "unit", "quote": "text 1 300"}), "source_revision_id": "text", "status": "in accepted superseded", "supersedes": "memory or null",
})
REVISION = Exact({
    "revision_id": "source", "parent_revision_id": "source or null", "state": "in active superseded staged discarded", "created_at": "time", "source_file": "name", "source_format": "text", "source_sha256": "sha256",
    "source_storage_mode": "in embedded private_external", "source_size_bytes": "int 0", "snapshot_path": "path", "delta_path": "path or null",
})
RECORD = {
    "record_id": "hex32", "sequence": "int 1", "unit_id": "unit", "outcome": "in PASS CORRECTIONS_REQUIRED", "source_sha256": "sha256", "translation_sha256": "sha256", "workflow_revision": "text",
    "review_contract_revision": "text", "reviewer_session_id": "text", "reviewed_at": "time", "state_revision": "text", "review_commit": "text or null", "correction_round": "int 0", "supersedes_record_id": "hex32 or null",
}
FOUR = "metadata progress source_manifest source_revisions"

Get = Callable[[str, str], Column]


class Kind:
    """``fields``, whether no others may stand beside them, and rules over several fields."""

    def __init__(self, fields: dict, exact: bool = False, rules: dict[str, Callable[[Get], Column]] | None = None):
        self.fields, self.exact, self.rules = fields, exact, rules or {}


def _later(a: str, b: str) -> Callable[[Get], Column]:
    return lambda get: F.try_to_timestamp(get(a, "string")) > F.try_to_timestamp(get(b, "string"))


def _commit_with_shared(get: Get) -> Column:
    return get("shared_state_revisions", "string").isNull() | F.coalesce(F.trim(get("base_commit", "string")) != "", F.lit(False))


def _once(items: str, field: str) -> Callable[[Get], Column]:
    def rule(get: Get) -> Column:
        values = F.filter(F.transform(get(items, "array<variant>"), lambda x: F.try_variant_get(x, f"$.{field}", "string")), lambda x: x.isNotNull())
        return F.size(F.array_distinct(values)) == F.size(values)

    return rule


def _open_findings(get: Get, grave: bool) -> Column:
    found = F.filter(get("findings", "array<variant>"), lambda f: ~F.coalesce(F.try_variant_get(f, "$.resolved", "boolean"), F.lit(False)))
    return F.size(F.filter(found, lambda f: F.try_variant_get(f, "$.severity", "string").isin("major", "critical")) if grave else found)


def _anchored(get: Get) -> Column:
    """A finding without a place in the translation is an omission, and an open one."""
    return F.forall(get("findings", "array<variant>"), lambda f: F.try_variant_get(f, "$.translation_anchor", "string").isNotNull() | ((F.try_variant_get(f, "$.category", "string") == "omission") & ~F.coalesce(F.try_variant_get(f, "$.resolved", "boolean"), F.lit(True))))


def _active(get: Get) -> Column:
    active = F.filter(get("revisions", "array<variant>"), lambda r: F.try_variant_get(r, "$.state", "string") == "active")
    return (F.size(active) == 1) & (F.try_variant_get(F.get(active, F.lit(0)), "$.revision_id", "string") == get("active_revision", "string"))


def _beyond(get: Get) -> Column:
    numbers = F.transform(get("revisions", "array<variant>"), lambda r: F.regexp_extract(F.try_variant_get(r, "$.revision_id", "string"), r"(\d{6})$", 1).try_cast("long"))
    return get("next_sequence", "long") > F.coalesce(F.array_max(numbers), F.lit(0))


def _resolution(get: Get) -> Column:
    """An accepted one says what came of it and needs no reason; any other is the reverse."""
    has = lambda x: F.coalesce(F.trim(get(x, "string")) != "", F.lit(False))
    none = lambda x: get(x, "string").isNull()
    accepted = has("resulting_revision") & F.coalesce(get("resulting_sha256", "string").rlike(PATTERNS["sha256"]), F.lit(False)) & none("reason")
    return F.when(get("status", "string") == "accepted", accepted).otherwise(none("resulting_revision") & none("resulting_sha256") & has("reason"))


CLAIM = Kind(
    {"claim_id": "hex32", "unit_id": "unit", "role": "in translator reviewer", "session_id": "text", "base_revision": "text", "workflow_revision": "text", "base_commit": "text or null", "claimed_at": "time", "expires_at": "time", "~shared_state_revisions": SHARED},
    rules={"order": _later("expires_at", "claimed_at"), "shared_commit": _commit_with_shared},
)
KINDS = {
    "metadata": Kind(
        {
            "title": "text", "target_language": "text", "source_format": "text", "source_file": "name", "chapter_count": "int 0", "~workflow": {"~review_evidence": "in review-ledger-v1"},
            "~source": {"storage_mode": "in embedded private_external", "filename": "name", "size_bytes": "int 0", "sha256": "sha256", "~revision_id": "source or null", "~original_filename": "name or null"},
        },
        rules={"filename": lambda get: get("source", "string").isNull() | (get("source.filename", "string") == get("source_file", "string"))},
    ),
    "progress": Kind(
        {"book_slug": "text", "chapters": [{"number": "int 1", "title": "text", "slug": "text", "~unit_id": "unit", "source_path": "path", "translation_path": "path", "status": f"in {STATUSES}", "~translation_acceptance": ACCEPTANCE}]},
        rules={"unique": _once("chapters", "unit_id"), "accepted_status": lambda get: F.forall(get("chapters", "array<variant>"), lambda c: F.try_variant_get(c, "$.translation_acceptance", "string").isNull() | F.try_variant_get(c, "$.status", "string").isin("translated", "reviewed"))},
    ),
    "claim": CLAIM,
    "claim_event": Kind(
        {"event_id": "hex32", "action": "in release_requested cleanup_requested renew_requested released cleaned renewed", "unit_id": "unit", "occurred_at": "time", "~claim_revision": "text", "~claim": CLAIM, "~reason": "text", "~request_event_id": "hex32"},
        rules={
            "request": lambda get: F.when(get("action", "string").endswith("_requested"), get("claim_revision", "string").isNotNull() & get("claim", "string").isNotNull() & get("reason", "string").isNotNull()).otherwise(get("request_event_id", "string").isNotNull()),
            "same_unit": lambda get: get("claim", "string").isNull() | (get("claim.unit_id", "string") == get("unit_id", "string")),
        },
    ),
    "review_ledger": Kind({"book_slug": "text", "next_sequence": "int 1", "records": [RECORD]}, rules={"unique": _once("records", "record_id"), "next": lambda get: get("next_sequence", "long") == F.size(get("records", "array<variant>")) + 1}),
    "source_manifest": Kind(
        {"source_file": "name", "source_format": "text", "source_sha256": "sha256", "chapter_count": "int 0", "extracted": [{"number": "int 1", "~unit_id": "unit", "title": "text", "path": "path", "sha256": "sha256"}], "~source_storage_mode": "in embedded private_external", "~source_size_bytes": "int 0"},
        rules={"count": lambda get: get("chapter_count", "long") == F.size(get("extracted", "array<variant>")), "identity": lambda get: get("source_storage_mode", "string").isNull() == get("source_size_bytes", "string").isNull()},
    ),
    "source_revisions": Kind(
        {"book_slug": "text", "active_revision": "source", "next_sequence": "int 1", "next_unit_sequence": "int 1", "revisions": [REVISION]},
        rules={"unique": _once("revisions", "revision_id"), "active": _active, "next": _beyond},
    ),
    "source_promotion": Kind(
        {"book_slug": "text", "revision_id": "source", "parent_revision_id": "source", "phase": "in preparing promoted", "session_id": "text", "started_at": "time", "base_revisions": Exact.fromkeys(FOUR.split(), "text"), "target_sha256": Exact.fromkeys(FOUR.split(), "sha256")},
    ),
    "generated_state": Kind({"book_slug": "text", "source_revision": "text", "generated_at": "text", "data": {}}),
    "coordination_lock": Kind(
        {"lock_id": "hex32", "operation": "in claim_admission finalize_admission proposal_reconcile translation_acceptance source_promotion wave_memory", "session_id": "text", "acquired_at": "time", "expires_at": "time"},
        rules={"order": _later("expires_at", "acquired_at")},
    ),
    "finalization_lock": Kind(
        {"lock_id": "hex32", "book_slug": "text", "workflow_revision": "text", "base_progress_revision": "text", "candidate_progress_sha256": "sha256", "phase": "in preparing promoted", "promoted_progress_revision": "text or null", "session_id": "text", "started_at": "time"},
        rules={"promoted": lambda get: (get("phase", "string") == "preparing") == get("promoted_progress_revision", "string").isNull()},
    ),
    "quality_report": Kind(
        {"evidence_version": "= 2", "context": "in independent_session bounded_context", "checks": Exact.fromkeys("coverage meaning terminology style structure".split(), "true"), "findings": [FINDING]}, exact=True,
        rules={"unique": _once("findings", "id"), "few": lambda get: F.size(get("findings", "array<variant>")) <= 100, "anchors": _anchored},
    ),
    "attention": Kind(
        {"schema_version": "= 1", "workflow_revision": "commit", "entries": [Exact({"unit_id": "unit", "source_sha256": "sha256", "reason": "in correction-limit review-round-limit model-anchor-retries operator-attention model-output-exhausted model-coverage-exhausted", "created_at": "time", "~kind": "in translation", "~translation_sha256": "sha256", "~review_record_id": "hex32"})]}, exact=True,
        rules={"unique": _once("entries", "unit_id"), "few": lambda get: F.size(get("entries", "array<variant>")) <= 2000, "evidence": lambda get: F.forall(get("entries", "array<variant>"), lambda e: F.try_variant_get(e, "$.kind", "string").isNotNull() == F.try_variant_get(e, "$.review_record_id", "string").isNull())},
    ),
    "memory_entry": Kind(ENTRY, exact=True),
    "memory_snapshot": Kind(
        {"schema_version": "= 1", "revision": "sha256", "source_revision_id": "text", "entries": [ENTRY], "glossary_revision": "text", "style_guide_revision": "text"}, exact=True,
        rules={"unique": _once("entries", "memory_id"), "few": lambda get: F.size(get("entries", "array<variant>")) <= 5000, "same_source": lambda get: F.forall(get("entries", "array<variant>"), lambda e: F.try_variant_get(e, "$.source_revision_id", "string") == get("source_revision_id", "string"))},
    ),
    "proposal": Kind(
        {"schema_version": "= 1", "proposal_id": "hex32", "unit_id": "unit", "claim_id": "hex32", "role": "in translator reviewer", "session_id": "text", "base_revision": "text", "base_commit": "text", "workflow_revision": "text", "shared_state_revisions": SHARED, "target": "in glossary style_guide", "suggestion": "text", "rationale": "text or null", "proposed_at": "time"}, exact=True,
    ),
    "resolution": Kind(
        {"schema_version": "= 1", "proposal_id": "hex32", "status": "in accepted rejected stale", "target": "in glossary style_guide", "resolved_by_session_id": "text", "resolved_at": "time", "shared_state_revisions": SHARED, "resulting_revision": "any", "resulting_sha256": "any", "reason": "any"}, exact=True,
        rules={"outcome": _resolution},
    ),
    "output_manifest": Kind(
        {"schema_version": "= 1", "build_contract": "text", "book_slug": "name", "format": "in epub", "preview": "bool", "artifact_path": "path", "artifact_sha256": "sha256", "input_fingerprint": "sha256", "unit_count": "int 0", "repository_commit": "text or null", "state_revisions": Exact.fromkeys("metadata progress review_ledger".split(), "text")}, exact=True,
        rules={"artifact": lambda get: get("artifact_path", "string").rlike(r"^output/.*\.epub$")},
    ),
}


def _value(v: Column, rule: str) -> Column:
    """Whether a value keeps a rule: ``any``, ``bool``, ``true``, ``int`` with bounds, ``text`` with bounds, ``in`` a list, ``=`` a number, or
    a pattern; ``or null`` allows null as well."""
    if rule.endswith(" or null"):
        return F.is_variant_null(v) | _value(v, rule.removesuffix(" or null"))
    name, *rest = rule.split(" ")
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    if name == "any":
        return v.isNotNull()
    if name in ("bool", "true"):
        return (kind == "BOOLEAN") & (F.lit(name == "bool") | (text == "true"))
    if name in ("int", "="):
        n = F.try_variant_get(v, "$", "long")
        low = int(rest[0]) if rest else None
        bounds = (n == low) if name == "=" else (n >= low) & (n <= int(rest[1])) if len(rest) > 1 else n >= low
        return (kind == "BIGINT") & bounds
    filled = (kind == "STRING") & text.rlike(r"(?U)\S")
    if name == "text":
        return filled & F.length(text).between(int(rest[0]), int(rest[1])) if rest else filled
    if name == "in":
        return filled & text.isin(*rest)
    shaped = filled & text.rlike(PATTERNS[name])
    return shaped & F.try_to_timestamp(text).isNotNull() if name == "time" else shaped


def _broken(ok: Column, name: Column) -> Column:
    return F.array(F.when(~F.coalesce(ok, F.lit(False)), name))


def _of_item(kind: Kind, label: Column) -> Callable[[Column, Column], Column]:
    return lambda x, i: _errors(x, kind, F.concat(label, F.lit("["), i.cast("string"), F.lit("].")))


def _errors(v: Column, kind: Kind, prefix: Column) -> Column:
    """The names of the rules that an object breaks."""
    parts = [_broken(F.schema_of_variant(v).startswith("OBJECT"), F.concat(prefix, F.lit("object")))]
    for key, rule in kind.fields.items():
        optional, name = key.startswith("~"), key.removeprefix("~")
        value, label = F.try_variant_get(v, f"$.{name}", "variant"), F.concat(prefix, F.lit(name))
        nullable = isinstance(rule, tuple)
        rule = rule[1] if nullable else rule
        if isinstance(rule, str):
            found = _broken(_value(value, rule), label)
        elif isinstance(rule, list):
            items = F.try_variant_get(value, "$", "array<variant>")
            each = F.transform(items, _of_item(Kind(rule[0], exact=isinstance(rule[0], Exact)), label))
            found = F.when(items.isNull(), F.array(label)).otherwise(F.flatten(each))
        else:
            found = _errors(value, rule if isinstance(rule, Kind) else Kind(rule, exact=isinstance(rule, Exact)), F.concat(label, F.lit(".")))
        skip = F.lit(False)
        skip = skip | value.isNull() if optional else skip
        skip = skip | F.coalesce(F.is_variant_null(value), F.lit(False)) if nullable else skip
        parts.append(F.when(skip, F.array().cast("array<string>")).otherwise(found))
    if kind.exact:
        names = [k.removeprefix("~") for k in kind.fields]
        others = F.size(F.array_except(F.json_object_keys(F.to_json(v)), F.array(*[F.lit(n) for n in names]))) > 0
        parts.append(_broken(~F.coalesce(others, F.lit(False)), F.concat(prefix, F.lit("other_fields"))))
    get = lambda path, kind_: F.try_variant_get(v, f"$.{path}", kind_)
    parts += [_broken(rule(get), F.concat(prefix, F.lit(name))) for name, rule in kind.rules.items()]
    return F.filter(F.concat(*parts), lambda e: e.isNotNull())


def document_errors(df: DataFrame, keys: Sequence[str], text: str, kind: str, version: int | None = None) -> DataFrame:
    """``keys, errors``: the rules of its kind that each document breaks, by field; documents without fault are left out. A null text,
    or one that is no JSON, breaks the rule ``document`` alone; ``version`` is the schema_version it must have. Repeated rows repeat."""
    parsed = df.select(*keys, F.try_parse_json(text).alias("_v"))
    errors = _errors(F.col("_v"), KINDS[kind], F.lit(""))
    if version is not None:
        errors = F.concat(errors, F.filter(_broken(_value(F.try_variant_get("_v", "$.schema_version", "variant"), f"= {version}"), F.lit("schema_version")), lambda e: e.isNotNull()))
    seen = parsed.select(*keys, F.when(F.col("_v").isNull(), F.array(F.lit("document"))).otherwise(errors).alias("errors"))
    return seen.where(F.size("errors") > 0)


def report_outcome_errors(df: DataFrame, keys: Sequence[str], text: str, outcome: str) -> DataFrame:
    """``keys, errors`` of quality reports that contradict their outcome: a pass with a grave open finding, corrections without an open one."""
    parsed = df.select(*keys, F.try_parse_json(text).alias("_v"), F.col(outcome).alias("_o"))
    get = lambda path, kind_: F.try_variant_get("_v", f"$.{path}", kind_)
    wrong = F.when((F.col("_o") == "PASS") & (_open_findings(get, True) > 0), "open_grave").when((F.col("_o") == "CORRECTIONS_REQUIRED") & (_open_findings(get, False) == 0), "nothing_open")
    return parsed.select(*keys, wrong.alias("error")).where("error IS NOT NULL")


def ledger_errors(records: DataFrame, ledger: Sequence[str], position: str, record: str, unit: str, sequence: str, supersedes: str, rejected: str, round_: str) -> DataFrame:
    """``ledger, record, errors`` of records whose number is not their place, that do not supersede the record before of their unit, or
    whose round is not the number of rejections of the unit so far. One window for a unit, and places counted within a ledger."""
    at = Window.partitionBy(*ledger).orderBy(position)
    line = Window.partitionBy(*ledger, unit).orderBy(position)
    wrong = F.filter(F.array(
        F.when(~F.col(sequence).eqNullSafe(F.row_number().over(at)), "sequence"),
        F.when(~F.col(supersedes).eqNullSafe(F.lag(record).over(line)), "supersedes"),
        F.when(~F.col(round_).eqNullSafe(F.sum(F.col(rejected).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int")), "round"),
    ), lambda e: e.isNotNull())
    return records.select(*ledger, record, wrong.alias("errors")).where(F.size("errors") > 0)
