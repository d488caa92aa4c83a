import copy
import json

import pytest

from corpusflow.operators import documents as D

H, S, U, T1, T2 = "0" * 32, "a" * 64, "chapter-000001", "2025-01-01T00:00:00Z", "2025-01-01T01:00:00.5+00:00"
SHARED = {"glossary": "g", "style_guide": "s"}
CLAIM = {"claim_id": H, "unit_id": U, "role": "reviewer", "session_id": "s", "base_revision": "b", "workflow_revision": "w", "base_commit": "c", "claimed_at": T1, "expires_at": T2, "shared_state_revisions": SHARED}
FINDING = {"id": "f-1", "category": "omission", "severity": "minor", "detail": "x", "resolved": False, "source_anchor": {"quote": "q", "occurrence": 0}, "translation_anchor": None, "resolves": None}
ENTRY = {"memory_id": "m-1", "kind": "term", "subject": "s", "statement": "t", "translation_decision": None, "evidence": {"unit_id": U, "quote": "q"}, "source_revision_id": "r", "status": "accepted", "supersedes": None}
ACCEPTED = {"schema_version": 1, "unit_id": U, "claim_id": H, "claim_revision": "c", "role": "translator", "session_id": "s", "base_revision": "b", "base_commit": None, "workflow_revision": "w", "accepted_from_progress_revision": "p", "shared_state_revisions": None, "source_sha256": S, "translation_sha256": S, "accepted_at": T1}
REVISION = {"revision_id": "source-000002", "parent_revision_id": None, "state": "active", "created_at": T1, "source_file": "a.epub", "source_format": "epub", "source_sha256": S, "source_storage_mode": "embedded", "source_size_bytes": 0, "snapshot_path": "a/b", "delta_path": None}
RECORD = {"record_id": H, "sequence": 1, "unit_id": U, "outcome": "PASS", "source_sha256": S, "translation_sha256": S, "workflow_revision": "w", "review_contract_revision": "c", "reviewer_session_id": "s", "reviewed_at": T1, "state_revision": "r", "review_commit": None, "correction_round": 0, "supersedes_record_id": None}
GOOD = {
    "metadata": {"title": "T", "target_language": "ru", "source_format": "epub", "source_file": "a.epub", "chapter_count": 0, "source": {"storage_mode": "embedded", "filename": "a.epub", "size_bytes": 1, "sha256": S}},
    "progress": {"book_slug": "b", "chapters": [{"number": 1, "title": "t", "slug": "s", "unit_id": U, "source_path": "a/b.md", "translation_path": "c.md", "status": "translated", "translation_acceptance": ACCEPTED}]},
    "claim": CLAIM,
    "claim_event": {"event_id": H, "action": "renew_requested", "unit_id": U, "occurred_at": T1, "claim_revision": "r", "claim": CLAIM, "reason": "x"},
    "review_ledger": {"book_slug": "b", "next_sequence": 2, "records": [RECORD]},
    "source_manifest": {"source_file": "a", "source_format": "txt", "source_sha256": S, "chapter_count": 1, "extracted": [{"number": 1, "title": "t", "path": "p", "sha256": S}]},
    "source_revisions": {"book_slug": "b", "active_revision": "source-000002", "next_sequence": 3, "next_unit_sequence": 1, "revisions": [REVISION]},
    "source_promotion": {"book_slug": "b", "revision_id": "source-000002", "parent_revision_id": "source-000001", "phase": "promoted", "session_id": "s", "started_at": T1, "base_revisions": dict.fromkeys(D.FOUR.split(), "x"), "target_sha256": dict.fromkeys(D.FOUR.split(), S)},
    "generated_state": {"book_slug": "b", "source_revision": "r", "generated_at": "now", "data": {}},
    "coordination_lock": {"lock_id": H, "operation": "source_promotion", "session_id": "s", "acquired_at": T1, "expires_at": T2},
    "finalization_lock": {"lock_id": H, "book_slug": "b", "workflow_revision": "w", "base_progress_revision": "p", "candidate_progress_sha256": S, "phase": "preparing", "promoted_progress_revision": None, "session_id": "s", "started_at": T1},
    "quality_report": {"evidence_version": 2, "context": "bounded_context", "checks": dict.fromkeys(["coverage", "meaning", "terminology", "style", "structure"], True), "findings": [FINDING]},
    "attention": {"schema_version": 1, "workflow_revision": "b" * 40, "entries": [{"unit_id": U, "source_sha256": S, "reason": "operator-attention", "created_at": T1, "kind": "translation"}]},
    "memory_entry": ENTRY,
    "memory_snapshot": {"schema_version": 1, "revision": S, "source_revision_id": "r", "entries": [ENTRY], "glossary_revision": "g", "style_guide_revision": "s"},
    "proposal": {"schema_version": 1, "proposal_id": H, "unit_id": U, "claim_id": H, "role": "translator", "session_id": "s", "base_revision": "b", "base_commit": "c", "workflow_revision": "w", "shared_state_revisions": SHARED, "target": "glossary", "suggestion": "x", "rationale": None, "proposed_at": T1},
    "resolution": {"schema_version": 1, "proposal_id": H, "status": "accepted", "target": "glossary", "resolved_by_session_id": "s", "resolved_at": T1, "shared_state_revisions": SHARED, "resulting_revision": "r", "resulting_sha256": S, "reason": None},
    "output_manifest": {"schema_version": 1, "build_contract": "v1", "book_slug": "b", "format": "epub", "preview": False, "artifact_path": "output/b.epub", "artifact_sha256": S, "input_fingerprint": S, "unit_count": 3, "repository_commit": None, "state_revisions": dict.fromkeys(["metadata", "progress", "review_ledger"], "x")},
}
#: What is changed in a good document of a kind, and the rules it breaks then.
BAD = {
    "metadata": [({"chapter_count": True}, {"chapter_count"}), ({"source_file": "a/b"}, {"source_file", "filename"}), ({"source": 3}, {"source.object", "source.storage_mode", "source.filename", "source.size_bytes", "source.sha256", "filename"}), ({"title": " "}, {"title"})],
    "progress": [({"chapters": None}, {"chapters", "unique", "accepted_status"}), ({"chapters": [GOOD["progress"]["chapters"][0] | {"status": "pending", "number": 0}]}, {"chapters[0].number", "chapters[0].status"} - {"chapters[0].status"} | {"accepted_status"}), ({"chapters": [GOOD["progress"]["chapters"][0]] * 2}, {"unique"}), ({"chapters": [GOOD["progress"]["chapters"][0] | {"source_path": "../x"}]}, {"chapters[0].source_path"})],
    "claim": [({"expires_at": T1}, {"order"}), ({"claimed_at": "2025-13-01T00:00:00Z"}, {"claimed_at", "order"}), ({"base_commit": None}, {"shared_commit"}), ({"role": "editor", "claim_id": "X"}, {"role", "claim_id"}), ({"shared_state_revisions": SHARED | {"more": "x"}}, {"shared_state_revisions.other_fields"})],
    "claim_event": [({"claim": CLAIM | {"unit_id": "chapter-000002"}}, {"same_unit"}), ({"action": "released"}, {"request"}), ({"reason": ""}, {"reason"}), ({"claim": CLAIM | {"role": 1}}, {"claim.role"})],
    "review_ledger": [({"next_sequence": 1}, {"next"}), ({"records": [RECORD, RECORD], "next_sequence": 3}, {"unique"}), ({"records": [RECORD | {"sequence": 1.5, "outcome": "x"}]}, {"records[0].sequence", "records[0].outcome"})],
    "source_manifest": [({"chapter_count": 2}, {"count"}), ({"source_size_bytes": 5}, {"identity"}), ({"extracted": [{"number": 1, "title": "t", "path": "/p", "sha256": "x"}]}, {"extracted[0].path", "extracted[0].sha256"})],
    "source_revisions": [({"next_sequence": 2}, {"next"}), ({"revisions": []}, {"active"}), ({"active_revision": "source-000009"}, {"active"}), ({"revisions": [REVISION, REVISION]}, {"unique", "active"})],
    "source_promotion": [({"target_sha256": dict.fromkeys(D.FOUR.split(), "x")}, {f"target_sha256.{k}" for k in D.FOUR.split()}), ({"base_revisions": {"metadata": "x"}}, {f"base_revisions.{k}" for k in D.FOUR.split()[1:]})],
    "generated_state": [({"data": [1]}, {"data.object"})],
    "coordination_lock": [({"operation": "x"}, {"operation"}), ({"expires_at": T1}, {"order"})],
    "finalization_lock": [({"phase": "promoted"}, {"promoted"}), ({"promoted_progress_revision": "x"}, {"promoted"})],
    "quality_report": [({"checks": GOOD["quality_report"]["checks"] | {"style": False}}, {"checks.style"}), ({"findings": [FINDING | {"resolved": True}]}, {"anchors"}), ({"findings": [FINDING, FINDING]}, {"unique"}), ({"findings": [FINDING | {"source_anchor": {"quote": "q", "occurrence": True}, "resolved": 0}]}, {"findings[0].source_anchor.occurrence", "findings[0].resolved"}), ({"extra": 1}, {"other_fields"})],
    "attention": [({"workflow_revision": "b"}, {"workflow_revision"}), ({"entries": GOOD["attention"]["entries"] * 2}, {"unique"}), ({"entries": [GOOD["attention"]["entries"][0] | {"review_record_id": H}]}, {"evidence"})],
    "memory_entry": [({"kind": "x"}, {"kind"}), ({"evidence": {"unit_id": U, "quote": "x" * 301}}, {"evidence.quote"}), ({"supersedes": "A"}, {"supersedes"})],
    "memory_snapshot": [({"source_revision_id": "other"}, {"same_source"}), ({"entries": [ENTRY, ENTRY]}, {"unique"})],
    "proposal": [({"rationale": ""}, {"rationale"}), ({"schema_version": True}, {"schema_version"}), ({"extra": 1}, {"other_fields"})],
    "resolution": [({"reason": "x"}, {"outcome"}), ({"status": "stale"}, {"outcome"}), ({"status": "rejected", "resulting_revision": None, "resulting_sha256": None, "reason": "x"}, set())],
    "output_manifest": [({"artifact_path": "output/x.txt"}, {"artifact"}), ({"unit_count": -1, "preview": 1}, {"unit_count", "preview"})],
}


@pytest.mark.parametrize("kind", sorted(D.KINDS))
def test_rules_of_a_kind(spark, kind):
    rows, want = [("good", json.dumps(GOOD[kind])), ("null", None), ("broken", "{"), ("list", "[]")], {"null": {"document"}, "broken": {"document"}}
    for i, (change, errors) in enumerate(BAD[kind]):
        rows.append((f"bad{i}", json.dumps(copy.deepcopy(GOOD[kind]) | change)))
        want |= {f"bad{i}": errors} if errors else {}
    got = {r.k: set(r.errors) for r in D.document_errors(spark.createDataFrame(rows, "k string, errors string"), ["k"], "errors", kind).collect()}
    assert "object" in got.pop("list") and got == want


def test_version_and_outcome(spark):
    df = spark.createDataFrame([(1, json.dumps({"schema_version": 1} | GOOD["claim"])), (2, json.dumps(GOOD["claim"])), (3, json.dumps({"schema_version": "1"} | GOOD["claim"]))], "k int, t string")
    assert sorted((r.k, r.errors) for r in D.document_errors(df, ["k"], "t", "claim", version=1).collect()) == [(2, ["schema_version"]), (3, ["schema_version"])]
    report = lambda **o: json.dumps({"findings": [FINDING | o]})
    df = spark.createDataFrame([(1, report(), "PASS"), (2, report(severity="major"), "PASS"), (3, report(resolved=True), "CORRECTIONS_REQUIRED"), (4, report(), "CORRECTIONS_REQUIRED")], "k int, t string, o string")
    assert sorted(map(tuple, D.report_outcome_errors(df, ["k"], "t", "o").collect())) == [(2, "open_grave"), (3, "nothing_open")]


def test_ledger(spark):
    rows = [("l", 0, "a", "u", 1, None, True, 1), ("l", 1, "b", "v", 2, None, False, 0), ("l", 2, "c", "u", 3, "a", True, 2), ("l", 3, "d", "u", 5, "b", False, 3)]
    df = spark.createDataFrame(rows, "l string, pos int, r string, u string, n int, s string, rej boolean, k int")
    assert [tuple(r) for r in D.ledger_errors(df, ["l"], "pos", "r", "u", "n", "s", "rej", "k").collect()] == [("l", "d", ["sequence", "supersedes", "round"])]
