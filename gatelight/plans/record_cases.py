"""Sample records with their manifests and files, and the ways in which they can be wrong.

A sample is filled in from the formal shape of a record and from the registry, so that it passes every check of its
level. Each case is one edit of a sample, the rule that then decides its state, and the tags that it must get.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from gatelight.functions import registry_values as R
from gatelight.functions.record_schema import ATTESTATION_FIELDS, RECORD

REVIEWED, ASSESSED, EXPIRES, MADE = "2030-11-15T08:30:00+00:00", "2031-03-01T12:00:00Z", "2033-01-01T00:00:00Z", "2030-10-01T00:00:00Z"
OWNER, ZEROS = "owner-17", "0" * 64


def sha(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def _filled(name: str, shape: dict, given: dict):
    """A value of the shape: the given one of that name, else the least that the shape asks for."""
    if name in given:
        return given[name]
    if "enum" in shape:
        return shape["enum"][0]
    match shape.get("type"):
        case "string":
            return f"some {name.replace('_', ' ')}"
        case "integer":
            return shape.get("minimum", 0)
        case "array":
            return [_filled(name, shape["items"], given) for _ in range(shape.get("minItems", 0))]
    return {key: _filled(key, inner, given) for key, inner in shape.get("properties", {}).items()}


def sample(level: str) -> dict:
    """record, manifest and files (path to content); the record's manifest digest is left open."""
    claim, token = f"claim-{level}", "one token"
    rows = [(family, gate, f"{family}.{gate}", f"E-{n:03d}") for n, (family, gate) in enumerate((f, g) for f in R.FAMILIES for g in R.LEVELS[level][f])]
    role = {key: R.ROLES.get(key) or R.ROLES[f"{family}.*"] for family, _, key, _ in rows}
    contents = {evidence: f"{level} {key}" for _, _, key, evidence in rows}

    def statement(key: str, evidence: str) -> dict:
        values = {"evidence_id": evidence, "evidence_version": "v3", "evidence_sha256": sha(contents[evidence]), "reviewed_at_utc": REVIEWED, "reviewer_id": f"R {role[key]}",
                  "reviewer_role": role[key], "reviewer_authorization_id": f"A {role[key]}", "conflict_declaration": "none",
                  "claim_binding": dict(zip(("claim_id", "evidence_profile", "gate"), (claim, level, key)))}
        return {"disposition": "attested"} | {name: values[name] for name in ATTESTATION_FIELDS}

    by_family = lambda value: {f: {gate: value(key, evidence) for family, gate, key, evidence in rows if family == f} for f in R.FAMILIES}
    given = {
        "id": claim, "evidence_profile": level, "threshold_rationale": {"reason": "as planned"}, "gates": by_family(lambda *_: {"status": "pass"}), "evidence_adjudications": by_family(statement),
        "declared_required_gates": {f: list(R.LEVELS[level][f]) for f in R.FAMILIES}, "claim_owner_id": OWNER, "assessment_time_utc": ASSESSED, "evidence_manifest_id": "M-1",
        "evidence_manifest_sha256": None, "evidence_manifest_version": "v3", "minimum_manifest_sequence": 4, "local_integrity_token_sha256": sha(token),
    }
    manifest = {
        "manifest_id": "M-1", "manifest_version": "v3", "sequence": 4, "created_at_utc": MADE, "local_integrity_token": {"path": "pins/token", "sha256": sha(token)},
        "evidence": {evidence: {"path": f"proof/{evidence}.bin", "sha256": sha(contents[evidence]), "version": "v3", "status": "active", "expires_at_utc": EXPIRES,
                                "permitted_gates": [key], "permitted_claim_ids": [claim]} for _, _, key, evidence in rows},
        "authorized_reviewers": {f"A {name}": {"reviewer_id": f"R {name}", "role": name, "status": "active"} for name in sorted(set(role.values()))},
    }
    files = {"pins/token": token} | {f"proof/{evidence}.bin": text for evidence, text in contents.items()}
    return {"record": _filled("record", RECORD, given), "manifest": manifest, "files": files}


@dataclass
class Case:
    """edit changes a sample in place; tags(level) are what it must bring; changed is a gate's (family, place, status)."""

    edit: Callable[[dict], object]
    rule: str
    tags: Callable[[str], list[str]]
    changed: tuple[str, int, str] | None = None


CASES: dict[str, Case] = {}


def _add(name, rule, edit, *tags, changed=None):
    CASES[name] = Case(edit, rule, tags[0] if tags and callable(tags[0]) else lambda level: list(tags), changed)


def _record(**values):
    return lambda s: s["record"].update(values)


def _manifest(**values):
    return lambda s: s["manifest"].update(values)


def _statement(s) -> dict:
    """The statement on the first validity gate, which all levels have."""
    return s["record"]["evidence_adjudications"]["validity"]["boundary_declared"]


def _said(**values):
    return lambda s: _statement(s).update(values)


def _evidence(**values):
    return lambda s: s["manifest"]["evidence"]["E-000"].update(values)


def _status(family, place, value):
    def edit(s):
        list(s["record"]["gates"][family].values())[place]["status"] = value

    return edit


def _copied(s):
    """The second file has the content of the first."""
    s["files"]["proof/E-001.bin"] = s["files"]["proof/E-000.bin"]
    digest = sha(s["files"]["proof/E-000.bin"])
    s["manifest"]["evidence"]["E-001"]["sha256"] = digest
    list(s["record"]["evidence_adjudications"]["validity"].values())[1]["evidence_sha256"] = digest


G = "attestation:validity:boundary_declared"
SCHEMA = "schema:jsonschema="

_add("complete_record", "complete", lambda s: None)
_add("reordered", "complete", lambda s: [x.reverse() for x in s["record"]["declared_required_gates"].values()])
# What can be wrong with the manifest or with the shape of a record.
_add("no_json", "schema", lambda s: s.update(record="{"), "schema:root_not_object")
_add("array", "schema", lambda s: s.update(record=[1]), "schema:root_not_object")
_add("manifest_no_json", "manifest", lambda s: s.update(manifest="{"), "manifest:unreadable=JSONDecodeError")
_add("manifest_absent", "manifest", lambda s: s.update(manifest=None), "manifest:unreadable=FileNotFoundError")
_add("manifest_empty", "manifest", lambda s: s.update(manifest={}), *(f"manifest:{x}" for x in (
    "manifest_id_missing_or_empty", "manifest_version_missing_or_empty", "sequence_invalid", "created_at_utc_invalid", "evidence_not_object", "authorized_reviewers_not_object")))
_add("unknown_profile", "schema", _record(evidence_profile="L99"), SCHEMA + "evidence_profile", "schema:unknown_evidence_profile='L99'")
_add("null_profile", "schema", _record(evidence_profile=None), SCHEMA + "evidence_profile", "schema:unknown_evidence_profile=None")
_add("no_owner", "schema", lambda s: s["record"].pop("claim_owner_id"), SCHEMA + "root", "schema:missing_field=claim_owner_id")
_add("blank_statement", "schema", _record(statement=" \t"), "schema:empty_or_invalid=statement")
_add("empty_boundary", "schema", _record(boundary={}), *[SCHEMA + "boundary"] * 3, *(f"schema:boundary_{x}_missing_or_empty" for x in ("energy", "service", "exclusions")))
_add("late_items", "schema", lambda s: s["record"]["boundary"].update(exclusions=["", *"abcdefghi", ""]), SCHEMA + "boundary/exclusions/0", SCHEMA + "boundary/exclusions/10", "schema:boundary_exclusions_missing_or_empty")
_add("empty_threshold_rationale", "schema", _record(threshold_rationale={}), SCHEMA + "threshold_rationale", "schema:threshold_rationale_missing_or_empty")
_add("invalid_gates_container", "schema", _record(gates=[]), SCHEMA + "gates", "schema:gates_not_object")
_add("invalid_time", "schema", _record(assessment_time_utc="not-a-date"), "schema:assessment_time_utc_invalid")
_add("time_without_offset", "schema", _record(assessment_time_utc="2031-03-01T12:00:00"), "schema:assessment_time_utc_invalid")
_add("broken_sequence", "schema", _record(minimum_manifest_sequence=1.5), SCHEMA + "minimum_manifest_sequence", "schema:minimum_manifest_sequence_invalid")
_add("invalid_status", "schema", _status("validity", 0, "maybe"), SCHEMA + "gates/validity/boundary_declared/status")
# What doesn't fit between record and manifest.
_add("other_manifest", "manifest_id", _record(evidence_manifest_id="M-2"), "manifest:claim_manifest_id_mismatch")
_add("manifest_digest", "manifest_digest", _record(evidence_manifest_sha256=ZEROS), "manifest:claim_manifest_digest_mismatch")
_add("manifest_version", "manifest_version", _record(evidence_manifest_version="v2"), "manifest:claim_manifest_version_mismatch")
_add("manifest_rollback", "sequence", _record(minimum_manifest_sequence=5), "manifest:sequence_rollback_detected")
_add("manifest_sequence_rollback", "sequence", _manifest(sequence=0), "manifest:sequence_rollback_detected")
_add("integrity_token_mismatch", "token", _record(local_integrity_token_sha256=ZEROS), "manifest:local_integrity_token_digest_mismatch")
_add("token_changed", "token", lambda s: s["files"].update({"pins/token": "two tokens"}), "manifest:local_integrity_token_digest_mismatch")
_add("token_absent", "token", lambda s: s["files"].pop("pins/token"), "manifest:local_integrity_token_file_missing")
_add("token_path", "token", lambda s: s["manifest"]["local_integrity_token"].update(path="../token"), "manifest:local_integrity_token_path_not_normalized_relative")
_add("no_token", "token", _manifest(local_integrity_token=None), "manifest:local_integrity_token_missing_or_invalid")
# What a record declares.
_add("omitted_precision", "declaration", lambda s: s["record"]["declared_required_gates"].update(precision=[]), lambda level: [f"required_gate_declaration:precision:omitted={g}" for g in sorted(R.LEVELS[level]["precision"])])
_add("caller_omits_profile_gate", "declaration", lambda s: s["record"]["declared_required_gates"]["validity"].pop(1), lambda level: [f"required_gate_declaration:validity:omitted={R.LEVELS[level]['validity'][1]}"])
_add("declared_twice", "declaration", lambda s: s["record"]["declared_required_gates"]["validity"].append("boundary_declared"), "required_gate_declaration:validity:duplicate_gate_name")
_add("unregistered_gate", "declaration", lambda s: s["record"]["declared_required_gates"]["validity"].append("unregistered_gate"), "required_gate_declaration:validity:unregistered=unregistered_gate")
_add("unregistered_status", "declaration", lambda s: s["record"]["gates"]["validity"].update(zz={"status": "pass"}), "gates:validity:unregistered=zz")
# The statement on one gate and its evidence.
_add("no_statement", "attestation", lambda s: s["record"]["evidence_adjudications"]["validity"].pop("boundary_declared"), f"{G}=missing_or_invalid")
_add("empty_attestation", "attestation", lambda s: _statement(s).clear(), f"{G}:disposition=None")
_add("disposition", "attestation", _said(disposition="it's no"), f'{G}:disposition="it\'s no"')
_add("lacking", "attestation", lambda s: [_statement(s).pop(x) for x in ("reviewer_id", "evidence_version")], f"{G}:missing=evidence_version", f"{G}:missing=reviewer_id")
_add("blank_evidence", "attestation", _said(evidence_id=" "), f"{G}:evidence_id_invalid")
_add("forged_id", "attestation", _said(evidence_id="forged"), f"{G}:evidence_id_not_in_manifest=forged")
_add("revoked", "attestation", _evidence(status="revoked"), f"{G}:evidence_status='revoked'")
_add("evidence_version", "attestation", _said(evidence_version="v1"), f"{G}:evidence_version_mismatch")
_add("path_traversal", "attestation", _evidence(path="../outside.txt"), f"{G}:evidence_path_not_normalized_relative")
_add("backslash_path", "attestation", _evidence(path="a\\b"), f"{G}:evidence_path_not_posix")
_add("blank_path", "attestation", _evidence(path=" "), f"{G}:evidence_path_missing_or_invalid")
_add("file_absent", "attestation", lambda s: s["files"].pop("proof/E-000.bin"), f"{G}:evidence_file_missing")
_add("file_changed", "attestation", lambda s: s["files"].update({"proof/E-000.bin": "else"}), f"{G}:evidence_digest_mismatch")
_add("copied_file", "attestation", _copied, lambda level: [f"attestation:validity:{R.LEVELS[level]['validity'][1]}:duplicate_evidence_digest_under_distinct_ids=E-000"])
_add("other_gate", "attestation", _evidence(permitted_gates=["validity.x"]), f"{G}:evidence_not_bound_to_gate")
_add("other_claim", "attestation", _evidence(permitted_claim_ids=[]), f"{G}:evidence_not_bound_to_claim")
_add("wrong_claim_gate_binding", "attestation", lambda s: _statement(s)["claim_binding"].update(gate="validity.other"), f"{G}:claim_binding_mismatch")
_add("review_time", "attestation", _said(reviewed_at_utc="soon"), f"{G}:reviewed_at_invalid")
_add("stale_review", "attestation", _said(reviewed_at_utc="2030-02-28T12:00:00Z"), f"{G}:review_timestamp_stale_or_after_assessment")
_add("year_old_review", "complete", _said(reviewed_at_utc="2030-02-28T12:00:01Z"))
_add("later_review", "attestation", _said(reviewed_at_utc="2031-03-01T13:00:01+01:00"), f"{G}:review_timestamp_stale_or_after_assessment")
_add("expired", "attestation", _evidence(expires_at_utc="2031-03-01T11:59:59Z"), f"{G}:evidence_expired_or_invalid_expiry")
_add("self_review", "attestation", _said(reviewer_id=OWNER), f"{G}:self_review_not_permitted", f"{G}:reviewer_authorization_identity_mismatch")
_add("no_authorization", "attestation", _said(reviewer_authorization_id="A none"), f"{G}:reviewer_authorization_missing")
_add("withdrawn_authorization", "attestation", lambda s: s["manifest"]["authorized_reviewers"]["A measurement_assurance_reviewer"].update(status="withdrawn"), lambda level: [
    f"attestation:validity:{g}:reviewer_authorization_not_active" for g in R.LEVELS[level]["validity"] if f"validity.{g}" not in R.ROLES])
_add("role", "attestation", _said(reviewer_role="guest"), f"{G}:reviewer_role_authorization_mismatch", f"{G}:wrong_reviewer_role")
_add("conflict", "attestation", _said(conflict_declaration="open"), f"{G}:conflict_unresolved_or_invalid")
_add("managed_conflict", "complete", _said(conflict_declaration="declared_and_managed"))
# What the statuses say.
_add("validity_fails", "validity", _status("validity", -1, "fail"), lambda level: [f"validity:{R.LEVELS[level]['validity'][-1]}=fail"], changed=("validity", -1, "fail"))
_add("substantive_missing", "substantive", _status("substantive", 0, "missing"), lambda level: [f"substantive:{R.LEVELS[level]['substantive'][0]}=missing"], changed=("substantive", 0, "missing"))
_add("substantive_fails", "failed", _status("substantive", 0, "fail"), lambda level: [f"substantive:{R.LEVELS[level]['substantive'][0]}=fail"], changed=("substantive", 0, "fail"))
_add("precision_invalid", "precision", _status("precision", -1, "invalid"), lambda level: [f"precision:{R.LEVELS[level]['precision'][-1]}=invalid"], changed=("precision", -1, "invalid"))
_add("status_absent", "precision", lambda s: s["record"]["gates"]["precision"].pop(next(iter(s["record"]["gates"]["precision"]))), lambda level: [
    *(["gates:precision=empty"] if len(R.LEVELS[level]["precision"]) == 1 else []), *(f"precision:{R.LEVELS[level]['precision'][0]}={x}" for x in ("not_submitted", "missing"))], changed=("precision", 0, "missing"))

#: The single edits that malformed records are drawn from, and the records that the formal shape alone is compared on.
MUTATIONS = [
    "unknown_profile", "empty_boundary", "invalid_gates_container", "empty_attestation", "omitted_precision", "forged_id", "self_review", "invalid_time", "manifest_digest",
    "manifest_version", "manifest_rollback", "integrity_token_mismatch", "invalid_status", "empty_threshold_rationale", "unregistered_gate",
]
CONTRAST = ["complete_record", "caller_omits_profile_gate", "wrong_claim_gate_binding", "path_traversal", "manifest_sequence_rollback"]


def edited(level: str, name: str) -> dict:
    """The sample of a level after a case's edit; the manifest is a text, or None, and the record a text that names its digest."""
    out = sample(level)
    CASES[name].edit(out)
    manifest = out["manifest"]
    out["manifest"] = manifest if manifest is None or isinstance(manifest, str) else json.dumps(manifest, sort_keys=True)
    if isinstance(out["record"], dict) and not out["record"].get("evidence_manifest_sha256"):
        out["record"]["evidence_manifest_sha256"] = sha(out["manifest"] or "")
    out["record"] = out["record"] if isinstance(out["record"], str) else json.dumps(out["record"])
    return out


def rule_of(level: str, name: str) -> str:
    """The rule that decides: an emptied family also breaks the declaration."""
    return "declaration" if name == "status_absent" and len(R.LEVELS[level]["precision"]) == 1 else CASES[name].rule


def frames(spark, pairs: list[tuple[str, str]]):
    """records (record_key, record, manifest_key), manifests and files, as classify takes them, of pairs of a level and a case."""
    made = {f"{level} {name}": edited(level, name) for level, name in pairs}
    return (
        spark.createDataFrame([(key, x["record"], key) for key, x in made.items()], "record_key string, record string, manifest_key string"),
        spark.createDataFrame([(key, x["manifest"], sha(x["manifest"])) for key, x in made.items() if x["manifest"] is not None], "manifest_key string, manifest string, digest string"),
        spark.createDataFrame([(key, path, sha(text)) for key, x in made.items() for path, text in x["files"].items()], "manifest_key string, path string, digest string"),
    )
