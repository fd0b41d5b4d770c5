"""The formal shape of a record, and the fields that are checked by hand besides."""

from __future__ import annotations

TEXT = {"type": "string", "minLength": 1}
DIGEST = {"type": "string", "pattern": "^[A-Fa-f0-9]{64}$"}
STATUSES = ["pass", "fail", "missing", "invalid"]
FAMILIES = ["validity", "substantive", "precision"]


def _families(each: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "required": FAMILIES, "properties": {family: each for family in FAMILIES}}


RECORD = {
    "type": "object",
    "additionalProperties": False,
    "required": [
        "id", "statement", "evidence_profile", "boundary", "functional_unit", "threshold_rationale", "declared_required_gates", "gates", "evidence_adjudications",
        "permitted_wording", "claim_owner_id", "assessment_time_utc", "evidence_manifest_id", "evidence_manifest_sha256", "evidence_manifest_version",
        "minimum_manifest_sequence", "local_integrity_token_sha256",
    ],
    "properties": {
        "id": TEXT,
        "statement": TEXT,
        "evidence_profile": {"enum": ["L0", "L1", "L2", "L3", "L4"]},
        "boundary": {
            "type": "object",
            "additionalProperties": False,
            "required": ["energy", "service", "exclusions"],
            "properties": {"energy": TEXT, "service": TEXT, "exclusions": {"type": "array", "minItems": 1, "items": TEXT}},
        },
        "functional_unit": TEXT,
        "threshold_rationale": {"type": "object", "minProperties": 1},
        "declared_required_gates": _families({"type": "array", "items": TEXT}),
        "gates": _families({
            "type": "object",
            "additionalProperties": {"type": "object", "additionalProperties": False, "required": ["status"], "properties": {"status": {"enum": STATUSES}}},
        }),
        "evidence_adjudications": _families({"type": "object", "additionalProperties": {"type": "object"}}),
        "permitted_wording": TEXT,
        "claim_owner_id": TEXT,
        "assessment_time_utc": TEXT,
        "evidence_manifest_id": TEXT,
        "evidence_manifest_sha256": DIGEST,
        "evidence_manifest_version": TEXT,
        "minimum_manifest_sequence": {"type": "integer", "minimum": 0},
        "local_integrity_token_sha256": DIGEST,
    },
}

_ANY_TEXT = {"type": "string"}


def _closed(required: list[str], **properties) -> dict:
    return {"type": "object", "additionalProperties": False, "required": required, "properties": properties}


def _texts(*names: str) -> dict:
    return {name: _ANY_TEXT for name in names}


#: The usual form of a manifest. Nothing is held against it: what isn't of this form is looked at value by value.
MANIFEST = _closed(
    ["manifest_id", "manifest_version", "sequence", "created_at_utc", "evidence", "authorized_reviewers"],
    **_texts("manifest_id", "manifest_version"), sequence={"type": "integer", "minimum": 0}, **_texts("created_at_utc"), local_integrity_token=_closed([], **_texts("path", "sha256")),
    evidence={"type": "object", "additionalProperties": _closed(
        [], **_texts("path", "sha256", "version", "status", "expires_at_utc"), permitted_gates={"type": "array", "items": _ANY_TEXT}, permitted_claim_ids={"type": "array", "items": _ANY_TEXT})},
    authorized_reviewers={"type": "object", "additionalProperties": _closed([], **_texts("reviewer_id", "role", "status"))},
)

TEXT_FIELDS = [
    "id", "statement", "functional_unit", "permitted_wording", "claim_owner_id", "evidence_manifest_id", "evidence_manifest_sha256", "evidence_manifest_version",
    "local_integrity_token_sha256",
]

ATTESTATION_FIELDS = [
    "evidence_id", "evidence_version", "evidence_sha256", "reviewed_at_utc", "reviewer_id", "reviewer_role", "reviewer_authorization_id", "conflict_declaration", "claim_binding",
]

REASONS = {
    "manifest": "The local evidence manifest cannot be used.",
    "schema": "The claim object does not satisfy the executable schema.",
    "manifest_id": "The submitted manifest identity does not match the claim.",
    "manifest_digest": "The submitted manifest digest does not match the local manifest.",
    "manifest_version": "The submitted manifest version does not match the claim.",
    "sequence": "The submitted manifest sequence is older than the claim permits.",
    "token": "The local manifest-integrity token does not match the claim.",
    "declaration": "The caller-declared gates do not match the registry-derived minimum.",
    "attestation": "A required local provenance, role, binding, or attestation check failed; scientific evidence was not assessed.",
    "validity": "A required validity dependency is missing or invalid; the claim cannot be assessed.",
    "substantive": "A required substantive datum is unavailable under the declared boundary.",
    "failed": "A locally provenance-consistent adjudication attests that a required criterion failed. This is not an independent scientific contradiction finding.",
    "precision": "Submitted evidence is not precise or replicated enough under the registered rule.",
    "complete": "All registry gates pass local provenance checks. Evidence is not independently validated.",
}
