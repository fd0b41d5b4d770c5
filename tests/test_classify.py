import json

import pytest
from pyspark.sql import functions as F

from gatelight.functions import registry_values as R
from gatelight.plans import record_cases as M
from gatelight.plans.classify import classify

PAIRS = [(level, name) for level in ("L0", "L1", "L3") for name in M.CASES]


@pytest.fixture(scope="module")
def found(spark):
    rows = classify(*M.frames(spark, PAIRS)).collect()
    assert len(rows) == len(PAIRS)
    return {r.record_key: r for r in rows}


@pytest.mark.parametrize(("level", "name"), PAIRS)
def test_state_and_tags(found, level, name):
    row, rule = found[f"{level} {name}"], M.rule_of(level, name)
    state = R.STATES.get({"failed": "failed", "precision": "inconclusive", "complete": "complete"}.get(rule, "not_assessable"))
    assert (row.state, list(row.audit_tags)) == (state, M.CASES[name].tags(level))


def test_every_attestation_rule_is_reached():
    wanted = {
        "=missing_or_invalid", ":disposition=", ":missing=", ":evidence_id_invalid", ":evidence_id_not_in_manifest=", ":evidence_status=", ":evidence_version_mismatch", ":evidence_path_", ":evidence_file_missing",
        ":duplicate_evidence_digest_under_distinct_ids=", ":evidence_digest_mismatch", ":evidence_not_bound_to_gate", ":evidence_not_bound_to_claim", ":claim_binding_mismatch", ":reviewed_at_invalid",
        ":review_timestamp_stale_or_after_assessment", ":evidence_expired_or_invalid_expiry", ":self_review_not_permitted", ":reviewer_authorization_missing", ":reviewer_authorization_not_active",
        ":reviewer_authorization_identity_mismatch", ":reviewer_role_authorization_mismatch", ":wrong_reviewer_role", ":conflict_unresolved_or_invalid",
    }
    tags = " ".join(t for case in M.CASES.values() for t in case.tags("L1"))
    assert not [x for x in wanted if x not in tags]


def test_components_and_requirements(found):
    full = found["L3 complete_record"]
    assert {f: list(g) for f, g in full.required_gates.items()} == R.LEVELS["L3"]
    assert full.component_statuses["service_quality"] == "submitted_gate_passes" and full.component_statuses["provenance"] == "locally_consistent"
    assert found["L0 complete_record"].component_statuses["energy_subclaim"] == "not_required_for_profile"
    failed = found["L1 substantive_fails"].component_statuses
    assert failed["energy_subclaim"] == "conflicts_with_declared_component" and failed["validity"] == "submitted_gate_passes"
    assert found["L1 no_json"].claim_id == "<invalid-claim-object>" and found["L1 no_owner"].required_gates["precision"] == []
    assert found["L1 other_manifest"].required_gates["precision"] == R.LEVELS["L1"]["precision"]
    assert full.display_state.startswith("Locally provenance-complete--L3") and full.schema_accepts and not found["L1 no_json"].schema_accepts


def test_repeated_and_missing_keys(spark):
    records, manifests, files = M.frames(spark, [("L1", "complete_record"), ("L1", "conflict")])
    one = records.withColumn("record_key", F.lit("same"))
    none = records.withColumn("record_key", F.lit(None).cast("string"))
    rows = classify(one.unionByName(one).unionByName(none), manifests, files).collect()
    found = sorted((str(r.record_key), len(r.audit_tags), r.state == R.STATES["complete"]) for r in rows)
    assert found == sorted([("same", 0, True), ("same", 1, False)] * 2 + [("None", 0, True), ("None", 1, False)])


def test_another_registry_and_an_unreadable_shape(spark, tmp_path):
    from gatelight.sources import files as S

    frames = M.frames(spark, [("L0", "complete_record")])
    more = {**R.LEVELS, "L0": {**R.LEVELS["L0"], "precision": ["integration_sensitivity_reported", "one_more"]}}
    path = tmp_path / "registry.json"
    path.write_text(json.dumps({"levels": more, "required_reviewer_roles": R.ROLES}, indent=1))
    row = classify(*frames, registry=S.registry(spark, str(path))).first()
    assert row.audit_tags == [
        "required_gate_declaration:precision:omitted=one_more", "precision:one_more=not_submitted", "precision:one_more=missing", "attestation:precision:one_more=missing_or_invalid",
    ]
    for levels, roles in ((None, {}), ({"L0": {"validity": ["a"]}}, {}), ({"L0": {"validity": ["a"], "substantive": [" "], "precision": ["b"]}}, {}), (R.LEVELS, None)):
        path.write_text(json.dumps({"levels": levels, "required_reviewer_roles": roles}))
        with pytest.raises(ValueError):
            S.registry(spark, str(path))
    assert S.shape(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "broken.json").write_text("{")
    assert S.shape(spark, str(tmp_path / "broken.json")) is None
    assert classify(*frames, shape=None).first().audit_tags == ["schema:formal_schema_unavailable"]
    (tmp_path / "small.json").write_text(json.dumps({"type": "object", "required": ["nothing"]}))
    assert classify(*frames, shape=S.shape(spark, str(tmp_path / "small.json"))).first().audit_tags == ["schema:jsonschema=root"]


SHAPE = {
    "type": "object", "additionalProperties": False, "required": ["a", "b"], "$defs": {"name": {"type": "string", "minLength": 2, "pattern": "^x"}},
    "properties": {
        "a": {"$ref": "#/$defs/name"}, "b": {"type": "integer", "minimum": 3}, "c": {"type": "array", "minItems": 2, "items": {"enum": ["p", "q"]}}, "d": {"type": "number"},
        "e": {"type": "object", "minProperties": 1, "additionalProperties": {"$ref": "#/$defs/name"}}, "f": {"type": "boolean"},
    },
}


@pytest.mark.parametrize(("text", "wanted"), [
    ('{"a": "xy", "b": 3}', []), ('{"a": "xy", "b": 4.0, "d": 1.5, "f": false, "e": {"g": "xx"}}', []), ("{}", ["root", "root"]), ("[]", ["root"]), ("null", ["root"]), ('"a"', ["root"]),
    ('{"a": "y", "b": 2, "z": 1, "zz": 2}', ["root", "a", "a", "b"]), ('{"a": null, "b": 3.5}', ["a", "b"]), ('{"a": "xy", "b": 3, "c": ["r"], "e": {}}', ["c", "c/0", "e"]),
    ('{"a": "xy", "b": 3, "c": ["p", 1, "p", "p", "p", "p", "p", "p", "p", "p", {}], "d": "1", "f": 1}', ["c/1", "c/10", "d", "f"]), ('{"a": "xy", "b": 3, "e": {"g": "x", "it\'s": 5, "a b": "xx"}}', ["e/g", "e/it's"]), (None, []),
])
def test_every_keyword_of_a_shape(spark, text, wanted):
    from gatelight.functions.schema_rules import violation_tags

    row = spark.createDataFrame([(text,)], "t string").select(F.try_parse_json("t").alias("v")).select(violation_tags(SHAPE, "v").alias("tags")).first()
    assert row.tags == [f"schema:jsonschema={x}" for x in wanted]


def test_a_shape_that_refers_to_itself_is_refused():
    from gatelight.functions.schema_rules import places

    with pytest.raises(ValueError, match="refers to itself"):
        places({"$defs": {"tree": {"type": "object", "additionalProperties": {"$ref": "#/$defs/tree"}}}, "$ref": "#/$defs/tree"})


def test_plan_does_not_grow_with_the_shape(spark):
    from gatelight.functions.schema_rules import violations

    def nodes(n: int) -> int:
        shape = {"type": "object", "properties": {f"p{i}": {"type": "string"} for i in range(n)}}
        return spark.range(1).select(F.try_parse_json(F.lit("{}")).alias("v")).select(violations(shape, "v"))._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get")

    assert nodes(3) == nodes(300)
