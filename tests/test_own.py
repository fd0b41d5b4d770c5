import json
import os
import types

import pytest
from pyspark.sql import functions as F

from gatelight.functions import registry_values as R
from gatelight.functions import variants as V
from gatelight.functions.schema_rules import read_typed, typed, written_alike
from gatelight.plans import classify as K
from gatelight.plans import order_records as O
from gatelight.plans import record_cases as M
from gatelight.plans.classify import classify, classify_own

PAIRS = [(level, name) for level in ("L0", "L1", "L4") for name in M.CASES]


def own_rows(records, manifests, files):
    held = files.groupBy("manifest_key").agg(F.collect_list(F.struct(*[c for c in files.columns if c != "manifest_key"])).alias("files"))
    return records.join(manifests, "manifest_key", "left").join(held, "manifest_key", "left")


def told(df) -> dict:
    return {r.record_key: r.asDict(True) for r in df.collect()}


def test_own_manifests_give_what_joined_ones_give(spark):
    frames = M.frames(spark, PAIRS)
    found = told(classify_own(own_rows(*frames)))
    assert len(found) == len(PAIRS) and found == told(classify(*frames))


def fitting(rows) -> tuple[int, int]:
    """How many records, and manifests, are read as plain types."""
    read = V.once(rows, r=read_typed(F.col("record"), K._RECORD_TYPE), n=read_typed(F.col("manifest"), K._MANIFEST_TYPE))
    found = read.select(K._fitting_record(F.col("r"), F.col("record"), R.PUBLISHED).cast("int").alias("a"), K._fitting_manifest(F.col("n"), F.col("manifest")).cast("int").alias("b"))
    return tuple(found.agg(F.sum("a"), F.sum("b")).first())


@pytest.fixture
def usual(monkeypatch):
    """Cases as Spark writes JSON: without spaces, in the order of the shape."""
    monkeypatch.setattr(M, "json", types.SimpleNamespace(dumps=lambda x, **_: json.dumps(x, separators=(",", ":"), ensure_ascii=False)))


def test_plain_types_give_what_values_give(spark, usual):
    frames = M.frames(spark, PAIRS)
    rows = own_rows(*frames)
    records, manifests = fitting(rows)
    assert records > 150 and manifests > 150 and told(classify_own(rows)) == told(classify(*frames))


IN_RECORD = [
    ('"status":"pass"', '"status":"pass","status":"fail"'), ('"gates":{"validity":{', '"gates":{"validity":{"boundary_declared":{"status":"fail"},'), ('"status":"pass"', '"status":"odd"'), ('"status":"pass"', '"status":null'),
    ('"minimum_manifest_sequence":4', '"minimum_manifest_sequence":4.0'), ('"minimum_manifest_sequence":4', '"minimum_manifest_sequence":"4"'), ('"minimum_manifest_sequence":4', '"minimum_manifest_sequence":true'),
    ('"minimum_manifest_sequence":4', '"minimum_manifest_sequence":-1'), ('"minimum_manifest_sequence":4', '"minimum_manifest_sequence":99999999999999999999'), ('"id":"claim-L0"', '"id":""'), ('"id":"claim-L0"', '"id":" "'),
    ('"id":"claim-L0"', '"id":null'), ('"id":"claim-L0"', '"id":5'), ('"owner-17"', '"owner\\u002d17"'), ('"owner-17"', '"R measurement_assurance_reviewer"'), ('"reason":"as planned"', '"reason":5'), ('"reason":"as planned"', ""),
    ('"reason":"as planned"', '"reason":null'), ('"disposition":"attested"', '"disposition":"attested","more":1'), ('"disposition":"attested"', '"disposition":"it\'s \\"odd\\""'), ('"disposition":"attested",', ""),
    ('"disposition":"attested"', '"disposition":null'), ('"evidence_version":"v3",', ""), ('"conflict_declaration":"none"', '"conflict_declaration":"some"'), ('"evidence_profile":"L0"', '"evidence_profile":"L9"'),
    ('"claim_binding":{"claim_id":"claim-L0",', '"claim_binding":{'), ('"claim_binding":{', '"claim_binding":{"more":"x",'), ('["some exclusions"]', '[""]'), ('["some exclusions"]', "[null]"), ('["some exclusions"]', "[]"),
    ('"reviewed_at_utc":"2030', '"reviewed_at_utc":"1990'), ("{", " {"), ("{", "[{"), ('"id":', '"id":"x","id":'), ('"reviewer_id":"R', '"reviewer_id":"S'), ('["boundary_declared"', '["boundary_declared","boundary_declared"'),
]
IN_MANIFEST = [
    ('"sequence":4', '"sequence":4.0'), ('"sequence":4', '"sequence":3'), ('"sequence":4', '"sequence":null'), ('"manifest_id":"M-1"', '"manifest_id":" "'), ('"E-000":{', '"E-000":{},"E-000":{'), ('"E-000":{', '"E-000":null,"E":{'),
    ('"status":"active"', '"status":"it\'s"'), ('"status":"active",', ""), ('"permitted_gates":["validity.boundary_declared"]', '"permitted_gates":[null,5]'), ('"permitted_claim_ids":["claim-L0"]', '"permitted_claim_ids":null'),
    ('"path":"proof/E-000.bin"', '"path":"proof//E-000.bin/"'), ('"path":"proof/E-000.bin"', '"path":"../E-000.bin"'), ('"path":"proof/E-000.bin",', ""), ('"local_integrity_token":{', '"local_integrity_token":{"more":1,'),
    ('"path":"pins/token",', ""), ('"role":"measurement_assurance_reviewer"', '"role":"x"'), ('"role":"measurement_assurance_reviewer",', ""), ("{", "{{"), ('"expires_at_utc":"2033', '"expires_at_utc":"1990'),
    ('"sha256"', '"sha256":"","sha256"'), ('"version":"v3"', '"version":3'),
]


def test_odd_texts_give_what_values_give(spark, usual):
    """Texts that a plain type would read, but not as what they are."""
    case = M.edited("L0", "complete_record")
    record, manifest = case["record"], case["manifest"]
    assert not [old for text, edits in ((record, IN_RECORD), (manifest, IN_MANIFEST)) for old, _ in edits if old not in text]
    made = [(record.replace(old, new, 1), manifest) for old, new in IN_RECORD] + [(record + " x", manifest), ("", manifest), ("null", manifest), (record, None), (record, ""), (None, manifest)]
    for old, new in IN_MANIFEST:
        text = manifest.replace(old, new, 1)
        made.append((record.replace(M.sha(manifest), M.sha(text)), text))
    rows = spark.createDataFrame([(str(n), r, str(n), m, m and M.sha(m), [(p, M.sha(t)) for p, t in case["files"].items()]) for n, (r, m) in enumerate(made)],
                                 "record_key string, record string, manifest_key string, manifest string, digest string, files array<struct<path:string,digest:string>>")
    joined = classify(rows.select("record_key", "record", "manifest_key"), rows.select("manifest_key", "manifest", "digest"), rows.select("manifest_key", F.explode("files").alias("x")).select("manifest_key", "x.*"))
    found, wanted = told(classify_own(rows)), told(joined)
    assert not {made[int(k)]: (found[k], wanted[k]) for k in wanted if found[k] != wanted[k]} and len(found) == len(made)


def test_a_type_of_a_shape(spark):
    shape = {"type": "object", "additionalProperties": False, "required": ["a"], "properties": {
        "a": {"type": "string", "minLength": 2, "pattern": "^x"}, "b": {"type": "array", "minItems": 1, "items": {"enum": ["p", "q"]}}, "c": {"type": "object", "minProperties": 1, "additionalProperties": {"type": "integer", "minimum": 3}}}}
    kind, fits = typed(shape, {})
    texts = {'{"a":"xy"}': True, '{"a":"xy","b":["p"],"c":{"d":3}}': True, '{"a":"x"}': False, '{"a":"yy"}': False, "{}": False, '{"a":"xy","b":[]}': False, '{"a":"xy","b":["r"]}': False, '{"a":"xy","b":[null]}': False,
             '{"a":"xy","c":{}}': False, '{"a":"xy","c":{"d":2}}': False, '{"a":"xy","c":{"d":3,"d":3}}': False, '{"a": "xy"}': False, '{"a":"xy","z":1}': False, '{"a":"xy","c":{"d":null}}': False}
    rows = V.once(spark.createDataFrame([(t,) for t in texts], "t string"), x=read_typed(F.col("t"), kind))
    assert {r.t: r.ok for r in rows.select("t", (written_alike(F.col("x"), F.col("t")) & F.coalesce(fits(F.col("x")), F.lit(False))).alias("ok")).collect()} == texts
    with pytest.raises(ValueError, match="no type"):
        typed({"type": "object"}, {})


def test_links_that_leave_a_folder(spark):
    records, manifests, files = M.frames(spark, [("L0", "complete_record"), ("L1", "complete_record")])
    files = files.withColumn("escapes", F.expr("path IN ('proof/E-001.bin', 'proof/E-002.bin') OR (path = 'pins/token' AND manifest_key LIKE 'L1%')"))
    found = told(classify_own(own_rows(records, manifests, files)))
    assert found == told(classify(records, manifests, files)) and sum("path_escapes_manifest_root" in t for r in found.values() for t in r["audit_tags"]) == 3


def test_orders_write_no_table_and_shuffle_no_text(spark):
    """A record, a manifest and tags weigh 20 KB an order: the disk must hold none of them, only lines and orders."""
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    found = O.q_classify_orders(spark, "/root/testdata/sf0.001")
    assert found.count() == 1500 and set(os.listdir(shared)) == before
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(dealt) == 2 and all("hashpartitioning" in line for line in dealt)


@pytest.mark.parametrize("n", [1, 3])
def test_orders_are_dealt_by_their_number(spark, monkeypatch, n):
    monkeypatch.setattr(O, "PER_TASK", 1500 // (8 * n))
    assert O.frame(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8 * n
