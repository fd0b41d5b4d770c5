import hashlib

from pyspark.sql import functions as F

from gatelight.functions import registry_values as R
from gatelight.operators import conformance as C
from gatelight.operators import integrity as I


def test_registry_has_72_rows_with_roles(spark):
    gates = C.required_roles(C.registry_gates(spark)).collect()
    assert len(gates) == 72 and all(g.role for g in gates)
    sizes = {level: sum(g.level == level for g in gates) for level in R.LEVELS}
    assert sizes == {"L0": 5, "L1": 17, "L2": 15, "L3": 16, "L4": 19}
    roles = {(g.family, g.gate): g.role for g in gates}
    assert roles["validity", "queue_log_integrity"] == "operations_reviewer" and roles["precision", "interval_rule"] == "statistical_reviewer"


def test_fold_takes_the_first_rule_that_holds(spark):
    cases = {
        "complete": [("validity", "pass"), ("substantive", "pass"), ("precision", "pass")],
        "not_assessable": [("validity", "fail"), ("substantive", "fail"), ("precision", "fail")],
        "failed": [("validity", "pass"), ("substantive", "fail"), ("precision", "missing")],
        "inconclusive": [("validity", "pass"), ("substantive", "pass"), ("precision", "invalid")],
    }
    rows = [(name, f, s) for name, own in cases.items() for f, s in own] + [("not_assessable_2", "substantive", "missing"), ("not_assessable_2", "substantive", "fail")]
    found = {r.id: r.state for r in C.fold_states(spark.createDataFrame(rows, "id string, family string, status string"), ["id"]).collect()}
    assert found.pop("not_assessable_2") == R.STATES["not_assessable"]
    assert found == {name: R.STATES[name] for name in cases}


def test_order_of_rows_does_not_matter(spark):
    rows = [(1, k, [f"t{k}", f"u{k}"] if k % 2 else []) for k in range(6)]
    frames = [spark.createDataFrame(r, "id int, place int, tags array<string>") for r in (rows, rows[::-1])]
    one, two = (C.ordered_tags(f, ["id"], ["place"]).first().tags for f in frames)
    assert one == two == ["t1", "u1", "t3", "u3", "t5", "u5"]


def test_copied_digest_looks_at_the_use_before(spark):
    rows = [(1, 1, "d", "A"), (1, 2, "d", "A"), (1, 3, "d", "B"), (1, 4, "e", "C"), (1, 5, "d", "A"), (2, 1, "d", "Z")]
    found = C.copied_digests(spark.createDataFrame(rows, "id int, place int, digest string, evidence string"), ["id"], "digest", "evidence", ["place"])
    assert {(r.id, r.place): r.prior_id for r in found.collect()} == {(1, 1): None, (1, 2): None, (1, 3): "A", (1, 4): None, (1, 5): "B", (2, 1): None}


def test_elapsed_days_are_whole_days(spark):
    rows = spark.createDataFrame([("2026-07-01 00:00:00", "2025-07-01 00:00:01"), ("2026-07-01 00:00:00", "2026-07-01 00:00:01")], "a string, b string")
    assert [r[0] for r in rows.select(C.elapsed_days(F.to_timestamp("a"), F.to_timestamp("b"))).collect()] == [364, -1]


def test_newline_digests_and_mismatches(spark):
    rows = [("a", b"x\r\ny\rz\n"), ("b", b"\xff\r\n"), ("c", b"")]
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "path string, content binary")
    found = {r.path: r.digest for r in frame.select("path", I.newline_digest(F.col("content")).alias("digest")).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert found == {"a": sha(b"x\ny\nz\n"), "b": sha(b"\xff\r\n"), "c": sha(b"")}
    lines = spark.createDataFrame([("# note",), ("",), (f"{found['a']}  a",), ("00  b",), ("11  gone  file",)], "value string")
    bad = I.mismatches(I.checksum_lines(lines), frame.select("path", I.newline_digest(F.col("content")).alias("digest"))).collect()
    assert {(r.path, r.expected, r.found) for r in bad} == {("b", "00", found["b"]), ("gone  file", "11", None)}


def test_path_errors(spark):
    cases = {"a/b.txt": None, " ": "path_missing_or_invalid", "a\\b": "path_not_posix", "/a": "path_not_normalized_relative", "a/../b": "path_not_normalized_relative", "a//b": None, "C:/a": "path_not_normalized_relative", "..": "path_not_normalized_relative"}
    rows = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.e for r in rows.select("path", I.path_error(F.col("path")).alias("e")).collect()} == cases
