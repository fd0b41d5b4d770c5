import json
import os

import pytest
from pyspark.sql import functions as F

from gatelight.plans import record_cases as M
from gatelight.plans.classify import classify
from gatelight.sources import files as S
from gatelight.streaming import ingest


def test_files_are_classified_and_verified(spark, tmp_path):
    case = M.edited("L0", "complete_record")
    folder = tmp_path / "one"
    for path, data in case["files"].items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(data)
    (folder / "evidence_manifest.json").write_text(case["manifest"])
    (folder / "claims").mkdir()
    (folder / "claims/record.json").write_text(case["record"])
    manifests = S.manifest_files(spark, str(folder / "evidence_manifest.json"))
    key = manifests.first().manifest_key
    records = S.record_files(spark, str(folder / "claims"), F.lit(key))
    digests = S.digests(spark, str(folder)).withColumn("manifest_key", F.lit(key))
    row = classify(records, manifests, digests).first()
    assert row.audit_tags == [] and row.state.startswith("locally_provenance_complete")

    sums = str(folder / "MANIFEST.sha256")
    S.write_checksums(spark, str(folder), sums)
    listed = [r.path for r in S.checksums(spark, sums).collect()]
    assert "pins/token" in listed and not [x for x in listed if "MANIFEST" in x]
    assert S.verify_checksums(spark, sums, str(folder)).count() == 0
    (folder / "pins/token").write_text("one token\r\n")
    assert [r.path for r in S.verify_checksums(spark, sums, str(folder)).collect()] == ["pins/token"]
    with pytest.raises(ValueError, match="pins/token"):
        S.require_checksums(spark, sums, str(folder))


def test_checksum_lines_are_checked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x\r\ny")
    digest = M.sha("x\ny")
    lines = tmp_path / "sums"
    lines.write_text(f"# comment\n\n{digest}  a.txt\n")
    S.require_checksums(spark, str(lines), str(tmp_path / "in"))
    for bad in (f"{digest}  ../a.txt", f"{digest}  /a.txt", f"{digest} a.txt"):
        lines.write_text(f"{digest}  a.txt\n{bad}\n")
        with pytest.raises(ValueError):
            S.require_checksums(spark, str(lines), str(tmp_path / "in"))
    lines.write_text("# nothing\n")
    with pytest.raises(ValueError, match="no files"):
        S.require_checksums(spark, str(lines), str(tmp_path / "in"))


def test_links_that_leave_the_folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out.txt").write_text("x")
    os.symlink(tmp_path / "out.txt", tmp_path / "in/bad")
    (tmp_path / "in/a.txt").write_text("x")
    os.symlink(tmp_path / "in/a.txt", tmp_path / "in/good")
    assert S.escaping_links(str(tmp_path / "in")) == ["bad"]


def test_csv_and_reports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "w", 8, 5, 1.5, 0.5, 2.5, None)], S.CONFIRMATION_SCHEMA)
    S.write_csv(rows, str(tmp_path / "c"))
    assert S.table_csv(spark, str(tmp_path / "c"), S.CONFIRMATION_SCHEMA).collect() == rows.collect()
    S.write_report(rows, str(tmp_path / "r"))
    assert S.report(spark, str(tmp_path / "r"), S.CONFIRMATION_SCHEMA).collect() == rows.collect()
    (tmp_path / "one.json").write_text(json.dumps({"runs": 3, "counts": {"a": 1}}, indent=2))
    assert S.report(spark, str(tmp_path / "one.json"), "runs int, counts map<string,int>").first().counts == {"a": 1}


def test_stream_gives_the_same_as_a_batch(spark, tmp_path):
    records, manifests, files = M.frames(spark, [("L0", "complete_record"), ("L0", "manifest_digest")])
    records.write.parquet(str(tmp_path / "in"))
    query = ingest.classify_stream(ingest.record_stream(spark, str(tmp_path / "in")), manifests, files, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    found = {r.record_key: r.state for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {r.record_key: r.state for r in classify(records, manifests, files).collect()} and len(found) == 2
