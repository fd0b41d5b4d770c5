import duckdb
import pytest
from pyspark.sql import functions as F

from gatelight.plans import record_queries as Q
from gatelight.plans.classify import apart
from tests.test_queries import compare

ROWS = [("a", "{}", "m"), ("b", "{}", "m"), ("a", "{}", "m"), (None, "{}", "m"), ("c", "{}", None), ("d", None, "m"), ("e", None, None), ("f", "", "m"), ("g", "m {}", ""), ("h", " {}", "m")]


def test_equal_records_are_worked_on_once(spark):
    records = spark.createDataFrame(ROWS, "record_key string, record string, manifest_key string")
    texts, members = apart(records)
    assert sorted(map(str, ((r.record, r.manifest_key) for r in texts.collect()))) == sorted(map(str, {r[1:] for r in ROWS}))
    assert members.count() == len(ROWS)
    seen = []

    def work(rows):
        seen.append(rows.count())
        return rows.select("record_key", F.concat_ws("|", F.coalesce("record", F.lit("-")), F.coalesce("manifest_key", F.lit("-"))).alias("got"))

    found = Q._results(records, work).collect()
    assert seen == [7] and sorted((str(r.record_key), r.got) for r in found) == sorted((str(k), f"{'-' if t is None else t}|{'-' if m is None else m}") for k, t, m in ROWS)


def test_what_is_kept_of_a_record_is_plain(spark, monkeypatch):
    """A part of a VARIANT has all names of its record with it: none is written or shuffled for a gate."""
    from gatelight.plans import classify as K
    from gatelight.plans import record_cases as M

    kept = []
    shared_written, gate_tags = K.shared.written, K.gate_tags
    monkeypatch.setattr(K.shared, "written", lambda df, label: kept.append(df.schema.simpleString()) or shared_written(df, label))
    monkeypatch.setattr(K, "gate_tags", lambda ready, *rest: kept.append(ready.schema.simpleString()) or gate_tags(ready, *rest))
    K.classify(*M.frames(spark, [("L0", "complete_record")]))
    assert len(kept) == 2 and not any("variant" in k for k in kept)


def test_records_dealt_from_a_pool_hold_no_text(spark):
    pool = spark.createDataFrame([("x", "{}"), ("x", "{}"), ("y", None), ("z", "[]")], "manifest_key string, record string").distinct()
    records = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 3), (None, "x", 4), ("c", "none", 5), ("d", None, 6)], "record_key string, manifest_key string, n int")
    assert "record" not in apart(records, pool)[1].columns
    seen = []

    def work(rows):
        seen.append(sorted(map(str, ((r.manifest_key, r.record) for r in rows.collect()))))
        return rows.select("record_key", F.col("record").alias("got"))

    found = Q._results(records, work, pool).collect()
    assert seen == [["('x', '{}')", "('y', None)"]]
    assert sorted((r.n, r.record_key, r.got) for r in found) == [(1, "a", "{}"), (2, "a", "{}"), (3, "b", None), (4, None, "{}")]


def test_records_of_one_text_stay_in_their_tasks(spark):
    pool = F.broadcast(spark.createDataFrame([("x", "{}"), ("y", "[]")], "manifest_key string, record string"))
    records = spark.range(0, 800, 1, 8).select(F.col("id").cast("string").alias("record_key"), F.lit("x").alias("manifest_key"), F.spark_partition_id().alias("read_in"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = Q._results(records, lambda texts: texts.select("record_key", F.col("record").alias("got")), pool)
        rows = found.select("record_key", "got", "read_in", F.spark_partition_id().alias("joined_in")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(int(r.record_key) for r in rows) == list(range(800)) and {r.got for r in rows} == {"{}"}
    assert len({r.read_in for r in rows}) == 8 and all(r.read_in == r.joined_in for r in rows)


@pytest.mark.parametrize("name", ["q_schema_contrast", "q_fuzz_counts", "q_evidence_gates"])
def test_odd_customers_give_the_rows_of_sql(spark, tmp_path, name):
    """Repeated, negative and null keys."""
    spark.createDataFrame([(k,) for k in (0, 0, 7, -5, -3, None, 12, 12, 12)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    compare(Q.QUERIES[name](spark, str(tmp_path)), duck.sql(Q.ORACLE_SQL[name]))
