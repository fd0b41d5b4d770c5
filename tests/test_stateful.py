"""Streams with state give what a batch gives, also when they are started anew from their checkpoint."""

import pytest
from pyspark.sql import functions as F

from gatelight.operators import conformance
from gatelight.streaming import stateful

EVENTS = "/root/testdata/sf0.001/events.parquet"
COLUMNS = "event_id long, ts timestamp, user_id long, value double"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(EVENTS).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").limit(400).cache()


def parts(events, folder, cuts, delay="2 days"):
    """Rows dealt to files that arrive one after the other; within a file, and between neighbouring files by a few hours, in no order. The last file ends all sessions."""
    shuffled = events.withColumn("late", F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(6 * 3_600_000_000)))
    ranked = [r.late for r in shuffled.select("late").orderBy("late").collect()]
    bounds = [ranked[len(ranked) * k // cuts] for k in range(1, cuts)]
    for k in range(cuts):
        low, high = ([None, *bounds][k], [*bounds, None][k])
        own = shuffled.filter((F.lit(True) if low is None else F.col("late") >= low) & (F.lit(True) if high is None else F.col("late") < high))
        own.drop("late").orderBy(F.rand(5)).coalesce(1).write.parquet(f"{folder}/{k}")
    events.sparkSession.sql("SELECT -1L AS event_id, TIMESTAMP '2100-01-01' AS ts, -1L AS user_id, 0D AS value").write.parquet(f"{folder}/{cuts}")


def run(spark, make, folder, out, checkpoint, files):
    """Runs over the files that are there by the number given, each as a micro-batch; returns the query."""
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(folder)
    query = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return query


def staged(spark, make, events, tmp_path, cuts=3):
    """Each part is put into the folder, and the query started anew for it."""
    import shutil

    parts(events, str(tmp_path / "made"), cuts)
    (tmp_path / "in").mkdir()
    late = 0
    for k in range(cuts + 1):
        shutil.copytree(tmp_path / "made" / str(k), tmp_path / "in" / str(k))
        query = run(spark, make, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), 1)
        late += stateful.late_rows(query)
    return spark.read.parquet(str(tmp_path / "out")), late


def rows(df):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)


def test_sessions(spark, events, tmp_path):
    make = lambda df: stateful.sessions(df, "user_id", "ts", "value", "5 hours", "1 day")
    found, late = staged(spark, make, events, tmp_path)
    expected = rows(make(events))
    assert rows(found.filter("user_id >= 0")) == expected and late == 0 and 1 < max(r[3] for r in expected)


def test_late_rows_are_counted(spark, events, tmp_path):
    make = lambda df: stateful.sessions(df, "user_id", "ts", "value", "5 hours", "1 day")
    for k, part in enumerate((events.filter("event_id % 7 <> 3"), spark.sql("SELECT -1L AS event_id, TIMESTAMP '2100-01-01' AS ts, -1L AS user_id, 0D AS value"), events.filter("event_id % 7 = 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        query = run(spark, make, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), k)
    assert stateful.late_rows(query) == events.filter("event_id % 7 = 3").count()
    assert rows(spark.read.parquet(str(tmp_path / "out")).filter("user_id >= 0")) == rows(make(events.filter("event_id % 7 <> 3")))


def test_gaps(spark, events, tmp_path):
    found, late = staged(spark, lambda df: stateful.gap_stream(df, "user_id", "ts", "event_id", "value", "1 day"), events, tmp_path)
    expected = stateful.gaps(events, "user_id", "ts", "event_id", "value")
    assert rows(found.filter("user_id >= 0")) == rows(expected) and late == 0


def test_copied_digests(spark, tmp_path):
    conf = {"spark.sql.streaming.stateStore.providerClass": stateful.ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        used = spark.createDataFrame([(f"d{k % 5 if k % 3 else k % 2}", k, f"E{k // 2}") for k in range(60)] + [(None, 99, "x")], "digest string, place long, evidence string")
        out, check = str(tmp_path / "out"), str(tmp_path / "check")
        for k in range(3):  # a new query from the checkpoint for each part
            used.filter(F.floor(F.col("place") / 20) == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
            stream = spark.readStream.schema(used.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
            made = stateful.copied_digest_stream(stream, F.col("digest"), "evidence", "place")
            query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        batch = conformance.copied_digests(used.filter("digest IS NOT NULL"), [], "digest", "evidence", ["place"])
        assert rows(spark.read.parquet(out).select("digest", "place", "evidence", "prior_id")) == rows(batch.select("digest", "place", "evidence", "prior_id"))
    finally:
        for name in conf:
            spark.conf.unset(name)
