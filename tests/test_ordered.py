"""Running totals, last values and lags over ranges equal plain Python, with one key that holds most rows and many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from gatelight.operators import ordered

rng = random.Random(3)
ROWS = [(rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice([None, *range(60)]), k, rng.choice([None, -1.5, 2.0, 7.0])) for k in range(600)]
SCHEMA = "key string, at long, id long, value double"


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))


def expected():
    out = {}
    for key in {r[0] for r in ROWS}:
        total, high, last, before = 0.0, None, None, None
        for n, r in enumerate(in_order(x for x in ROWS if x[0] == key), 1):
            if r[3] is not None:
                total, last = total + r[3], r[3]
                high = r[3] if high is None else max(high, r[3])
            out[r[2]] = (n, total, high, last, before)
            before = r[3]
    return out


@pytest.mark.parametrize("n_ranges", [1, 13, None])
def test_running(spark, n_ranges):
    v = F.col("value")
    found = ordered.running(spark.createDataFrame(ROWS, SCHEMA), ["key"], ["at", "id"], {"n": F.lit(1), "total": v}, {"high": v}, {"last": v}, {"before": v}, n_ranges)
    assert {r.id: (r.n, r.total, r.high, r.last, r.before) for r in found.collect()} == expected()
    assert found.columns == ["key", "at", "id", "value", "n", "total", "high", "last", "before"]


def test_a_hot_key_is_divided(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"), (F.col("id") * 7919 % 20_000).alias("at"))
    sizes = [r["count"] for r in ordered.in_ranges(rows, ["key"], ["at"], 20).groupBy("range_").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * sorted(sizes)[10]


def test_more_rows_give_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 25)
    sizes = []
    in_ranges = ordered.in_ranges
    monkeypatch.setattr(ordered, "in_ranges", lambda *args: sizes.append(args[-1]) or in_ranges(*args))
    v = F.col("value")
    found = ordered.running(spark.createDataFrame(ROWS, SCHEMA), ["key"], ["at", "id"], {"n": F.lit(1), "total": v}, {"high": v}, {"last": v}, {"before": v})
    assert {r.id: (r.n, r.total, r.high, r.last, r.before) for r in found.collect()} == expected()
    assert sizes == [24]


def test_few_rows_are_handed_on(spark, monkeypatch):
    """With many keys only those that a border divides are joined."""
    handed = []
    broadcast = F.broadcast
    monkeypatch.setattr(ordered.F, "broadcast", lambda df: handed.append(df.count()) or broadcast(df))
    rows = spark.range(4000).select((F.col("id") % 1000).alias("key"), F.col("id").alias("at"))
    found = ordered.running(rows, ["key"], ["at"], {"n": F.lit(1)}, n_ranges=7)
    assert found.filter("n <> floor(at / 1000) + 1").count() == 0 and found.count() == 4000
    assert handed[0] < 7


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ordered.running(none, ["key"], ["at"], {"n": F.lit(1)}).count() == 0
    assert ordered.within_after(none, ["key"], "at", "id", 5).count() == 0
    assert ordered.as_of(none, none, ["key"], "at", "id", {"found": "value"}).count() == 0


@pytest.mark.parametrize("n_ranges", [None, 17])
def test_within_after(spark, n_ranges):
    rows = [r for r in ROWS if r[1] is not None]
    found = ordered.within_after(spark.createDataFrame(rows, SCHEMA), ["key"], "at", "id", 7, n_ranges).collect()
    for r in found:
        own = [x[2] for x in rows if x[0] == r.key and r.key is not None and r.at < x[1] <= r.at + 7]
        assert (r.n, r.highest) == (len(own), max(own, default=None))
    assert len(found) == len(rows)


@pytest.mark.parametrize("n_ranges", [None, 11])
def test_as_of(spark, n_ranges):
    left = [(k, a, i, v) for k, a, i, v in ROWS if i % 3]
    right = [(k, a, i, v) for k, a, i, v in ROWS if not i % 3 and i % 5]
    found = ordered.as_of(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["key"], "at", "id", {"other": "id", "price": "value"}, n_ranges).collect()
    assert len(found) == len(left)
    for r in found:
        own = [x for x in right if None not in (x[0], x[1], r.key, r.at) and x[0] == r.key and x[1] <= r.at]
        best = max(own, key=lambda x: (x[1], x[2]), default=(None,) * 4)
        assert (r.other, r.price) == (best[2], best[3])
