"""Merged sketches keep within their stated errors, and don't depend on how parts are cut."""

import numpy as np
from pyspark.sql import functions as F

from gatelight.operators import sketches

N = 200_000


def test_errors_of_merged_parts(spark):
    rows = spark.range(N).select(F.pmod("id", F.lit(37)).alias("part"), (F.pmod("id", F.lit(3)) == 0).alias("side"), F.exp(F.randn(3) * 4).alias("v"), F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("item")).cache()
    parts = sketches.by_part(rows, ["part", "side"], "v", "item")
    assert max(len(r["values"]) + len(r["items"]) for r in parts.collect()) < 80_000
    exact = {s: np.sort([r.v for r in rows.filter(F.col("side") == s).select("v").collect()]) for s in (True, False)}
    shares = (0.01, 0.05, 0.5, 0.95, 0.99)
    told = sketches.merged(parts, ["side"]).select("side", "n", sketches.distinct(F.col("items")).alias("about"), *[sketches.quantile(F.col("values"), q).alias(str(q)) for q in shares])
    for r in told.collect():
        own = exact[r.side]
        assert r.n == len(own) and all(abs(np.searchsorted(own, r[str(q)]) / len(own) - q) <= sketches.rank_error() for q in shares)
        real = rows.filter(F.col("side") == r.side).select("item").distinct().count()
        assert abs(r.about - real) <= sketches.distinct_error() * real


def test_nulls_and_empty_parts(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 1.0, "x"), ("b", 3.0, "y"), ("b", None, "y"), (None, 2.0, None)], "part string, v double, item string")
    found = {r.part: r for r in sketches.by_part(rows, ["part"], "v", "item").select("part", "n", sketches.quantile(F.col("values"), 1.0).alias("q"), sketches.distinct(F.col("items")).alias("d")).collect()}
    assert (found["a"].n, found["a"].q, found["a"].d) == (0, None, 0) and (found["b"].n, found["b"].q, found["b"].d) == (2, 3.0, 2) and found[None].q == 2.0
    assert sketches.by_part(rows.limit(0), ["part"], "v", "item").count() == 0
