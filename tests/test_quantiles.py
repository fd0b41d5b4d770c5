"""Quantiles by group equal those of sorted values, whatever the distribution and however many rounds it takes."""

import math

import numpy as np
import pytest

from gatelight.operators import quantiles

rng = np.random.default_rng(9)
GROUPS = {
    "outlier": [*range(1, 3000), 1e12],
    "heavy": list(np.exp(rng.normal(0, 12, 2500))),
    "alike": [7.0] * 2000 + [8.0] * 3 + [-1e300],
    "two": [1.0, 2.0],
    "one": [5.5],
    None: list(rng.normal(size=900)),
}
WANTED = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "most": 1.0}


@pytest.mark.parametrize("limit", [100_000, 50, 2])
def test_equals_sorted_values(spark, limit):
    rows = [(g, float(v)) for g, own in GROUPS.items() for v in own] + [("two", None), ("two", math.nan), ("none", None)]
    found = {r.g: r for r in quantiles.by_group(spark.createDataFrame(rows, "g string, v double"), "g", "v", WANTED, digits=9, limit=limit).collect()}
    assert set(found) == set(GROUPS)
    for g, own in GROUPS.items():
        for name, q in WANTED.items():
            assert math.isclose(found[g][name], float(np.quantile(own, q)), rel_tol=1e-9, abs_tol=1e-8), (g, name)


def test_a_round_leaves_few_values_of_a_heavy_tail(spark):
    """199,999 even values and one far outlier: a bracket holds some hundredths of them after one round."""
    known = spark.range(1, 200_001).selectExpr("'a' AS g", "IF(id = 200000, 1e12D, CAST(id AS DOUBLE)) AS v")
    wide = spark.createDataFrame([("a", 10_000, 1.0, 1e12, 0, 200_000)], "g string, rank long, low double, high double, below long, inside long")
    row = quantiles._narrowed(known, wide).collect()[0]
    assert row.inside < 200_000 * 3.5 / quantiles.PARTS and row.below <= 10_000 < row.below + row.inside


def test_empty(spark):
    assert quantiles.by_group(spark.createDataFrame([], "g string, v double"), "g", "v", WANTED).count() == 0
