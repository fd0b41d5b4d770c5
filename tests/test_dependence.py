"""Intervals for dependent blocks equal plain formulas, and cover where those for independent blocks don't."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelight.functions.statistics import t_critical, t_factors
from gatelight.operators import decisions, dependence


def series(spark, groups):
    rows = [(g, k, None if v is None else float(v)) for g, values in groups.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, k int, v double")


def newey_west(x, lags):
    d, n = x - x.mean(), len(x)
    total = sum((1 if k == 0 else 2 * (1 - k / (lags + 1))) * (d[k:] * d[: n - k]).sum() for k in range(lags + 1))
    return math.sqrt(max(total, 0) / (n - 1) / n)


@pytest.mark.parametrize(("segment", "n_ranges"), [(4096, None), (5, 7)])
def test_hac_equals_the_formula(spark, monkeypatch, segment, n_ranges):
    monkeypatch.setattr(dependence, "SEGMENT", segment)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=230), "b": rng.normal(size=41).cumsum(), "c": np.array([2.0, 5.0]), "one": np.array([3.0])}
    rows = series(spark, groups | {"none": [None]})
    found = {r.g: r for r in dependence.hac_interval(rows, ["g"], ["k"], "v", n_ranges=n_ranges).collect()}
    assert set(found) == set(groups)
    for g, x in groups.items():
        lags = min(math.floor(4 * (len(x) / 100) ** (2 / 9)), len(x) - 1)
        assert (found[g].n, found[g].lags) == (len(x), lags)
        if len(x) == 1:
            assert found[g].se is None and found[g].lower is None
            continue
        se = newey_west(x, lags)
        assert math.isclose(found[g].se, se, rel_tol=1e-9) and math.isclose(found[g].upper - found[g].lower, 2 * t_critical(len(x) - 1) * se, rel_tol=1e-9)


def test_no_lags_are_the_interval_for_independent_blocks(spark):
    rows = series(spark, {"a": np.random.default_rng(2).normal(size=57)})
    hac = dependence.hac_interval(rows, ["g"], ["k"], "v", lags=F.lit(0)).collect()[0]
    plain = decisions.t_interval(decisions.block_summary(rows, ["g"], "v")).collect()[0]
    assert all(math.isclose(hac[c], plain[c], rel_tol=1e-9) for c in ("mean", "se", "lower", "upper"))


def test_bounds_cover_dependent_series(spark):
    """150 series of 240 steps with correlation 0.7: the lower bound holds the mean 0 in 95 % of cases by design."""
    rng, rho, groups = np.random.default_rng(4), 0.7, {}
    for g in range(150):
        x = np.zeros(260)
        for k in range(1, 260):
            x[k] = rho * x[k - 1] + rng.normal()
        groups[str(g)] = x[20:]
    rows = series(spark, groups).cache()
    held = lambda found: np.mean([r.lower <= 0 for r in found.select("lower").collect()])
    plain = held(decisions.t_interval(decisions.block_summary(rows, ["g"], "v")))
    blocks = held(dependence.block_bootstrap(rows, ["g"], F.floor(F.col("k") / 20), "v", replicates=199))
    hac = held(dependence.hac_interval(rows, ["g"], ["k"], "v", lags=F.lit(15)))
    assert plain < 0.84 and blocks > 0.85 and hac > 0.85


def test_bootstrap_of_constants_and_single_blocks(spark):
    rows = series(spark, {"same": [2.0] * 40, "one": [1.0, 4.0], "none": [None]})
    found = {r.g: r for r in dependence.block_bootstrap(rows, ["g"], F.floor(F.col("k") / 4), "v", replicates=50).collect()}
    assert (found["same"].lower, found["same"].upper, found["same"].se, found["same"].blocks) == (2.0, 2.0, 0.0, 10)
    assert (found["one"].mean, found["one"].lower, found["one"].n) == (2.5, None, 2) and "none" not in found


def test_poisson_weights():
    from collections import Counter

    below, counts = 0.0, Counter()
    u = (np.arange(200_000) + 0.5) / 200_000
    w, term = np.zeros(len(u), int), math.exp(-1)
    for k in range(12):
        below += term
        w += u > below
        term /= k + 1
    counts.update(w.tolist())
    assert abs(np.mean(w) - 1) < 1e-4 and abs(np.var(w) - 1) < 1e-3


def test_poisson_column_equals_inversion(spark):
    u = [0.1, 0.3678, 0.3679, 0.7357, 0.7359, 0.9999, 1 - 1e-12]
    found = [r.w for r in spark.createDataFrame([(x,) for x in u], "u double").select(dependence.poisson(F.col("u")).alias("w")).collect()]
    sums = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    assert found == [int((x > sums).sum()) for x in u]


def test_cluster_robust_and_hierarchical(spark):
    rng = np.random.default_rng(6)
    rows = [("a", c, float(v)) for c in range(9) for v in rng.normal(rng.normal() * 2, 1, 3 + 4 * c)]
    rows += [("flat", c, 5.0) for c in range(4)] + [("one", 0, 1.0), ("one", 0, 2.0), ("one", None, None), (None, 1, 1.0), (None, None, 3.0)]
    df = spark.createDataFrame(rows, "g string, c int, v double")
    robust = {r.g: r for r in dependence.cluster_robust(df, ["g"], "c", "v").collect()}
    mixed = {r.g: r for r in dependence.hierarchical(df, ["g"], "c", "v").collect()}
    x, of = np.array([v for g, _, v in rows if g == "a"]), np.array([c for g, c, _ in rows if g == "a"])
    sums = np.array([(x[of == c] - x.mean()).sum() for c in range(9)])
    assert math.isclose(robust["a"].se, math.sqrt(9 / 8 * (sums**2).sum()) / len(x), rel_tol=1e-9) and robust["a"].clusters == 9
    c, m = np.bincount(of), np.array([x[of == k].mean() for k in range(9)])
    msw = sum(((x[of == k] - m[k]) ** 2).sum() for k in range(9)) / (len(x) - 9)
    msb = (c * (m - x.mean()) ** 2).sum() / 8
    between = (msb - msw) / ((len(x) - (c**2).sum() / len(x)) / 8)
    w = 1 / (between + msw / c)
    assert math.isclose(mixed["a"].between, between, rel_tol=1e-9) and math.isclose(mixed["a"].mean, (w * m).sum() / w.sum(), rel_tol=1e-9) and math.isclose(mixed["a"].se, w.sum() ** -0.5, rel_tol=1e-9)
    assert (robust["flat"].se, mixed["flat"].se, mixed["flat"].mean) == (0.0, 0.0, 5.0)
    assert robust["one"].se is None and mixed["one"].lower is None and robust[None].clusters == 2 and robust[None].mean == 2.0


def test_quantiles_for_many_blocks(spark):
    for df in (201, 350, 1000, 100_000):
        assert math.isclose(sum(f / df**k for k, f in enumerate(t_factors())), t_critical(df), abs_tol=1e-9)
    rows = spark.createDataFrame([("a", float(k % 7)) for k in range(900)] + [("b", 1.0), ("b", 2.0)], "g string, value double")
    for r in decisions.t_interval(decisions.block_summary(rows, ["g"])).collect():
        assert math.isclose(r.upper - r["mean"], t_critical(r.n - 1) * r.se, rel_tol=1e-9)
