"""Intervals for means of blocks that depend on each other: HAC, block bootstrap, cluster-robust and hierarchical.

All are sums of the rows: one aggregate to blocks or clusters, then work on those. Bounds are one-sided; with t quantiles for the first and the last two.

Null values don't count. Groups with a single block or cluster have null errors and bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.functions.statistics import digest, uniform
from gatelight.operators import ordered
from gatelight.operators.decisions import with_t

#: Values of one task when lag products are summed.
SEGMENT = 4096


def lag_rule(n: Column) -> Column:
    """The whole part of 4 (n / 100)^(2/9), one less than the number of blocks at most: the usual rule for Bartlett weights."""
    return F.least(F.floor(4 * F.pow(n / 100, F.lit(2 / 9))), n - 1).cast("int")


def _bounds(summary: DataFrame, df: Column) -> DataFrame:
    out = with_t(summary, df)
    return out.withColumns({"lower": F.col("mean") - F.col("t") * F.col("se"), "upper": F.col("mean") + F.col("t") * F.col("se")}).drop("t")


def autocovariances(series: DataFrame, by: list[str], order: list[str], value: str, lags: Column | None = None, n_ranges: int | None = None) -> DataFrame:
    """by, n, mean, lags and products: for each lag from 0 on, the sum of the products of deviations from the mean.

    Rows get their numbers in the order of their group and go to segments of SEGMENT rows (or as many as there are lags); the last rows of a segment, as
    many as there are lags, also go to the next one. Each segment sums the products of its own rows at all lags at once.
    """
    v = F.col(value)
    known = series.filter(v.isNotNull())
    stats = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"))
    stats = stats.withColumn("lags", lags if lags is not None else lag_rule(F.col("n")))
    numbered = ordered.running(known.select(*by, *order, v.alias("v_")), by, order, {"nr": F.lit(1)}, n_ranges=n_ranges)
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]
    rows = numbered.join(stats.withColumnsRenamed({c: f"{c}_of" for c in by}), same).select(*by, (F.col("nr") - 1).alias("nr"), (F.col("v_") - F.col("mean")).alias("d"), "n", "mean", "lags")
    size = F.greatest(F.lit(SEGMENT), F.col("lags"))
    own = F.floor(F.col("nr") / size)
    late = F.col("nr") % size >= size - F.col("lags")
    dealt = rows.withColumn("segment", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("own", F.col("segment") == own)
    lists = dealt.groupBy(*by, "segment").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("lags").alias("lags"), F.array_sort(F.collect_list(F.struct("nr", "d", "own"))).alias("x"))
    at = lambda i: F.get("x", i.cast("int"))
    product = lambda k: lambda total, i: total + F.when(at(i)["own"] & (i >= k), at(i)["d"] * at(i - k)["d"]).otherwise(0.0)
    at_lag = F.transform(F.sequence(F.lit(0), F.col("lags")), lambda k: F.aggregate(F.sequence(F.lit(0), F.size("x") - 1), F.lit(0.0), product(k)))
    sums = lists.select(*by, "n", "mean", "lags", F.posexplode(at_lag).alias("lag", "s"))
    sums = sums.groupBy(*by, "lag").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("lags").alias("lags"), F.sum("s").alias("s"))
    each = F.array_sort(F.collect_list(F.struct("lag", "s")))
    return sums.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("lags").alias("lags"), F.transform(each, lambda x: x["s"]).alias("products"))


def hac_interval(series: DataFrame, by: list[str], order: list[str], value: str, lags: Column | None = None, n_ranges: int | None = None) -> DataFrame:
    """by, n, mean, lags, se, lower, upper by Newey and West: Bartlett weights of the autocovariances up to lags (lag_rule if not given), with n - 1 in
    place of n so that no lags give the interval for independent blocks. A sum below 0 can't occur with these weights."""
    found = autocovariances(series, by, order, value, lags, n_ranges)
    weight = lambda x, k: x * F.when(k == 0, 1.0).otherwise(2 * (1 - k / (F.col("lags") + 1)))
    total = F.aggregate(F.transform("products", weight), F.lit(0.0), lambda a, x: a + x)
    se = F.when(F.col("n") > 1, F.sqrt(F.greatest(total, F.lit(0.0)) / (F.col("n") - 1) / F.col("n")))
    return _bounds(found.select(*by, "n", "mean", "lags", se.alias("se")), F.col("n") - 1)


def poisson(u: Column, top: int = 12) -> Column:
    """A Poisson number of mean 1 by inversion of u in (0, 1); beyond top, which has a chance under 1e-10, it is top."""
    out, term, below = F.lit(0), 2.718281828459045**-1, 0.0
    for k in range(top):
        below += term
        out = out + (u > below).cast("int")
        term /= k + 1
    return out


def block_bootstrap(rows: DataFrame, by: list[str], block: Column, value: str, replicates: int = 399, seed: int = 7, share: float = 0.05) -> DataFrame:
    """by, blocks, n, mean, se, lower, upper: bounds of the mean by resampling whole blocks, at the quantiles share and 1 - share of the replicates.

    Rows are summed to blocks once and never copied. A replicate gives each block a Poisson weight made from the digest of
    (seed, replicate, block), so weights don't depend on partitions; its mean is the ratio of weighted sums. Replicates that weigh nothing don't count.
    """
    sums = rows.filter(F.col(value).isNotNull()).groupBy(*by, block.alias("block_")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    drawn = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    # Replicate 0 is the sample itself.
    w = F.when(F.col("replicate") == 0, 1).otherwise(poisson(uniform(digest(F.lit(seed), F.col("replicate"), F.col("block_")))))
    each = drawn.withColumn("w", w).groupBy(*by, "replicate").agg(F.sum(F.col("w") * F.col("s")).alias("s"), F.sum(F.col("w") * F.col("c")).alias("c"), F.count(F.lit(1)).alias("blocks"))
    mean, real = F.try_divide(F.col("s"), F.col("c")), F.col("replicate") == 0
    many = lambda x: F.when(F.col("blocks") > 1, x)
    out = each.withColumn("m", mean).groupBy(*by).agg(
        F.max("blocks").alias("blocks"),
        F.max(F.when(real, F.col("c"))).alias("n"),
        F.max(F.when(real, F.col("m"))).alias("mean"),
        F.stddev_samp(F.when(~real, F.col("m"))).alias("se"),
        F.percentile(F.when(~real, F.col("m")), F.array(F.lit(share), F.lit(1 - share))).alias("q"),
    )
    return out.select(*by, "blocks", "n", "mean", many(F.col("se")).alias("se"), many(F.get("q", F.lit(0))).alias("lower"), many(F.get("q", F.lit(1))).alias("upper"))


def _clusters(rows: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    """by, cluster, c_, m_ and within (the sum of squares about m_) of each cluster."""
    v = F.col(value)
    return rows.filter(v.isNotNull()).groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("c_"), F.avg(v).alias("m_"), (F.var_pop(v) * F.count(F.lit(1))).alias("within"))


def _with_totals(clusters: DataFrame, by: list[str], totals: DataFrame) -> DataFrame:
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]
    return clusters.join(totals.withColumnsRenamed({c: f"{c}_of" for c in by}), same).drop(*[f"{c}_of" for c in by])


def cluster_robust(rows: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    """by, clusters, n, mean, se, lower, upper: the sandwich error of the mean, with the correction G / (G - 1) for few clusters and t quantiles of G - 1."""
    clusters = _clusters(rows, by, cluster, value)
    totals = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), F.sum("c_").alias("n"), (F.sum(F.col("c_") * F.col("m_")) / F.sum("c_")).alias("mean"))
    squares = _with_totals(clusters, by, totals).groupBy(*by, "clusters", "n", "mean").agg(F.sum(F.pow(F.col("c_") * (F.col("m_") - F.col("mean")), F.lit(2))).alias("q"))
    g = F.col("clusters")
    se = F.when(g > 1, F.sqrt(g / (g - 1) * F.col("q")) / F.col("n"))
    return _bounds(squares.select(*by, "clusters", "n", "mean", se.alias("se")), g - 1)


def hierarchical(rows: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    """by, clusters, n, between, within, mean, se, lower, upper: one-way variance components by the mean squares (a negative one is 0), and
    the mean of clusters weighted by the inverse of what varies, with t quantiles of G - 1. Without variation every cluster weighs the same."""
    clusters = _clusters(rows, by, cluster, value)
    totals = clusters.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("c_").alias("n"), F.sum(F.col("c_") * F.col("c_")).alias("cc"), F.sum("within").alias("ssw"), (F.sum(F.col("c_") * F.col("m_")) / F.sum("c_")).alias("all")
    )
    g, n = F.col("clusters"), F.col("n")
    squares = _with_totals(clusters, by, totals).groupBy(*by, "clusters", "n", "cc", "ssw").agg(F.sum(F.col("c_") * F.pow(F.col("m_") - F.col("all"), F.lit(2))).alias("ssb"))
    within = F.coalesce(F.try_divide(F.col("ssw"), (n - g).cast("double")), F.lit(0.0))
    usual = F.try_divide(n - F.col("cc") / n, (g - 1).cast("double"))
    between = F.greatest(F.coalesce(F.try_divide(F.try_divide(F.col("ssb"), (g - 1).cast("double")) - F.col("within"), usual), F.lit(0.0)), F.lit(0.0))
    parts = squares.withColumn("within", within).select(*by, "clusters", "n", "within", between.alias("between"))
    spread = F.col("between") + F.col("within") / F.col("c_")
    w = F.when(spread > 0, 1 / spread).otherwise(1.0)
    out = _with_totals(clusters.drop("within"), by, parts).groupBy(*by, "clusters", "n", "between", "within").agg((F.sum(w * F.col("m_")) / F.sum(w)).alias("mean"), F.sum(w).alias("w"), F.max(spread).alias("most"))
    se = F.when(g > 1, F.when(F.col("most") > 0, F.sqrt(1 / F.col("w"))).otherwise(0.0))
    return _bounds(out.select(*by, "clusters", "n", "between", "within", "mean", se.alias("se")), g - 1)
