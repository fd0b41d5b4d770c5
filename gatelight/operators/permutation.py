"""Exact permutation tests within blocks: distributions of sums by convolution, met in the middle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.operators import ordered
from gatelight.sources import shared

#: Sums that differ by less count as equal.
STEP = 1e-6


def _key(by: list[str]) -> Column:
    return F.struct(*by)


def _choices(stats: Column) -> Column:
    """The different statistics of a block, each with the share of relabelings that give it."""
    share = lambda v: F.size(F.filter(stats, lambda x: x == v)) / F.size(stats)
    return F.transform(F.array_distinct(stats), lambda v: F.struct(v.alias("v"), share(v).alias("w")))


def _convolved(blocks: DataFrame, n: int, start: int) -> DataFrame:
    """g, s, p: how likely each sum of the statistics of n blocks is, from the block of number start on, over all their relabelings. Groups with fewer blocks add nothing for those they lack."""
    own = blocks.filter(F.col("nr") == 0).select("g", F.lit(0.0).alias("s"), F.lit(1.0).alias("p"))
    for k in range(start, start + n):
        more = blocks.filter(F.col("nr") == k).select("g", F.col("choices").alias("x"))
        nothing = F.array(F.struct(F.lit(0.0).alias("v"), F.lit(1.0).alias("w")))
        each = own.join(more, "g", "left").select("g", "s", "p", F.explode(F.coalesce("x", nothing)).alias("x"))
        own = each.groupBy("g", F.round((F.col("s") + F.col("x.v")) / STEP).alias("at")).agg((F.first(F.col("s") + F.col("x.v"))).alias("s"), F.sum(F.col("p") * F.col("x.w")).alias("p")).drop("at")
    return own


def p_values(blocks: DataFrame, by: list[str], order: list[str], stats: str, n_ranges: int | None = None) -> DataFrame:
    """by, blocks, relabelings (their number, as a double), observed (the sum as labeled) and p_value (the share of relabelings with a sum at least as far from 0).

    stats is an array with a block's statistic under each relabeling, the first being the one observed; null or empty arrays count as no block. All
    relabelings of a block are equally likely and blocks are independent, so sums are convolved block by block, equal ones merged. This is done for either
    half of the blocks; then the tails of one half are running totals at the places that the other half asks for: 3^10 and 3^10 sums in place of
    3^20 for twenty blocks of three different statistics.
    """
    known = blocks.filter(F.size(stats) > 0).select(_key(by).alias("g"), *order, F.col(stats).alias("x"))
    nr = F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1  # the blocks of one design
    rows = known.select("g", nr.alias("nr"), F.get("x", F.lit(0)).alias("real"), F.size("x").alias("ways"), _choices(F.col("x")).alias("choices"))
    rows, _ = shared.written(rows, "permutation-blocks")
    totals = rows.groupBy("g").agg(F.count(F.lit(1)).alias("blocks"), F.sum("real").alias("observed"), F.exp(F.sum(F.ln("ways"))).alias("relabelings"))
    n = (rows.agg(F.max("nr")).first()[0] or 0) + 1
    half = (n + 1) // 2
    first, second = _convolved(rows, half, 0), _convolved(rows, n - half, half)
    far = totals.select("g", (F.abs("observed") - STEP).alias("far"))
    asks = first.join(far, "g").select("g", "p", F.explode(F.array(F.struct((F.col("far") - F.col("s")).alias("v"), F.lit(True).alias("up")), F.struct((-F.col("far") - F.col("s")).alias("v"), F.lit(False).alias("up")))).alias("x"))
    # Upwards a question comes before the sums of its own place, which are no smaller; downwards behind them, which are no greater.
    asks = asks.select("g", F.col("x.v").alias("v"), F.when(F.col("x.up"), 0).otherwise(2).alias("side"), F.lit(None).cast("double").alias("w"), F.col("p").alias("asked"))
    data = second.select("g", F.col("s").alias("v"), F.lit(1).alias("side"), F.col("p").alias("w"), F.lit(None).cast("double").alias("asked"))
    passed = ordered.running(data.unionByName(asks), ["g"], ["v", "side"], {"upto": F.col("w")}, n_ranges=n_ranges)
    tail = F.when(F.col("side") == 0, 1 - F.col("upto")).otherwise(F.col("upto"))
    # With nothing observed but 0 both tails are everything, once.
    p = F.least(F.sum(F.col("asked") * tail), F.lit(1.0))
    found = passed.filter("side <> 1").groupBy("g").agg(p.alias("p_value"))
    return totals.join(found, "g").select("g.*", "blocks", F.round("relabelings").alias("relabelings"), "observed", "p_value")
