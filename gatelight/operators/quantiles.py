"""Exact quantiles of groups of any size and any distribution, without a list of a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelight.sources import shared

#: Values at most among which a rank is looked up one by one, and parts that a round cuts a group's values into.
LIMIT, PARTS = 100_000, 64


def _meet(known: DataFrame, brackets: DataFrame) -> DataFrame:
    """Each value with the brackets of its group, which are as many as there are ranks asked for."""
    return known.join(brackets.withColumnRenamed("g", "g_of"), F.col("g").eqNullSafe(F.col("g_of"))).drop("g_of")


def _counted(known: DataFrame, brackets: DataFrame) -> DataFrame:
    """brackets (g, rank, low, high) with below and inside, the numbers of values under low and from low to high."""
    v = F.col("v")
    return _meet(known, brackets).groupBy("g", "rank", "low", "high").agg(F.count_if(v < F.col("low")).alias("below"), F.count_if(v.between(F.col("low"), F.col("high"))).alias("inside"))


def _narrowed(known: DataFrame, wide: DataFrame) -> DataFrame:
    """Closer brackets of the same ranks: approximate quantiles of the values inside, whose error is a hundredth of a part, and a whole part more on both sides."""
    inside = _meet(known, wide).filter(F.col("v").between(F.col("low"), F.col("high")))
    shares = F.array(*[F.lit(k / PARTS) for k in range(PARTS + 1)])
    cuts = inside.groupBy("g", "rank", "below", "inside").agg(F.percentile_approx("v", shares, 100 * PARTS).alias("cuts"))
    part = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * PARTS).cast("int")
    at = lambda k: F.get("cuts", F.greatest(F.least(k, F.lit(PARTS)), F.lit(0)))
    return _counted(known, cuts.select("g", "rank", at(part - 1).alias("low"), at(part + 2).alias("high")))


def by_group(rows: DataFrame, group: str, value: str, wanted: dict[str, float], digits: int = 6, limit: int = LIMIT) -> DataFrame:
    """group and the quantiles asked for (name to share), linear between the two nearest values; nulls and not-a-number don't count.

    Each rank has a bracket, at first its whole group. While one holds more than limit values that aren't all alike, it is narrowed to the neighbourhood of the rank,
    by approximate quantiles of what is inside and exact counts. This makes it smaller by PARTS / 3 or leaves few different values, whatever the distribution is. At the end the
    values inside are counted one by one. Counts are combined before they are shuffled.
    """
    v = F.col(value).cast("double")
    known = rows.select(F.col(group).alias("g"), v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    ends = known.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("inside"))
    shares = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("inside") - 1)).alias("at")) for name, q in wanted.items()])
    asked, _ = shared.written(ends.withColumn("x", F.explode(shares)).select("g", "low", "high", "inside", "x.*"), "quantile-ranks")
    ranks = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    brackets = ranks.select("g", "rank", "low", "high", F.lit(0).cast("long").alias("below"), "inside").distinct()
    open_ = (F.col("inside") > limit) & (F.col("low") < F.col("high"))
    size = brackets.filter(open_).agg(F.sum("inside")).first()[0]
    while size:
        closer = _narrowed(known, brackets.filter(open_)).select(*brackets.columns)
        brackets, _ = shared.written(brackets.filter(~open_).unionByName(closer), "quantile-brackets")
        before, size = size, brackets.filter(open_).agg(F.sum("inside")).first()[0]
        if size == before:  # what is left are few different values, each many times
            break
    counts = _meet(known, brackets).filter(F.col("v").between(F.col("low"), F.col("high"))).groupBy("g", "rank", "below", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "rank").orderBy("v")) + F.col("below")
    values = counts.withColumn("upto", upto).filter(F.col("upto") > F.col("rank")).groupBy("g", "rank").agg(F.min("v").alias("v"))
    own = ranks.select("g", "name", "at", "rank").join(values.withColumnsRenamed({"g": "g_of", "rank": "rank_of"}), F.col("g").eqNullSafe(F.col("g_of")) & (F.col("rank") == F.col("rank_of")))
    ends_of = own.groupBy("g", "name").agg(F.first("at").alias("at"), F.min(F.struct("rank", "v"))["v"].alias("below"), F.max(F.struct("rank", "v"))["v"].alias("above"))
    exact = F.when(F.col("below") == F.col("above"), F.col("below")).otherwise(F.col("below") + (F.col("above") - F.col("below")) * (F.col("at") - F.floor("at")))
    return ends_of.groupBy(F.col("g").alias(group)).pivot("name", list(wanted)).agg(F.first(F.round(exact, digits)))
