"""Mergeable sketches: quantiles (KLL) and distinct values (HyperLogLog) of parts, kept as bytes and merged for any set of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a KLL sketch; see rank_error for what it means.
K = 400
#: Logarithm of a HyperLogLog sketch's number of counters: the standard error is about 0.83 / sqrt(2^LG).
LG = 14


def rank_error(k: int = K) -> float:
    """Of a rank, as a share of all values, at 99 % confidence: the published fit for this kind of sketch, for two-sided bounds."""
    return 2.446 / k**0.9433


def distinct_error(lg: int = LG, deviations: float = 4.0) -> float:
    """Of a number of distinct values, as a share of it."""
    return deviations * 0.8326 / 2 ** (lg / 2)


def by_part(rows: DataFrame, parts: list[str], value: str, item: str, k: int = K, lg: int = LG) -> DataFrame:
    """parts, n (values that are not null), values and items: the sketches of each part, a few KB however many rows it has. Nulls don't count."""
    v = F.col(value).cast("double")
    return rows.groupBy(*parts).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, k).alias("values"), F.hll_sketch_agg(item, lg).alias("items"))


def merged(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """The sketches of the union of parts, by coarser keys: by, n, values, items. No row is read again."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("values", k).alias("values"), F.hll_union_agg("items").alias("items"))


def quantile(values: Column, share: float) -> Column:
    """A value whose rank is about share; null of a sketch of nothing."""
    return F.when(F.kll_sketch_get_n_double(values) > 0, F.kll_sketch_get_quantile_double(values, F.lit(share)))


def distinct(items: Column) -> Column:
    return F.hll_sketch_estimate(items)
