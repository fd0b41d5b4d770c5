"""One-sided intervals, the direction guard and the three-way decision, as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.functions.statistics import T_TOP, t_expansion, t_table

TOLERANCE = 1e-12


def required_favorable(n: Column, fraction: float) -> Column:
    """Blocks that must point the right way; an error for no blocks or a fraction outside (0, 1]."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be in (0, 1]")
    return F.when(n > 0, F.ceil(F.lit(fraction) * n)).otherwise(F.raise_error(F.lit("no blocks")).cast("long"))


def decide(lower: Column, upper: Column, favorable: Column, n: Column, sesoi: float, fraction: float, tolerance: float = TOLERANCE) -> Column:
    """supported, contradicted or inconclusive. Equality with the threshold is inconclusive; the guard alone contradicts nothing."""
    held = (lower > sesoi + tolerance) & (favorable >= required_favorable(n, fraction))
    return F.when(held, "supported").when(upper < sesoi - tolerance, "contradicted").otherwise("inconclusive")


def block_summary(blocks: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mean, sd, se and favorable (values over 0) of each group of blocks."""
    v = F.col(value)
    out = blocks.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count_if(v > 0).alias("favorable"))
    return out.withColumn("se", F.col("sd") / F.sqrt("n"))


def with_t(summary: DataFrame, df: Column, top: int = T_TOP) -> DataFrame:
    """summary with t, the 95 % quantile of Student's t for any degrees of freedom; null under 1.

    Up to top they come from a table of that many rows, beyond it from the expansion around the normal quantile, which differs by under 1e-11 from there on.
    """
    table = F.broadcast(t_table(summary.sparkSession, top).withColumnRenamed("df", "t_df_"))
    t = F.when(df > top, t_expansion(df)).otherwise(F.col("t"))
    return summary.join(table, df == F.col("t_df_"), "left").withColumn("t", t).drop("t_df_")


def t_interval(summary: DataFrame, top: int = T_TOP) -> DataFrame:
    """lower and upper one-sided 95 % bounds for any number of blocks. Groups with one block have null bounds."""
    joined = with_t(summary, F.col("n") - 1, top)
    return joined.withColumn("lower", F.col("mean") - F.col("t") * F.col("se")).withColumn("upper", F.col("mean") + F.col("t") * F.col("se")).drop("t")
