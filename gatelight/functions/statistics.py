"""Quantiles on the driver, and draws that depend on keys alone, not on partitions."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.6448536269514722


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by modified Lentz steps."""
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15 and k > 2:
            break
    return value - 1


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    return front * _beta_fraction(a, b, x) / a


@lru_cache(maxsize=4096)
def t_critical(df: int, p: float = 0.95) -> float:
    """The p-quantile (p over a half) of Student's t, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - beta_cdf(df / 2, 0.5, df / (df + mid * mid)) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


#: Degrees of freedom up to which quantiles of t come from a table.
T_TOP = 200

#: Coefficients of z, z^3, z^5, ... in the terms 1/df, 1/df^2, ... of the expansion of t quantiles around the normal quantile z.
T_TERMS = [
    (4, [1, 1]),
    (96, [3, 16, 5]),
    (384, [-15, 17, 19, 3]),
    (92160, [-945, -1920, 1482, 776, 79]),
]


def t_factors(z: float = Z95) -> list[float]:
    """What 1, 1/df, 1/df^2, ... are multiplied by in the expansion of the quantile."""
    return [z, *[sum(c * z ** (2 * k + 1) for k, c in enumerate(own)) / part for part, own in T_TERMS]]


def t_expansion(df: Column) -> Column:
    """The 95 % quantile of t by its expansion in 1/df, for many degrees of freedom."""
    out = F.lit(0.0)
    for factor in reversed(t_factors()):
        out = out / df + factor
    return out


def t_table(spark, top: int = T_TOP):
    return spark.createDataFrame([(n, t_critical(n)) for n in range(1, top + 1)], "df int, t double")


def digest(*keys: Column) -> Column:
    """The MD5 of the keys as text: what draws are made from, the same for any partitioning and in any engine."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary"))


def uniform(made: Column, at: int = 1) -> Column:
    """Evenly in (0, 1) by 13 hexadecimal digits of a digest."""
    return (F.conv(F.substring(made, at, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(made: Column) -> Column:
    """Standard normal by Box and Muller from two parts of a digest."""
    return F.sqrt(-2 * F.ln(uniform(made))) * F.cos(F.lit(2 * math.pi) * uniform(made, 14))


def mean_se_ar1(n: Column, rho: float, sd: float) -> Column:
    """Standard error of the mean of n steps of a stationary AR(1) series."""
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0), lambda acc, lag: acc + F.when(lag < n, (1 - lag / n) * F.pow(F.lit(rho), lag)).otherwise(0.0))
    return F.sqrt(F.lit(sd * sd) / n * (1 + 2 * terms))
