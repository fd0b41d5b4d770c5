import pytest
from pyspark.sql import functions as F

from gatelight.functions import statistics as S
from gatelight.operators import decisions as D

CASES = [
    (2.0, 4.0, 10, 10, "inconclusive"), (-1.0, 2.0, 0, 10, "inconclusive"), (2.001, 4.0, 8, 10, "supported"), (2.001, 4.0, 7, 10, "inconclusive"),
    (-1.0, 1.999, 10, 10, "contradicted"), (2.1, 4.0, 8, 11, "inconclusive"), (2.1, 4.0, 9, 11, "supported"),
]


def test_three_way_decision(spark):
    rows = spark.createDataFrame(CASES, "lo double, hi double, f long, n long, expected string")
    found = rows.select(D.decide(F.col("lo"), F.col("hi"), F.col("f"), F.col("n"), 2.0, 0.8).alias("state"), "expected").collect()
    assert all(r.state == r.expected for r in found)


def test_no_blocks_and_bad_fractions_are_errors(spark):
    with pytest.raises(Exception, match="no blocks"):
        spark.range(1).select(D.required_favorable(F.lit(0), 0.8)).collect()
    for fraction in (0, -1, 1.5):
        with pytest.raises(ValueError):
            D.required_favorable(F.lit(5), fraction)


@pytest.mark.parametrize(("df", "t"), [(9, 1.8331129327), (19, 1.7291328115), (34, 1.6909242552), (49, 1.6765508926), (149, 1.6551445338), (1, 6.313751514675)])
def test_t_quantiles(df, t):
    assert abs(S.t_critical(df) - t) < 1e-8


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(0, 20_000, 1, 2).select(S.normal(S.digest(F.lit(3), F.col("id"))).alias("x"))
    again = spark.range(0, 20_000, 1, 7).select(S.normal(S.digest(F.lit(3), F.col("id"))).alias("x"))
    one, two = (df.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.sum(F.xxhash64("x").cast("decimal(38,0)")).alias("h")).first() for df in (rows, again))
    assert one.h == two.h and abs(one.m) < 0.03 and abs(one.s - 1) < 0.03


def test_ar1_standard_error(spark):
    assert abs(spark.range(1).select(S.mean_se_ar1(F.lit(150), 0.65, 5.0)).first()[0] - 0.87973) < 1e-4
    assert spark.range(1).select(S.mean_se_ar1(F.lit(1), 0.65, 5.0)).first()[0] == 5.0


def test_interval_of_known_blocks(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", -1.0), ("b", 2.0)], "g string, value double")
    found = {r.g: r for r in D.t_interval(D.block_summary(rows, ["g"])).collect()}
    assert (found["a"].n, found["a"].mean, found["a"].sd, found["a"].favorable) == (3, 1.0, 2.0, 2)
    assert abs(found["a"].lower - (1 - 2.919985580 * 2 / 3**0.5)) < 1e-6 and found["b"].lower is None
