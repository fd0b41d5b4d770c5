"""Operating characteristics of the decision rules by simulation.

One row is one iteration of one scenario: its draws are an array made from digests of (seed, scenario, iteration,
block), and one fold over the array keeps level, sum, squares and favorable blocks. So nothing is shuffled but one partial
average per scenario and task, draws don't depend on partitions, and iterations scale with the cluster.
Draws follow the stated distributions; they aren't the stream of any other generator.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from gatelight.functions.statistics import Z95, digest, normal, t_critical, uniform

ITERATIONS, SEED, RHO, SD, SESOI, FRACTION, TOLERANCE = 100_000, 20260720, 0.65, 5.0, 2.0, 0.80, 1e-12


def grid(spark, **axes: list) -> DataFrame:
    """Every combination of the values given; small by what the caller writes down."""
    kind = lambda values: StringType() if isinstance(values[0], str) else DoubleType() if isinstance(values[0], float) else LongType()
    frames = [spark.createDataFrame([(v,) for v in values], f"{name} {kind(values).simpleString()}") for name, values in axes.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def iterations(cells: DataFrame, n: int) -> DataFrame:
    """The cells with iter from 0 to n - 1, spread over the cluster."""
    spark = cells.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, n // 50_000)
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "iter").crossJoin(F.broadcast(cells))


def folded(rows: DataFrame, n: Column, value, seed: int, keys: list[str], noise=lambda e, i: e) -> DataFrame:
    """mean, se and favorable of n blocks a row. noise(e, block) is what stands for standard normal draws e;
    value(noise, block, n, previous value less the effect) is the next value less the effect. The fold uses
    value several times, so what is dear belongs into noise. effect is a column of rows."""
    made = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: digest(F.lit(seed), *[F.col(k) for k in keys], F.col("iter"), i))
    drawn = F.transform(made, lambda m, i: F.struct(noise(normal(m), i).alias("e"), i.alias("i")))
    numbered = rows.withColumn("noise", drawn)
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("f"))

    def step(acc, now):
        x = value(now["e"], now["i"], n, acc["x"])
        full = x + F.col("effect")
        return F.struct(x.alias("x"), (acc["s"] + full).alias("s"), (acc["q"] + full * full).alias("q"), (acc["f"] + (full > 0).cast("long")).alias("f"))

    out = numbered.withColumn("sum", F.aggregate("noise", start, step)).drop("noise")
    spread = F.greatest(F.lit(0.0), F.col("sum.q") - F.col("sum.s") * F.col("sum.s") / n) / (n - 1)
    return out.select(*rows.columns, (F.col("sum.s") / n).alias("mean"), F.sqrt(spread / n).alias("se"), F.col("sum.f").alias("favorable"))


def ar1(rho: float = RHO, sd: float = SD):
    innovation = sd * (1 - rho * rho) ** 0.5
    return lambda e, i, n, x: F.when(i == 0, e * sd).otherwise(x * rho + e * innovation)


def _rate(cond: Column) -> Column:
    return F.avg(cond.cast("int"))


def _t(n: Column, sizes) -> Column:
    return reduce(lambda c, k: c.when(n == k, t_critical(k - 1)), sizes[1:], F.when(n == sizes[0], t_critical(sizes[0] - 1)))


def composite_null(spark, n_iter: int = ITERATIONS, n_blocks: int = 10, seed: int = SEED) -> DataFrame:
    """Rates of the point, interval and full rules over true effects, for independent normal draws and three others."""
    cells = grid(spark, scenario=["iid_normal"], effect=[0.0, 0.5, 1.0, 1.5, 2.0, 2.1, 2.5, 5.0]).unionByName(
        grid(spark, scenario=["iid_t3", "heteroscedastic", "stationary_ar1"], effect=[0.0, 2.0, 5.0])
    )
    kind, step = F.col("scenario"), ar1()

    def noise(e, i):
        square = reduce(lambda a, b: a + b, [F.pow(normal(digest(F.lit(seed + k), F.col("scenario"), F.col("effect"), F.col("iter"), i)), 2) for k in (1, 2, 3)])
        scale = F.when(i % 2 == 0, 0.55).otherwise(1.30)
        return F.when(kind == "iid_t3", e / F.sqrt(square)).when(kind == "heteroscedastic", e * scale).otherwise(e)

    n = F.lit(n_blocks)
    value = lambda e, i, n, x: F.when(kind == "stationary_ar1", step(e, i, n, x)).otherwise(e * SD)
    rows = folded(iterations(cells, n_iter), n, value, seed, ["scenario", "effect"], noise)
    t = t_critical(n_blocks - 1)
    lower, upper = F.col("mean") - t * F.col("se"), F.col("mean") + t * F.col("se")
    guard, b1 = F.col("favorable") / n >= FRACTION, lower > SESOI
    out = rows.groupBy("scenario", "effect").agg(
        _rate(F.col("mean") > SESOI).alias("b0_rate"), _rate(b1).alias("b1_rate"), _rate(b1 & guard).alias("b2_rate"), _rate(upper < SESOI).alias("contradicted_rate"),
        _rate(guard).alias("guard_rate"), _rate(b1 & ~guard).alias("support_guard_fail_rate"), F.count(F.lit(1)).alias("iterations"),
    )
    material = F.col("effect") > SESOI
    return out.withColumn("false_support", F.when(~material, F.col("b2_rate")).otherwise(0.0)).withColumn("power", F.when(material, F.col("b2_rate")).otherwise(0.0))


def direction_guard(spark, n_iter: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """How often the interval and the guard agree, over designs, numbers of blocks and effects."""
    from gatelight.functions.statistics import mean_se_ar1

    sizes = [10, 20, 35, 50, 150]
    n, step = F.col("n_blocks"), ar1()
    known = F.col("design") == "ar1_oracle_interval"
    cells = grid(spark, design=["iid_normal", "ar1_oracle_interval"], n_blocks=sizes, effect=[0.0, 2.0, 5.0])
    cells = cells.withColumn("known_se", mean_se_ar1(n, RHO, SD)).withColumn("critical", F.when(known, Z95).otherwise(_t(n, sizes)))
    rows = folded(iterations(cells, n_iter), n, lambda e, i, k, x: F.when(known, step(e, i, k, x)).otherwise(e * SD), seed, ["design", "n_blocks", "effect"])
    support = F.col("mean") - F.col("critical") * F.when(known, F.col("known_se")).otherwise(F.col("se")) > SESOI
    guard = F.col("favorable") / n >= FRACTION
    return rows.groupBy("design", "n_blocks", "effect").agg(
        _rate(support).alias("ci_support_rate"), _rate(guard).alias("guard_rate"), _rate(support & guard).alias("joint_rate"), _rate(support & ~guard).alias("support_guard_fail_rate"), F.count(F.lit(1)).alias("iterations")
    )


def ar1_scenario(effect: Column) -> Column:
    return F.when(effect == 0, "ar1_model_based_null").when(effect == SESOI, "ar1_model_based_exact_sesoi").otherwise("ar1_model_based_5_percent")


def ar1_control(spark, n_iter: int = ITERATIONS, n_blocks: int = 150, seed: int = SEED) -> DataFrame:
    """Coverage and decisions of the interval that knows the series' own standard error."""
    from gatelight.functions.statistics import mean_se_ar1

    n = F.lit(n_blocks)
    cells = grid(spark, effect=[0.0, 2.0, 5.0]).withColumn("known_se", mean_se_ar1(n, RHO, SD))
    rows = folded(iterations(cells, n_iter), n, ar1(), seed, ["effect"])
    lower, upper = F.col("mean") - Z95 * F.col("known_se"), F.col("mean") + Z95 * F.col("known_se")
    supported, contradicted = (lower > SESOI) & (F.col("favorable") / n >= FRACTION), upper < SESOI
    out = rows.groupBy("effect").agg(
        F.first("known_se").alias("exact_se"), _rate(lower <= F.col("effect")).alias("lower_coverage"), _rate(upper >= F.col("effect")).alias("upper_coverage"), F.avg(upper - lower).alias("mean_width"),
        _rate(supported).alias("supported_rate"), _rate(contradicted).alias("contradicted_rate"), _rate(~supported & ~contradicted).alias("inconclusive_rate"), F.count(F.lit(1)).alias("iterations"),
    )
    material = F.col("effect") > SESOI
    rates = {"false_support_rate": (~material, "supported_rate"), "false_contradiction_rate": (material, "contradicted_rate"), "power_supported_rate": (material, "supported_rate")}
    return out.withColumns({"scenario": ar1_scenario(F.col("effect"))} | {name: F.when(cond, F.col(rate)).otherwise(0.0) for name, (cond, rate) in rates.items()})


def stress(spark, n_iter: int = ITERATIONS, n_blocks: int = 20, seed: int = SEED + 1) -> DataFrame:
    """Five scenarios of paired effects; where the independent interval doesn't fit, everything is inconclusive."""
    from pyspark.sql import Row

    names = ["iid_percent_reduction", "paired_log_ratio", "heteroscedastic", "ordered_drift", "change_point"]
    cells = spark.createDataFrame([Row(scenario=s, effect=0.0, compatible=k < 2) for k, s in enumerate(names)])
    kind, n, t = F.col("scenario"), F.lit(n_blocks), t_critical(n_blocks - 1)

    def noise(e, i):
        line = i / (n_blocks - 1)
        base = F.exp(F.log(F.lit(100.0)) + 0.45 * normal(digest(F.lit(seed + 9), F.col("scenario"), F.col("iter"), i)))
        return (
            F.when(kind == names[0], 5 + 5 * e)
            .when(kind == names[1], -F.log(F.lit(0.95)) - (0.08 + 0.00015 * base) * e)
            .when(kind == names[2], 5 + (2 + 7 * line) * e)
            .when(kind == names[3], 5 - 3 + 6 * line + 5 * e)
            .otherwise(F.when(i < n_blocks // 2, 8).otherwise(2) + 5 * e)
        )

    rows = folded(iterations(cells, n_iter), n, lambda e, i, k, x: e, seed, ["scenario"], noise)
    limit = F.when(kind == names[1], -F.log1p(F.lit(-SESOI / 100))).otherwise(SESOI)
    needed = -(-8 * n_blocks // 10)
    supported = (F.col("mean") - t * F.col("se") > limit + TOLERANCE) & (F.col("favorable") >= needed)
    contradicted = ~supported & (F.col("mean") + t * F.col("se") < limit - TOLERANCE)
    out = rows.groupBy("scenario", "compatible").agg(_rate(supported).alias("s"), _rate(contradicted).alias("c"), F.count(F.lit(1)).alias("draws"))
    fits = F.col("compatible")
    rates = {"supported": F.when(fits, F.col("s")).otherwise(0.0), "contradicted": F.when(fits, F.col("c")).otherwise(0.0), "inconclusive": F.when(fits, 1 - F.col("s") - F.col("c")).otherwise(1.0)}
    columns = [x for name, p in rates.items() for x in (p.alias(f"{name}_probability"), F.sqrt(F.greatest(F.lit(0.0), p * (1 - p)) / F.col("draws")).alias(f"{name}_mc_se"))]
    ratio = kind == names[1]
    told = [F.lit(5.0).alias("true_effect"), F.when(ratio, "log_ratio").otherwise("percent_reduction").alias("effect_scale")]
    return out.select("scenario", "compatible", "draws", *told, *columns)


def attestation_error(spark, n_iter: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """What wrong statements upstream cost: promotions, rejections, and what the local checks withhold anyway."""
    rows = iterations(grid(spark, error_rate=[0.01, 0.05, 0.10]), n_iter)
    drawn = rows.groupBy("error_rate").agg(
        *[_rate(uniform(digest(F.lit(seed + k), F.col("error_rate"), F.col("iter"))) < F.col("error_rate")).alias(name) for name, k in (("promoted", 0), ("rejected", 100))], F.count(F.lit(1)).alias("iterations")
    )
    cases = (("invalid_critical_gate_upstream_false_pass", True, F.col("promoted"), F.lit(0.0)), ("valid_critical_gate_upstream_false_nonpass", True, F.lit(0.0), F.col("rejected")), ("manifest_detectable_attack", False, F.lit(0.0), F.lit(1.0)))
    made = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(ok).alias("local_checks_pass"), p.alias("false_promotion_rate"), r.alias("abstention_rate")) for s, ok, p, r in cases])
    return drawn.select("error_rate", "iterations", F.explode(made).alias("x")).select("x.*", "error_rate", "iterations")
