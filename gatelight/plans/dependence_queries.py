"""Queries on intervals for dependent blocks, each with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelight.functions.statistics import T_TOP, t_critical, t_factors
from gatelight.operators import dependence
from gatelight.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
REPLICATES, SEED = 399, 7


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, sql
        return function

    return add


T_SQL = "tq(df, t) AS (VALUES " + ", ".join(f"({n}, {t_critical(n)!r}::DOUBLE)" for n in range(1, T_TOP + 1)) + ")"


def t_sql(df: str) -> str:
    """The quantile for df, where tq is joined on it."""
    series = " + ".join(f"{factor!r} / pow({df}, {k})" for k, factor in enumerate(t_factors()))
    return f"CASE WHEN {df} > {T_TOP} THEN {series} ELSE t END"


def _rounded(found, *columns: str):
    return [c for c in found.columns if c not in columns] + [F.round(c, 6).alias(c) for c in columns]


@query(f"""WITH {T_SQL}, b AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, avg(value) AS v FROM events GROUP BY ALL),
s AS (SELECT event_type, count(*) AS n, avg(v) AS mean, least(CAST(floor(4 * pow(count(*) / 100.0, 2 / 9.0)) AS INT), count(*) - 1) AS lags FROM b GROUP BY 1),
d AS (SELECT event_type, n, mean, lags, v - mean AS d, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS k FROM b JOIN s USING (event_type)),
g AS (SELECT x.event_type, x.n, x.mean, x.lags, sum(x.d * y.d * CASE WHEN x.k = y.k THEN 1 ELSE 2 * (1 - (x.k - y.k) / (x.lags + 1.0)) END) AS total FROM d x JOIN d y ON x.event_type = y.event_type AND x.k - y.k BETWEEN 0 AND x.lags GROUP BY ALL),
e AS (SELECT event_type, n, mean, lags, sqrt(greatest(total, 0) / (n - 1) / n) AS se, {t_sql("(n - 1)")} AS q FROM g LEFT JOIN tq ON df = n - 1 WHERE n > 1)
SELECT event_type, n, CAST(lags AS INT) AS lags, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - q * se, 6) AS lower, round(mean + q * se, 6) AS upper FROM e""")
def q_hac_interval(spark, sf_dir):
    """The mean of hourly blocks of each event type, with an error that allows for dependence between neighbouring hours."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    hourly = table(spark, sf_dir, "events").groupBy("event_type", hour.alias("hour")).agg(F.avg("value").alias("v"))
    found = dependence.hac_interval(hourly, ["event_type"], ["hour"], "v").filter("n > 1")
    return found.select(*_rounded(found, "mean", "se", "lower", "upper"))


_LETTERS = "(('0x' || substr(md5(concat_ws('|', {seed}, r, b)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


def _poisson_sql(u: str, top: int = 12) -> str:
    steps, term, below = [], 2.718281828459045**-1, 0.0
    for k in range(top):
        below += term
        steps.append(f"CAST({u} > {below!r} AS INT)")
        term /= k + 1
    return " + ".join(steps)


@query(f"""WITH b AS (SELECT event_type, epoch_us(ts) // 86400000000 AS b, sum(value) AS s, count(value) AS c FROM events GROUP BY ALL),
u AS (SELECT *, {_LETTERS.format(seed=SEED)} AS u FROM b, (SELECT unnest(range(1, {REPLICATES + 1})) AS r)),
m AS (SELECT event_type, r, sum(({_poisson_sql("u")}) * s) / nullif(sum(({_poisson_sql("u")}) * c), 0) AS m FROM u GROUP BY ALL),
q AS (SELECT event_type, stddev_samp(m) AS se, quantile_cont(m, 0.05) AS lower, quantile_cont(m, 0.95) AS upper FROM m GROUP BY 1)
SELECT event_type, count(*) AS blocks, sum(c)::BIGINT AS n, round(sum(s) / sum(c), 6) AS mean, round(any_value(se), 6) AS se, round(any_value(lower), 6) AS lower, round(any_value(upper), 6) AS upper FROM b JOIN q USING (event_type) GROUP BY 1""")
def q_block_bootstrap(spark, sf_dir):
    """The mean of the values of each event type, bounded by resampling whole days."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    found = dependence.block_bootstrap(table(spark, sf_dir, "events"), ["event_type"], day, "value", REPLICATES, SEED)
    return found.select(*_rounded(found, "mean", "se", "lower", "upper"))


CLUSTER_SQL = f"""{T_SQL}, k AS (SELECT l_returnflag, l_suppkey, count(*) AS c, avg(100 * (l_discount - l_tax)) AS m, var_pop(100 * (l_discount - l_tax)) * count(*) AS w FROM lineitem GROUP BY ALL),
a AS (SELECT l_returnflag, count(*) AS g, sum(c) AS n, sum(c * m) / sum(c) AS mean, sum(c * c) AS cc, sum(w) AS ssw FROM k GROUP BY 1)"""


def _line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", (100 * (F.col("l_discount") - F.col("l_tax"))).alias("value"))


@query(f"""WITH {CLUSTER_SQL}, e AS (SELECT l_returnflag, g, n, mean, sqrt(g / (g - 1) * sum(pow(c * (m - mean), 2))) / n AS se FROM k JOIN a USING (l_returnflag) GROUP BY l_returnflag, g, n, mean)
SELECT l_returnflag, g AS clusters, n::BIGINT AS n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - q * se, 6) AS lower, round(mean + q * se, 6) AS upper
FROM (SELECT e.*, {t_sql("(g - 1)")} AS q FROM e LEFT JOIN tq ON df = g - 1)""")
def q_cluster_robust(spark, sf_dir):
    """The mean excess of discount over tax for each return flag; lines of one supplier may depend on each other."""
    found = dependence.cluster_robust(_line(spark, sf_dir), ["l_returnflag"], "l_suppkey", "value")
    return found.select(*_rounded(found, "mean", "se", "lower", "upper"))


@query(f"""WITH {CLUSTER_SQL}, b AS (SELECT l_returnflag, g, n, ssw / (n - g) AS within, greatest((sum(c * pow(m - mean, 2)) / (g - 1) - ssw / (n - g)) / ((n - cc / n) / (g - 1)), 0) AS between FROM k JOIN a USING (l_returnflag) GROUP BY l_returnflag, g, n, cc, ssw),
e AS (SELECT l_returnflag, g, n, within, between, sum(m / (between + within / c)) / sum(1 / (between + within / c)) AS mean, sqrt(1 / sum(1 / (between + within / c))) AS se FROM k JOIN b USING (l_returnflag) GROUP BY l_returnflag, g, n, within, between)
SELECT l_returnflag, g AS clusters, n::BIGINT AS n, round(between, 6) AS between, round(within, 6) AS within, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - q * se, 6) AS lower, round(mean + q * se, 6) AS upper
FROM (SELECT e.*, {t_sql("(g - 1)")} AS q FROM e LEFT JOIN tq ON df = g - 1)""".replace("between", '"between"').replace("within", '"within"'))
def q_hierarchical(spark, sf_dir):
    """The same mean with variance components of suppliers and lines."""
    found = dependence.hierarchical(_line(spark, sf_dir), ["l_returnflag"], "l_suppkey", "value")
    return found.select(*_rounded(found, "between", "within", "mean", "se", "lower", "upper"))
