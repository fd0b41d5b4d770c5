"""Queries behind reports: plot data, first matches, dependence policy, permutation tests, energy ratios and time stamps."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatelight.functions import registry_values as R
from gatelight.functions import variants as V
from gatelight.operators import permutation, quantiles, simulate
from gatelight.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
#: What reads no given table. Not registered.
STUDIES, STUDY_SQL = {}, {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, sql
        return function

    return add


def study(sql: str):
    def add(function):
        STUDIES[function.__name__], STUDY_SQL[function.__name__] = function, sql
        return function

    return add


RATES_SQL = """rates AS (
    SELECT CASE l_returnflag WHEN 'N' THEN 'iid_normal' ELSE 'other' END AS scenario, CAST(round(l_tax * 100) AS DOUBLE) AS effect,
        avg(CAST(l_discount > 0.05 AS INT)) AS b0, avg(CAST(l_discount > 0.05 AND l_quantity > 10 AS INT)) AS b2 FROM lineitem GROUP BY 1, 2)"""


def _rates(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_tax", "l_discount", "l_quantity")
    scenario = F.when(F.col("l_returnflag") == "N", "iid_normal").otherwise("other")
    over = F.col("l_discount") > 0.05
    rate = lambda cond: F.avg(cond.cast("int"))
    return line.groupBy(scenario.alias("scenario"), F.round(F.col("l_tax") * 100).alias("effect")).agg(rate(over).alias("b0"), rate(over & (F.col("l_quantity") > 10)).alias("b2"))


@query(f"""WITH {RATES_SQL} SELECT effect, round(100 * b0, 4) AS b0_percent, round(100 * b2, 4) AS full_percent, CAST(b0 > 0.5 AS INT) AS b0_mostly,
    CASE WHEN effect = 0 THEN 'no effect' WHEN effect <= 2 THEN 'up to the least effect' ELSE 'material' END AS label FROM rates WHERE scenario = 'iid_normal' AND effect IN (0, 1, 2, 5)""")
def q_plot_effects(spark, sf_dir):
    """Bars of a figure: one scenario, four effects, in percent, with a 0/1 mark and a label."""
    rows = _rates(spark, sf_dir).filter((F.col("scenario") == "iid_normal") & F.col("effect").isin(0.0, 1.0, 2.0, 5.0))
    label = F.when(F.col("effect") == 0, "no effect").when(F.col("effect") <= 2, "up to the least effect").otherwise("material")
    return rows.select("effect", F.round(100 * F.col("b0"), 4).alias("b0_percent"), F.round(100 * F.col("b2"), 4).alias("full_percent"), (F.col("b0") > 0.5).cast("int").alias("b0_mostly"), label.alias("label"))


@query("""WITH c AS (SELECT o_orderpriority AS design, CAST(year(o_orderdate) AS VARCHAR) AS n_blocks, CAST(CAST(quarter(o_orderdate) AS DOUBLE) AS VARCHAR) AS effect, avg(CAST(o_orderstatus = 'F' AS INT)) AS rate FROM orders GROUP BY 1, 2, 3)
SELECT design, n_blocks, round(rate, 6) AS rate, row_number() OVER (PARTITION BY design ORDER BY CAST(n_blocks AS INT)) AS place FROM c WHERE effect = '2.0'""")
def q_plot_curves(spark, sf_dir):
    """Lines of a figure: rows of one effect, compared as text, in the order of the number that another text column holds."""
    date = F.col("o_orderdate")
    keys = [F.col("o_orderpriority").alias("design"), F.year(date).cast("string").alias("n_blocks"), F.quarter(date).cast("double").cast("string").alias("effect")]
    rows = table(spark, sf_dir, "orders").groupBy(*keys).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate")).filter("effect = '2.0'")
    place = F.row_number().over(Window.partitionBy("design").orderBy(F.col("n_blocks").cast("int")))
    return rows.select("design", "n_blocks", F.round("rate", 6).alias("rate"), place.alias("place"))


@query("""SELECT o_orderpriority, o_orderstatus = 'F' AS compatible, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY ALL""")
def q_split_by_flag(spark, sf_dir):
    """Both sides of a flag, each summed by itself in one pass."""
    orders = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_orderstatus") == "F").alias("compatible"))
    return orders.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def q_first_match(spark, sf_dir):
    """The first row of each customer that matches two conditions, as a reduction: no sort, no window."""
    first = F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x")
    rows = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).groupBy("o_custkey").agg(first)
    return rows.select("o_custkey", F.col("x.o_orderkey").alias("first_order"), F.col("x.o_totalprice").alias("price"))


#: The interval families that are acceptable under each design condition.
POLICY = {
    "randomized_crossover_with_reset": ["paired_randomization", "paired_interval"],
    "ordered_blocks_or_drift": ["hac", "model_based", "block_bootstrap"],
    "shared_units": ["cluster_robust", "hierarchical"],
    "insufficient_evidence": [],
}
_CONDITIONS = [*POLICY, "unknown"]
_METHODS = [m for own in POLICY.values() for m in own]
_POLICY_SQL = "policy(design_condition, method) AS (VALUES " + ", ".join(f"('{c}', '{m}')" for c, own in POLICY.items() for m in own) + ")"
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(f"""WITH {_POLICY_SQL}, d AS (SELECT o_orderkey, {_LIST(_CONDITIONS)}[o_orderkey % {len(_CONDITIONS)} + 1] AS design_condition, {_LIST(_METHODS)}[o_custkey % {len(_METHODS)} + 1] AS method,
    CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'contradicted' ELSE 'inconclusive' END AS numeric_state FROM orders)
SELECT o_orderkey, design_condition, d.method, p.method IS NOT NULL AS interval_compatible, CASE WHEN p.method IS NULL THEN 'inconclusive' ELSE numeric_state END AS state FROM d LEFT JOIN policy p USING (design_condition, method)""")
def q_dependence_policy(spark, sf_dir):
    """Whether the registered interval fits the declared design; if not, the decision is inconclusive whatever the numbers say."""
    pick = lambda names, key: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(key) % len(names) + 1).cast("int"))
    numeric = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "contradicted").otherwise("inconclusive")
    declared = table(spark, sf_dir, "orders").select("o_orderkey", pick(_CONDITIONS, "o_orderkey").alias("design_condition"), pick(_METHODS, "o_custkey").alias("method"), numeric.alias("numeric_state"))
    policy = spark.createDataFrame([(c, m, True) for c, own in POLICY.items() for m in own], "design_condition string, method string, fits boolean")
    out = declared.join(F.broadcast(policy), ["design_condition", "method"], "left").withColumn("interval_compatible", F.coalesce("fits", F.lit(False)))
    return out.select("o_orderkey", "design_condition", "method", "interval_compatible", F.when(F.col("interval_compatible"), F.col("numeric_state")).otherwise("inconclusive").alias("state"))


ORDERS = list(permutations(range(3)))
_PERM_SQL = "perm(p, a, b, c) AS (VALUES " + ", ".join(f"({k}, {', '.join(str(x + 1) for x in o)})" for k, o in enumerate(ORDERS)) + ")"


@query(f"""WITH {_PERM_SQL}, y AS (SELECT o_orderpriority, o_orderkey % 5 AS block, avg(CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END) AS f, avg(CASE WHEN o_custkey % 3 = 1 THEN o_totalprice END) AS o, avg(CASE WHEN o_custkey % 3 = 2 THEN o_totalprice END) AS q FROM orders GROUP BY ALL),
one AS (SELECT o_orderpriority, block, p, [f, o, q][a] - ([f, o, q][b] + [f, o, q][c]) / 2 AS stat FROM y, perm),
made AS (SELECT o_orderpriority, t.p0, t.p1, t.p2, t.p3, t.p4, s0.stat + s1.stat + s2.stat + s3.stat + s4.stat AS stat
    FROM (SELECT a.p AS p0, b.p AS p1, c.p AS p2, d.p AS p3, e.p AS p4 FROM perm a, perm b, perm c, perm d, perm e) t
    JOIN one s0 ON s0.block = 0 AND s0.p = t.p0 JOIN one s1 USING (o_orderpriority) JOIN one s2 USING (o_orderpriority) JOIN one s3 USING (o_orderpriority) JOIN one s4 USING (o_orderpriority)
    WHERE s1.block = 1 AND s1.p = t.p1 AND s2.block = 2 AND s2.p = t.p2 AND s3.block = 3 AND s3.p = t.p3 AND s4.block = 4 AND s4.p = t.p4),
seen AS (SELECT o_orderpriority, sum(stat) AS observed FROM one WHERE p = 0 GROUP BY 1)
SELECT o_orderpriority, count(*) AS relabelings, round(avg(CAST(abs(stat) >= abs(observed) - 1e-6 AS INT)), 9) AS p_value, round(any_value(observed) / 5, 3) AS observed FROM made JOIN seen USING (o_orderpriority) GROUP BY 1""")
def q_permutation_p(spark, sf_dir):
    """Two-sided p-values of one format against two others over all (3!)^5 relabelings within five blocks.

    A block's statistic under each of the six orders is found once; all choices of one order a block are sums of those.
    """
    kind = F.col("o_custkey") % 3
    means = [F.avg(F.when(kind == k, F.col("o_totalprice"))).alias(f"m{k}") for k in range(3)]
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 5).alias("block")).agg(*means)
    stat = lambda o: F.col(f"m{o[0]}") - (F.col(f"m{o[1]}") + F.col(f"m{o[2]}")) / 2
    rows = rows.groupBy("o_orderpriority").pivot("block", list(range(5))).agg(F.first(F.array(*[stat(o) for o in ORDERS])))
    observed = sum((F.get(F.col(str(k)), F.lit(0)) for k in range(5)), F.lit(0.0))
    rows = rows.withColumn("observed", observed)
    for k in range(5):  # six rows for each row, five times: bounded by the design
        rows = rows.withColumn(f"s{k}", F.explode(str(k)))
    made = sum((F.col(f"s{k}") for k in range(5)), F.lit(0.0))
    extreme = (F.abs(made) >= F.abs("observed") - 1e-6).cast("int")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("relabelings"), F.round(F.avg(extreme), 9).alias("p_value"), F.round(F.first("observed") / 5, 3).alias("observed"))


BLOCKS = 12
_SUM_SQL = lambda name, ks: f"{name} AS (SELECT o_orderpriority, {' + '.join(f's{k}.v' for k in ks)} AS s FROM one s{ks[0]} {' '.join(f'JOIN one s{k} USING (o_orderpriority)' for k in ks[1:])} WHERE {' AND '.join(f's{k}.block = {k}' for k in ks)})"


@query(f"""WITH y AS (SELECT o_orderpriority, o_orderkey % {BLOCKS} AS block, avg(CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END) AS f, avg(CASE WHEN o_custkey % 3 = 1 THEN o_totalprice END) AS o, avg(CASE WHEN o_custkey % 3 = 2 THEN o_totalprice END) AS q FROM orders GROUP BY ALL),
one AS (SELECT o_orderpriority, block, unnest([f - (o + q) / 2, o - (f + q) / 2, q - (f + o) / 2]) AS v FROM y),
seen AS (SELECT o_orderpriority, sum(f - (o + q) / 2) AS observed FROM y GROUP BY 1),
{_SUM_SQL("low", range(BLOCKS // 2))}, {_SUM_SQL("high", range(BLOCKS // 2, BLOCKS))}
SELECT o_orderpriority, {BLOCKS}::BIGINT AS blocks, pow(6, {BLOCKS}) AS relabelings, round(any_value(observed) / {BLOCKS}, 3) AS observed, round(avg(CAST(abs(low.s + high.s) >= abs(observed) - 1e-6 AS INT)), 9) AS p_value
FROM low JOIN high USING (o_orderpriority) JOIN seen USING (o_orderpriority) GROUP BY 1""")
def q_permutation_blocks(spark, sf_dir):
    """The same test within twelve blocks, over all (3!)^12 relabelings, by convolution."""
    kind = F.col("o_custkey") % 3
    means = [F.avg(F.when(kind == k, F.col("o_totalprice"))).alias(f"m{k}") for k in range(3)]
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % BLOCKS).alias("block")).agg(*means)
    stat = lambda o: F.col(f"m{o[0]}") - (F.col(f"m{min(o[1:])}") + F.col(f"m{max(o[1:])}")) / 2
    found = permutation.p_values(rows.select("o_orderpriority", "block", F.array(*[stat(o) for o in ORDERS]).alias("stats")), ["o_orderpriority"], ["block"], "stats")
    return found.select("o_orderpriority", "blocks", "relabelings", F.round(F.col("observed") / BLOCKS, 3).alias("observed"), F.round("p_value", 9).alias("p_value"))


@query("""SELECT l_returnflag AS format, count(*) AS requests, round(sum(l_extendedprice) / count(*), 4) AS joules_per_request, round(sum(l_extendedprice) / nullif(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0), 4) AS joules_per_output_token,
    round(sum(l_extendedprice) / nullif(sum(l_quantity + l_linenumber), 0), 4) AS joules_per_total_token, round(sum(l_quantity) / nullif(sum(l_extendedprice), 0), 8) AS tokens_per_joule, round(avg(CAST(l_linestatus = 'F' AS INT)), 6) AS completion_rate FROM lineitem GROUP BY 1""")
def q_energy_ratios(spark, sf_dir):
    """Energy for each request and token, and the share of requests that completed; null where there is nothing to divide by."""
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity", "l_linenumber", "l_linestatus")
    done, joules = F.col("l_linestatus") == "F", F.sum("l_extendedprice")
    ratio = lambda a, b, digits: F.round(F.try_divide(a, b), digits)
    return line.groupBy(F.col("l_returnflag").alias("format")).agg(
        F.count(F.lit(1)).alias("requests"), ratio(joules, F.count(F.lit(1)), 4).alias("joules_per_request"), ratio(joules, F.sum(F.when(done, F.col("l_quantity"))), 4).alias("joules_per_output_token"),
        ratio(joules, F.sum(F.col("l_quantity") + F.col("l_linenumber")), 4).alias("joules_per_total_token"), ratio(F.sum("l_quantity"), joules, 8).alias("tokens_per_joule"), F.round(F.avg(done.cast("int")), 6).alias("completion_rate"),
    )


FORMS_SQL = """CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y%m%dT%H%M%S+0130') WHEN 2 THEN strftime(o_orderdate, '%G-W%V-%u %H:%M-02:00')
    WHEN 3 THEN strftime(o_orderdate, '%GW%V%uT%H+00:00') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.25Z')
    WHEN 7 THEN strftime(o_orderdate, '%Y-13-%dT%H:%M:%SZ') ELSE ' ' END"""


@query(f"""SELECT o_orderkey, {FORMS_SQL} AS raw, CASE o_orderkey % 9 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(o_orderdate) - 5400000000 WHEN 2 THEN epoch_us(date_trunc('minute', o_orderdate)) + 7200000000
    WHEN 3 THEN epoch_us(date_trunc('hour', o_orderdate)) WHEN 6 THEN epoch_us(o_orderdate) + 250000 END AS micros FROM orders""")
def q_utc_parse(spark, sf_dir):
    """Time stamps in the forms of ISO 8601, extended, basic and by weeks; without an offset or a time they aren't one."""
    at, kind = F.col("o_orderdate"), F.col("o_orderkey") % 9
    stamp = lambda pattern: F.date_format(at, pattern)
    week = F.lpad(F.weekofyear(at).cast("string"), 2, "0")
    year, day = F.expr("extract(YEAROFWEEK FROM o_orderdate)").cast("string"), (F.weekday(at) + 1).cast("string")
    raw = (
        F.when(kind == 0, stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, stamp("yyyyMMdd'T'HHmmss'+0130'"))
        .when(kind == 2, F.concat(year, F.lit("-W"), week, F.lit("-"), day, stamp(" HH:mm'-02:00'")))
        .when(kind == 3, F.concat(year, F.lit("W"), week, day, stamp("'T'HH'+00:00'")))
        .when(kind == 4, stamp("yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 5, stamp("yyyy-MM-dd"))
        .when(kind == 6, stamp("yyyy-MM-dd'T'HH:mm:ss'.25Z'"))
        .when(kind == 7, stamp("yyyy'-13-'dd'T'HH:mm:ss'Z'"))
        .otherwise(" ")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", "raw", F.unix_micros(V.utc(F.col("raw"))).alias("micros"))


@query("""SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def q_quantiles(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    return quantiles.by_group(events, "event_type", "value", {"p05": 0.05, "p95": 0.95}, digits=6)


@query(f"""WITH s(level, family, role) AS (VALUES {", ".join(f"('{level}', '{family}', '{role}')" for level in R.LEVELS for family in R.FAMILIES for role in sorted({R.ROLES.get(f"{family}.{g}", R.ROLES[f"{family}.*"]) for g in R.LEVELS[level][family]}))})
SELECT level, family, role, 'S' || CAST(s_suppkey AS VARCHAR) AS reviewer_code, '' AS comment FROM supplier JOIN s ON level = 'L' || CAST(s_suppkey % 5 AS VARCHAR)""")
def q_panel_template(spark, sf_dir):
    """A blank line for each reviewer, family and role that must review the level that the reviewer is given."""
    from gatelight.operators import conformance as C

    rows = C.required_roles(C.registry_gates(spark)).select("level", "family", "role").distinct()
    reviewers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("reviewer_code"), F.concat(F.lit("L"), (F.col("s_suppkey") % 5).cast("string")).alias("level"))
    return reviewers.join(F.broadcast(rows), "level").select("level", "family", "role", "reviewer_code", F.lit("").alias("comment"))


@study("""SELECT 'ar1_model_based_null' AS scenario, 0.0::DOUBLE AS effect UNION ALL SELECT 'ar1_model_based_exact_sesoi', 2.0 UNION ALL SELECT 'ar1_model_based_5_percent', 5.0""")
def q_scenario_labels(spark, sf_dir):
    cells = simulate.grid(spark, effect=[0.0, 2.0, 5.0])
    return cells.select(simulate.ar1_scenario(F.col("effect")).alias("scenario"), "effect")


