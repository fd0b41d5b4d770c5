"""Queries on blocks, intervals, decisions, rates and ordered series, each with the SQL that it is checked against."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gatelight.functions.statistics import Z95, mean_se_ar1, t_critical
from gatelight.operators import decisions as D
from gatelight.operators import ordered
from gatelight.operators import simulate as S
from gatelight.sources.tables import BLOCKS_SQL, blocks, table

QUERIES, ORACLE_SQL = {}, {}
#: What reads no given table: grids and simulations. Not registered.
STUDIES, STUDY_SQL = {}, {}
SESOI, FRACTION = 1.0, 0.7


def query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def study(sql: str | None):
    def add(function):
        STUDIES[function.__name__] = function
        if sql is not None:
            STUDY_SQL[function.__name__] = sql
        return function

    return add


T_SQL = "tq(df, t) AS (VALUES " + ", ".join(f"({n}, {t_critical(n)!r}::DOUBLE)" for n in range(1, 201)) + ")"
SUMMARY_SQL = f"""WITH {BLOCKS_SQL}, {T_SQL}, summary AS (
    SELECT l_suppkey, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, count(*) FILTER (WHERE value > 0) AS favorable FROM blocks GROUP BY 1
), bounds AS (
    SELECT s.*, sd / sqrt(n) AS se, mean - t * sd / sqrt(n) AS lower, mean + t * sd / sqrt(n) AS upper FROM summary s LEFT JOIN tq ON df = n - 1
)"""
STATE_SQL = f"""CASE WHEN lower > {SESOI} + 1e-12 AND favorable >= ceil({FRACTION} * n) THEN 'supported' WHEN upper < {SESOI} - 1e-12 THEN 'contradicted' ELSE 'inconclusive' END"""


def _bounds(spark, sf_dir):
    return D.t_interval(D.block_summary(blocks(spark, sf_dir), ["l_suppkey"]))


@query(f"{SUMMARY_SQL} SELECT l_suppkey, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bounds")
def q_block_mean_sd_ci(spark, sf_dir):
    return _bounds(spark, sf_dir).select("l_suppkey", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "lower", "upper")])


@query(f"{SUMMARY_SQL} SELECT l_suppkey, n, favorable, CAST(ceil({FRACTION} * n) AS BIGINT) AS required, favorable >= ceil({FRACTION} * n) AS guard FROM bounds")
def q_direction_guard(spark, sf_dir):
    required = D.required_favorable(F.col("n"), FRACTION)
    return D.block_summary(blocks(spark, sf_dir), ["l_suppkey"]).select("l_suppkey", "n", "favorable", required.cast("long").alias("required"), (F.col("favorable") >= required).alias("guard"))


@query(f"{SUMMARY_SQL} SELECT l_suppkey, {STATE_SQL} AS state FROM bounds")
def q_numeric_state(spark, sf_dir):
    return _bounds(spark, sf_dir).select("l_suppkey", D.decide(F.col("lower"), F.col("upper"), F.col("favorable"), F.col("n"), SESOI, FRACTION).alias("state"))


@query(f"""{SUMMARY_SQL} SELECT s_nationkey, round(avg(CAST(mean > {SESOI} AS INT)), 6) AS b0_rate, round(avg(CAST(lower > {SESOI} AS INT)), 6) AS b1_rate,
    round(avg(CAST(lower > {SESOI} AND favorable / n >= {FRACTION} AS INT)), 6) AS b2_rate, count(*) AS suppliers FROM bounds JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def q_b0_b1_b2_rates(spark, sf_dir):
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rate = lambda cond: F.round(F.avg(cond.cast("int")), 6)
    guard = F.col("favorable") / F.col("n") >= FRACTION
    return _bounds(spark, sf_dir).join(nation, "l_suppkey").groupBy("s_nationkey").agg(
        rate(F.col("mean") > SESOI).alias("b0_rate"), rate(F.col("lower") > SESOI).alias("b1_rate"), rate((F.col("lower") > SESOI) & guard).alias("b2_rate"), F.count(F.lit(1)).alias("suppliers")
    )


LOG_SQL = """WITH r AS (SELECT l_suppkey, ln(l_extendedprice / (l_extendedprice * (1 - l_discount))) AS v FROM lineitem)
SELECT l_suppkey, round(avg(v), 6) AS mean_log_ratio, avg(v) > -ln(1 - 2 / 100.0) AS over_threshold FROM r GROUP BY 1"""


@query(LOG_SQL)
def q_log_ratio(spark, sf_dir):
    value = F.ln(F.col("l_extendedprice") / (F.col("l_extendedprice") * (1 - F.col("l_discount"))))
    out = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg(value).alias("v"))
    return out.select("l_suppkey", F.round("v", 6).alias("mean_log_ratio"), (F.col("v") > -F.log1p(F.lit(-2 / 100))).alias("over_threshold"))


@query(f"{SUMMARY_SQL} SELECT l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN 'inconclusive' ELSE {STATE_SQL} END AS state, l_suppkey % 4 <> 0 AS interval_compatible FROM bounds")
def q_incompatible_override(spark, sf_dir):
    state = D.decide(F.col("lower"), F.col("upper"), F.col("favorable"), F.col("n"), SESOI, FRACTION)
    fits = F.col("l_suppkey") % 4 != 0
    return _bounds(spark, sf_dir).select("l_suppkey", F.when(~fits, "inconclusive").otherwise(state).alias("state"), fits.alias("interval_compatible"))


@query("""SELECT event_type, count(*) AS n, round(avg(CAST(value > 50 AS INT)), 6) AS rate,
    round(sqrt(avg(CAST(value > 50 AS INT)) * (1 - avg(CAST(value > 50 AS INT))) / count(*)), 8) AS mc_se FROM events GROUP BY 1""")
def q_mc_se(spark, sf_dir):
    p = F.avg((F.col("value") > 50).cast("int"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(p, 6).alias("rate"), F.round(F.sqrt(p * (1 - p) / F.count(F.lit(1))), 8).alias("mc_se"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) FILTER (WHERE v > 0) AS favorable FROM x GROUP BY 1""")
def q_matrix_rows(spark, sf_dir):
    values = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", values.alias("v"), F.size("embedding").alias("k"))
    total = lambda col, f: F.aggregate(col, F.lit(0.0), lambda acc, x: acc + f(x))
    rows = rows.withColumn("mean", total("v", lambda x: x) / F.col("k"))
    squares = F.aggregate(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("vec_id", F.col("k").cast("long").alias("n"), F.round("mean", 6).alias("mean"), F.round(F.sqrt(squares / (F.col("k") - 1)), 6).alias("sd"), F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("favorable"))


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT l_suppkey, count(*) AS n FROM blocks GROUP BY 1)
SELECT l_suppkey, n, round(sqrt(25.0 / n * (1 + 2 * list_sum(list_transform(range(1, n), lambda k: (1 - k / n) * pow(0.65, k))))), 8) AS ar1_se FROM c WHERE n > 1""")
def q_ar1_se(spark, sf_dir):
    counts = blocks(spark, sf_dir).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts.select("l_suppkey", "n", F.round(mean_se_ar1(F.col("n"), 0.65, 5.0), 8).alias("ar1_se"))


@query("""WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT c.conv_id, count(*) AS turns, round(sum(length(text) * pow(0.65::DOUBLE, last - turn)), 4) AS level FROM conversations c JOIN m USING (conv_id) GROUP BY 1""")
def q_ar1_fold(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("size")))).alias("x"))
    level = F.aggregate("x", F.lit(0.0), lambda acc, t: acc * 0.65 + t["size"])
    return turns.select("conv_id", F.size("x").cast("long").alias("turns"), F.round(level, 4).alias("level"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS positives, round(count(*) FILTER (WHERE value > 100) / count(*), 6) AS score FROM events GROUP BY 1""")
def q_label_counts(spark, sf_dir):
    over = F.count_if(F.col("value") > 100)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), over.alias("positives"), F.round(over / F.count(F.lit(1)), 6).alias("score"))


@query("""WITH g AS (SELECT o_orderstatus, o_orderpriority, avg(CAST(o_totalprice > 200000 AS INT)) AS rate FROM orders GROUP BY ALL)
SELECT o_orderstatus, round(max(rate), 6) AS max_rate, arg_max(o_orderpriority, (rate, o_orderpriority)) AS at_priority FROM g WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def q_grid_max(spark, sf_dir):
    grid = table(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg((F.col("o_totalprice") > 200000).cast("int")).alias("rate"))
    top = F.max(F.struct("rate", "o_orderpriority")).alias("top")
    return grid.groupBy("o_orderstatus").agg(top).select("o_orderstatus", F.round("top.rate", 6).alias("max_rate"), F.col("top.o_orderpriority").alias("at_priority"))


@query("""SELECT coalesce(l_returnflag, 'all') AS target, coalesce(l_linestatus, 'all_confirmed_cells') AS workload, count(*) AS n, round(avg(l_discount), 6) AS mean_reduction
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))""")
def q_total_rows(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    sets = line.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"]], "l_returnflag", "l_linestatus")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("m"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("target"), F.coalesce("l_linestatus", F.lit("all_confirmed_cells")).alias("workload"), "n", F.round("m", 6).alias("mean_reduction"))


@query("""WITH y AS (SELECT o_orderpriority, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT o_orderpriority, count(*) AS n_repeats, round(avg(v), 4) AS mean_value, round(min(v), 4) AS min_value, round(max(v), 4) AS max_value FROM y GROUP BY 1""")
def q_repeat_min_mean_max(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return years.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_repeats"), *[F.round(f("v"), 4).alias(f"{n}_value") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


@query("""WITH r AS (SELECT doc_id % 40 AS item, quality * 2 + toxic + 1 AS rating FROM labels)
SELECT item, count(*) AS n, round(avg(CAST(rating >= 3 AS INT)), 6) AS i_cvi, round((count(*) FILTER (WHERE rating = 3) - count(*) / 2) / (count(*) / 2), 6) AS cvr FROM r GROUP BY 1 HAVING count(*) >= 5""")
def q_panel_indices(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("item"), (F.col("quality") * 2 + F.col("toxic") + 1).alias("rating"))
    out = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rating") >= 3).cast("int")).alias("p"), F.count_if(F.col("rating") == 3).alias("needed")).filter("n >= 5")
    half = F.col("n") / 2
    return out.select("item", "n", F.round("p", 6).alias("i_cvi"), F.round((F.col("needed") - half) / half, 6).alias("cvr"))


_NEED, _FIT = ["essential", "useful_not_essential", "not_necessary"], ["correct", "too_low", "too_high", "not_applicable"]


@query(f"""WITH r AS (SELECT doc_id % 40 AS item, quality * 2 + toxic + 1 AS relevance, doc_id // 40 % 4 + 1 AS clarity, {_NEED}[doc_id // 7 % 3 + 1] AS necessity, {_FIT}[doc_id // 11 % 4 + 1] AS fit FROM labels)
SELECT item, count(*) AS n, round(avg(CAST(relevance >= 3 AS INT)), 6) AS i_cvi_relevance, round(avg(CAST(clarity >= 3 AS INT)), 6) AS i_cvi_clarity, round((count(*) FILTER (WHERE necessity = 'essential') - count(*) / 2) / (count(*) / 2), 6) AS cvr,
    round(avg(CAST(fit = 'correct' AS INT)), 6) AS agreement, count(*) FILTER (WHERE fit = 'too_low') AS too_low, count(*) FILTER (WHERE fit = 'too_high') AS too_high FROM r GROUP BY 1 HAVING count(*) >= 5""")
def q_panel_report(spark, sf_dir):
    """Ratings of each item by a panel: relevance and clarity apart, necessity, and agreement with the assigned profile, from five ratings on."""
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(F.col("doc_id") / k) % len(names) + 1).cast("int"))
    rated = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 40).alias("item"), (F.col("quality") * 2 + F.col("toxic") + 1).alias("relevance"), (F.floor(F.col("doc_id") / 40) % 4 + 1).alias("clarity"), pick(_NEED, 7).alias("necessity"), pick(_FIT, 11).alias("fit")
    )
    n, share = F.count(F.lit(1)), lambda cond: F.round(F.avg(cond.cast("int")), 6)
    half, needed = n / 2, F.count_if(F.col("necessity") == "essential")
    return rated.groupBy("item").agg(
        n.alias("n"), share(F.col("relevance") >= 3).alias("i_cvi_relevance"), share(F.col("clarity") >= 3).alias("i_cvi_clarity"), F.round((needed - half) / half, 6).alias("cvr"), share(F.col("fit") == "correct").alias("agreement"),
        F.count_if(F.col("fit") == "too_low").alias("too_low"), F.count_if(F.col("fit") == "too_high").alias("too_high"),
    ).filter("n >= 5")


@study("""WITH d(design) AS (VALUES ('iid_t'), ('ar1_model')), n(n_blocks) AS (VALUES (10), (20), (35), (50), (150)), e(effect) AS (VALUES (0.0), (2.0), (5.0))
SELECT design, n_blocks, CAST(effect AS DOUBLE) AS effect, CAST(ceil(0.8 * n_blocks) AS BIGINT) AS required FROM d, n, e""")
def q_cross_grid(spark, sf_dir):
    grid = S.grid(spark, design=["iid_t", "ar1_model"], n_blocks=[10, 20, 35, 50, 150], effect=[0.0, 2.0, 5.0])
    return grid.select("design", F.col("n_blocks").cast("int").alias("n_blocks"), "effect", D.required_favorable(F.col("n_blocks"), 0.8).cast("long").alias("required"))


@query("""WITH e AS (SELECT event_type, avg(CAST(value > 10 AS INT)) AS p, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, 'missed' AS scenario, round(p, 6) AS rate, n FROM e UNION ALL SELECT event_type, 'forged', round(1 - p, 6), n FROM e UNION ALL SELECT event_type, 'blocked', 1.0, n FROM e""")
def q_union_scenarios(spark, sf_dir):
    rates = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") > 10).cast("int")).alias("p"), F.count(F.lit(1)).alias("n"))
    kinds = F.array(*[F.struct(F.lit(name).alias("scenario"), rate.alias("rate")) for name, rate in (("missed", F.col("p")), ("forged", 1 - F.col("p")), ("blocked", F.lit(1.0)))])
    return rates.select("event_type", F.explode(kinds).alias("x"), "n").select("event_type", "x.scenario", F.round("x.rate", 6).alias("rate"), "n")


@query("""WITH w AS (SELECT user_id, epoch_us(ts) AS t, value, lag(epoch_us(ts)) OVER p AS t0, lag(value) OVER p AS v0, row_number() OVER p AS k FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS samples, max(t - t0) AS max_gap_us, round(sum((value + v0) / 2 * ((t - t0) / 1000000.0)), 3) AS area, count(*) FILTER (WHERE k % 2 = 1) AS stride_two FROM w GROUP BY 1""")
def q_gap_trapezoid(spark, sf_dir):
    """Gaps, trapezoids and every second sample of each user's series; a user's rows are divided over ranges."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", t.alias("t"))
    rows = ordered.running(rows, ["user_id"], ["t", "event_id"], {"k": F.lit(1)}, lags={"t0": F.col("t"), "v0": F.col("value")})
    area = F.sum((F.col("value") + F.col("v0")) / 2 * ((F.col("t") - F.col("t0")) / 1000000.0))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"), F.max(F.col("t") - F.col("t0")).alias("max_gap_us"), F.round(area, 3).alias("area"), F.count_if(F.col("k") % 2 == 1).alias("stride_two"))


@query("""SELECT a.event_id, count(b.event_id) AS within_hour, max(b.event_id) AS last_id FROM events a LEFT JOIN events b
ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR GROUP BY 1""")
def q_window_range_join(spark, sf_dir):
    """How many events of the user follow within an hour, and the greatest id of these: by running totals, without pairs."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    found = ordered.within_after(events, ["user_id"], "t", "event_id", 3_600_000_000)
    return found.select("event_id", F.col("n").alias("within_hour"), F.col("highest").alias("last_id"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS order_then, arg_max(o.o_totalprice, (o.o_orderdate, o.o_orderkey)) AS price_then
FROM l LEFT JOIN orders o ON o.o_custkey = l.o_custkey AND o.o_orderdate <= l.l_shipdate GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate""")
def q_asof_price(spark, sf_dir):
    """The customer's last order up to the day a line was shipped, and its price: an as-of match in one order of both sides."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"))
    n = ordered.tasks_for(spark, line.count() + orders.count())
    owners = ordered.dealt(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), n, "l_orderkey")
    owned = ordered.dealt(line, n, "l_orderkey").join(owners, "l_orderkey").distinct()
    found = ordered.as_of(owned, orders, ["o_custkey"], "at", "o_orderkey", {"order_then": "o_orderkey", "price_then": "o_totalprice"}, n_ranges=n)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "order_then", "price_then")


def _normal_sql(made: str) -> str:
    part = lambda at: f"((('0x' || substr({made}, {at}, 13))::BIGINT + 0.5) / {float(1 << 52)!r})"
    return f"sqrt(-2 * ln({part(1)})) * cos({2 * math.pi!r} * {part(14)})"


def _made_sql(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('|', {seed}, {', '.join(keys)}))"


def _cells_sql(rows) -> str:
    return ", ".join(f"('{name}', {effect!r}::DOUBLE)" for name, effect in rows)


def _ar1_sql(rows: str, cell: str) -> str:
    """x, less the effect, of each block by the closed form of the recurrence. rows: cell, iter, i and e."""
    scale = f"CASE WHEN i = 0 THEN {S.SD!r} ELSE {S.SD * (1 - S.RHO**2) ** 0.5!r} END"
    return f"SELECT *, pow({S.RHO!r}, i) * sum(e * {scale} / pow({S.RHO!r}, i)) OVER (PARTITION BY {cell}, iter ORDER BY i) AS x FROM {rows}"


def _fold_sql(rows: str, cell: str) -> str:
    return f"""SELECT {cell}, iter, count(*) AS n, avg(x + effect) AS mean, sqrt(greatest(0, sum((x + effect) * (x + effect)) - sum(x + effect) * sum(x + effect) / count(*)) / (count(*) - 1) / count(*)) AS se,
        count(*) FILTER (WHERE x + effect > 0) AS favorable FROM {rows} GROUP BY {cell}, iter"""


_RATE = lambda cond: f"avg(CAST({cond} AS INT))"
_COMPOSITE = [("iid_normal", e) for e in (0.0, 0.5, 1.0, 1.5, 2.0, 2.1, 2.5, 5.0)] + [(s, e) for s in ("iid_t3", "heteroscedastic", "stationary_ar1") for e in (0.0, 2.0, 5.0)]
_SQUARES = " + ".join(f"pow({_normal_sql(_made_sql(S.SEED + k, 'scenario', 'effect', 'iter', 'i'))}, 2)" for k in (1, 2, 3))
_BOTH = f"mean - {t_critical(9)!r} * se > {S.SESOI!r}"
_GUARD = f"favorable / n >= {S.FRACTION!r}"
COMPOSITE_SQL = f"""WITH cells(scenario, effect) AS (VALUES {_cells_sql(_COMPOSITE)}), draws AS (
    SELECT scenario, effect, t.range AS iter, b.range AS i, {_normal_sql(_made_sql(S.SEED, "scenario", "effect", "t.range", "b.range"))} AS e FROM cells, range({S.ITERATIONS}) t, range(10) b
), series AS (SELECT * FROM draws WHERE scenario = 'stationary_ar1'), x AS (
    SELECT scenario, effect, iter, {S.SD!r} * CASE scenario WHEN 'iid_t3' THEN e / sqrt({_SQUARES}) WHEN 'heteroscedastic' THEN e * CASE WHEN i % 2 = 0 THEN 0.55 ELSE 1.3 END ELSE e END AS x
    FROM draws WHERE scenario <> 'stationary_ar1' UNION ALL SELECT scenario, effect, iter, x FROM ({_ar1_sql("series", "scenario, effect")})
), f AS ({_fold_sql("x", "scenario, effect")})
SELECT scenario, effect, {_RATE(f"mean > {S.SESOI!r}")} AS b0_rate, {_RATE(_BOTH)} AS b1_rate, {_RATE(f"{_BOTH} AND {_GUARD}")} AS b2_rate, {_RATE(f"mean + {t_critical(9)!r} * se < {S.SESOI!r}")} AS contradicted_rate,
    {_RATE(_GUARD)} AS guard_rate, {_RATE(f"{_BOTH} AND NOT ({_GUARD})")} AS support_guard_fail_rate, count(*) AS iterations,
    CASE WHEN effect <= {S.SESOI!r} THEN {_RATE(f"{_BOTH} AND {_GUARD}")} ELSE 0.0 END AS false_support, CASE WHEN effect > {S.SESOI!r} THEN {_RATE(f"{_BOTH} AND {_GUARD}")} ELSE 0.0 END AS power
FROM f GROUP BY scenario, effect"""


@study(COMPOSITE_SQL)
def sim_composite_null(spark, sf_dir):
    return S.composite_null(spark)


@study(None)
def sim_direction_guard(spark, sf_dir):
    return S.direction_guard(spark)


_SE_150 = (S.SD**2 / 150 * (1 + 2 * sum((1 - k / 150) * S.RHO**k for k in range(1, 150)))) ** 0.5
_KNOWN = f"mean - {Z95 * _SE_150!r} > {S.SESOI!r} AND {_GUARD}"
_CONTRA = f"mean + {Z95 * _SE_150!r} < {S.SESOI!r}"
AR1_SQL = f"""WITH cells(effect) AS (VALUES (0.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)), draws AS (
    SELECT effect, t.range AS iter, b.range AS i, {_normal_sql(_made_sql(S.SEED, "effect", "t.range", "b.range"))} AS e FROM cells, range({S.ITERATIONS}) t, range(150) b
), x AS ({_ar1_sql("draws", "effect")}), f AS ({_fold_sql("x", "effect")}), r AS (
    SELECT effect, {_RATE(f"mean - {Z95 * _SE_150!r} <= effect")} AS lower_coverage, {_RATE(f"mean + {Z95 * _SE_150!r} >= effect")} AS upper_coverage, {_RATE(_KNOWN)} AS s, {_RATE(_CONTRA)} AS c,
        {_RATE(f"NOT ({_KNOWN}) AND NOT ({_CONTRA})")} AS inconclusive_rate, count(*) AS iterations FROM f GROUP BY effect)
SELECT effect, CASE effect WHEN 0 THEN 'ar1_model_based_null' WHEN 2 THEN 'ar1_model_based_exact_sesoi' ELSE 'ar1_model_based_5_percent' END AS scenario, round({_SE_150!r}::DOUBLE, 9) AS exact_se, lower_coverage, upper_coverage,
    round({2 * Z95 * _SE_150!r}::DOUBLE, 9) AS mean_width, s AS supported_rate, c AS contradicted_rate, inconclusive_rate, iterations, CASE WHEN effect <= 2 THEN s ELSE 0.0 END AS false_support_rate,
    CASE WHEN effect > 2 THEN c ELSE 0.0 END AS false_contradiction_rate, CASE WHEN effect > 2 THEN s ELSE 0.0 END AS power_supported_rate FROM r"""


@study(AR1_SQL)
def sim_ar1_control(spark, sf_dir):
    out = S.ar1_control(spark)
    return out.withColumns({c: F.round(c, 9) for c in ("exact_se", "mean_width")})


_LINE = "(i / 19.0)"
_STRESS = ["iid_percent_reduction", "paired_log_ratio", "heteroscedastic", "ordered_drift", "change_point"]
_BASE = f"exp(ln(100.0) + 0.45 * {_normal_sql(_made_sql(S.SEED + 10, 'scenario', 'iter', 'i'))})"
_LIMIT = f"CASE scenario WHEN 'paired_log_ratio' THEN {-math.log1p(-S.SESOI / 100)!r} ELSE {S.SESOI!r} END"
STRESS_SQL = f"""WITH cells(scenario, compatible) AS (VALUES {", ".join(f"('{name}', {str(k < 2).lower()})" for k, name in enumerate(_STRESS))}), draws AS (
    SELECT scenario, compatible, 0.0::DOUBLE AS effect, t.range AS iter, b.range AS i, {_normal_sql(_made_sql(S.SEED + 1, "scenario", "t.range", "b.range"))} AS e FROM cells, range({S.ITERATIONS}) t, range(20) b
), x AS (SELECT scenario, compatible, effect, iter, CASE scenario WHEN 'iid_percent_reduction' THEN 5 + 5 * e WHEN 'paired_log_ratio' THEN -ln(0.95) - (0.08 + 0.00015 * {_BASE}) * e
    WHEN 'heteroscedastic' THEN 5 + (2 + 7 * {_LINE}) * e WHEN 'ordered_drift' THEN 5 - 3 + 6 * {_LINE} + 5 * e ELSE CASE WHEN i < 10 THEN 8 ELSE 2 END + 5 * e END AS x FROM draws
), f AS ({_fold_sql("x", "scenario, compatible")}), d AS (
    SELECT *, mean - {t_critical(19)!r} * se > {_LIMIT} + {S.TOLERANCE!r} AND favorable >= 16 AS yes, mean + {t_critical(19)!r} * se < {_LIMIT} - {S.TOLERANCE!r} AS no FROM f
), r AS (SELECT scenario, compatible, count(*) AS draws, {_RATE("yes")} AS s, {_RATE("NOT yes AND no")} AS c FROM d GROUP BY scenario, compatible
), p AS (SELECT scenario, compatible, draws, CASE WHEN compatible THEN s ELSE 0.0 END AS s, CASE WHEN compatible THEN c ELSE 0.0 END AS c, CASE WHEN compatible THEN 1 - s - c ELSE 1.0 END AS u FROM r)
SELECT scenario, compatible, draws, 5.0::DOUBLE AS true_effect, CASE scenario WHEN 'paired_log_ratio' THEN 'log_ratio' ELSE 'percent_reduction' END AS effect_scale,
    round(s, 9) AS supported_probability, round(sqrt(greatest(0, s * (1 - s)) / draws), 9) AS supported_mc_se, round(c, 9) AS contradicted_probability, round(sqrt(greatest(0, c * (1 - c)) / draws), 9) AS contradicted_mc_se,
    round(u, 9) AS inconclusive_probability, round(sqrt(greatest(0, u * (1 - u)) / draws), 9) AS inconclusive_mc_se FROM p"""


@study(STRESS_SQL)
def sim_stress(spark, sf_dir):
    out = S.stress(spark)
    return out.select(*[F.round(c, 9).alias(c) if c.endswith(("probability", "mc_se")) else c for c in out.columns])


_ERROR_CASES = [("invalid_critical_gate_upstream_false_pass", "true", "promoted", "0.0"), ("valid_critical_gate_upstream_false_nonpass", "true", "0.0", "rejected"), ("manifest_detectable_attack", "false", "0.0", "1.0")]
_EVEN = lambda seed: f"((('0x' || substr({_made_sql(seed, 'error_rate', 't.range')}, 1, 13))::BIGINT + 0.5) / {float(1 << 52)!r}) < error_rate"
ERROR_SQL = f"""WITH cells(error_rate) AS (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)), d AS (
    SELECT error_rate, {_RATE(_EVEN(S.SEED))} AS promoted, {_RATE(_EVEN(S.SEED + 100))} AS rejected, count(*) AS iterations FROM cells, range({S.ITERATIONS}) t GROUP BY 1)
{" UNION ALL ".join(f"SELECT '{name}' AS scenario, {ok} AS local_checks_pass, {p}::DOUBLE AS false_promotion_rate, {r}::DOUBLE AS abstention_rate, error_rate, iterations FROM d" for name, ok, p, r in _ERROR_CASES)}"""


@study(ERROR_SQL)
def sim_attestation_error(spark, sf_dir):
    return S.attestation_error(spark)
