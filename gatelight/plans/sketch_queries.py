"""Queries on sketches and sessions of events, each with the SQL that it is checked against.

Estimates aren't exact, so a query on sketches returns what is exact and whether its estimates are within the stated error, and the SQL says that they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelight.operators import sketches
from gatelight.sources.tables import table
from gatelight.streaming import stateful

QUERIES, ORACLE_SQL = {}, {}
SHARES = (0.05, 0.5, 0.95)


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, sql
        return function

    return add


def _daily(spark, sf_dir):
    """Sketches by day and type: what a pipeline keeps."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "value", F.date_trunc("day", "ts").alias("day"))
    return events, sketches.by_part(events, ["event_type", "day"], "value", "user_id")


@query(f"""SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS week, count(value) AS n, {', '.join(f"true AS within_{round(100 * q)}" for q in SHARES)} FROM events GROUP BY 1, 2""")
def q_sketch_quantiles(spark, sf_dir):
    """Quantiles of weeks from merged daily sketches: whether the exact rank of each estimate is within the sketch's error."""
    events, daily = _daily(spark, sf_dir)
    week = F.date_trunc("week", "day")
    weekly = sketches.merged(daily.withColumn("week", week), ["event_type", "week"])
    told = weekly.select("event_type", "week", *[sketches.quantile(F.col("values"), q).alias(f"q{k}") for k, q in enumerate(SHARES)])
    rows = events.withColumn("week", week).filter("value IS NOT NULL").join(told, ["event_type", "week"])
    n = F.count(F.lit(1))
    # The estimate's rank lies between the shares of smaller values and of values up to it.
    within = lambda k, q: (F.count_if(F.col("value") < F.col(f"q{k}")) / n <= q + sketches.rank_error()) & (F.count_if(F.col("value") <= F.col(f"q{k}")) / n >= q - sketches.rank_error())
    return rows.groupBy("event_type", "week").agg(n.alias("n"), *[within(k, q).alias(f"within_{round(100 * q)}") for k, q in enumerate(SHARES)])


@query("SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS week, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1, 2")
def q_sketch_distinct(spark, sf_dir):
    """Users of weeks from merged daily sketches, held against the exact number."""
    events, daily = _daily(spark, sf_dir)
    week = F.date_trunc("week", "day")
    told = sketches.merged(daily.withColumn("week", week), ["event_type", "week"]).select("event_type", "week", sketches.distinct(F.col("items")).alias("about"))
    exact = events.groupBy("event_type", week.alias("week")).agg(F.count_distinct("user_id").alias("users"))
    close = F.abs(F.col("about") - F.col("users")) <= sketches.distinct_error() * F.col("users") + 1
    return exact.join(told, ["event_type", "week"]).select("event_type", "week", "users", close.alias("within"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n, round(sum(value), 6) AS total, max(value) AS highest FROM s GROUP BY user_id, session""")
def q_sessions(spark, sf_dir):
    """Sessions of users, less than six hours between events: the batch form of the stream of the same name."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    found = stateful.sessions(events, "user_id", "ts", "value", "6 hours")
    return found.select("user_id", "session_start", "session_end", "n", F.round("total", 6).alias("total"), "highest")
