"""The star-schema tables, and the stand-in relations that the conformance queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns that decide which of the lines that share order and number stands for them, in order.
_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity"]


def gate_rows(spark: SparkSession, sf_dir: str, upto: str = "l_suppkey", n_parts: int | None = None) -> DataFrame:
    """One gate row per order and line number. Lines that share both are reduced to the least in a fixed order of columns.

    Only the columns of that order up to the last one needed are read, as those behind it can't change what
    the others are. Lines are dealt by their order once: grouping by line, and any later grouping by record, find them together.
    n_parts: to so many tasks, whatever the size of what they get.
    """
    used = _LINE_ORDER[: _LINE_ORDER.index(upto) + 1]
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *used)
    line = line.repartition(n_parts, "l_orderkey") if n_parts else line.repartition("l_orderkey")
    rows = line.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*used)).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    family = F.when(F.col("l_linenumber") <= 3, "validity").when(F.col("l_linenumber") <= 5, "substantive").otherwise("precision")
    part = F.col("l_partkey")
    status = F.when(part % 97 == 0, "invalid").when(part % 89 == 0, "missing").when(part % 11 == 0, "fail").otherwise("pass")
    reviewer = [F.col("l_suppkey").alias("reviewer")] if "l_suppkey" in used else []
    return rows.select(
        F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("gate_ord"), family.alias("family"), status.alias("status"), *reviewer,
        part.alias("evidence_id"), F.col("l_shipdate").alias("reviewed_at"), *used[3:],
    )


GATES_SQL = """
gates AS (
    SELECT l_orderkey AS record_id, l_linenumber AS gate_ord,
           CASE WHEN l_linenumber <= 3 THEN 'validity' WHEN l_linenumber <= 5 THEN 'substantive' ELSE 'precision' END AS family,
           CASE WHEN l_partkey % 97 = 0 THEN 'invalid' WHEN l_partkey % 89 = 0 THEN 'missing' WHEN l_partkey % 11 = 0 THEN 'fail' ELSE 'pass' END AS status,
           l_suppkey AS reviewer, l_partkey AS evidence_id, l_shipdate AS reviewed_at, l_quantity, l_extendedprice, l_discount, l_tax
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                 ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity) AS place FROM lineitem)
    WHERE place = 1
)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a supplier: months, with the mean percentage by which discount exceeds tax."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.avg(100 * (F.col("l_discount") - F.col("l_tax"))).alias("value"))


BLOCKS_SQL = """
blocks AS (
    SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, avg(100 * (l_discount - l_tax)) AS value
    FROM lineitem GROUP BY 1, 2
)"""
