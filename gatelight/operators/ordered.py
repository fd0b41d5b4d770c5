"""Rows in order within keys of any size: numbers, earlier values, running totals and last values, without one task for one key.

Rows are dealt in ranges of (keys, order) by Spark's sampled range partitioning, so that a key with many rows spans many ranges, and
written once, which fixes the ranges. Windows work within one key and range. What each range ends with (its totals, its last row) is one row for each key
and range; these few rows are folded in order, and every range gets what all earlier ranges of its key hand on. A border between ranges
divides one key at most, so these rows are fewer than the ranges. With more rows there are more ranges and tasks, of ROWS rows each.

Rows that are equal in keys and order have no defined order among themselves: order should end with a unique column. Null keys are keys like others; null order values come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.sources import shared

RANGE = "range_"
#: Rows of a range or task on average, once there are more than the session's number of shuffle partitions holds.
ROWS = 500_000


def tasks_for(spark, n_rows: int) -> int | None:
    """How many tasks n_rows are divided over: None, so that Spark decides, unless the session's number is too small."""
    needed = -(-n_rows // ROWS)
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, n: int | None, *by: str) -> DataFrame:
    """The rows with equal by in one of n tasks, or of as many as Spark decides."""
    return rows.repartition(n, *by) if n else rows.repartition(*by)


def in_ranges(rows: DataFrame, by: list[str], order: list[str], n_ranges: int | None = None) -> DataFrame:
    """The rows with range_, written. Later ranges of a key hold later rows."""
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    divided = rows.repartitionByRange(n_ranges, *keys) if n_ranges else rows.repartitionByRange(*keys)
    return shared.written(divided.withColumn(RANGE, F.spark_partition_id()), "ranges")[0]


def running(
    rows: DataFrame,
    by: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    highs: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    n_ranges: int | None = None,
) -> DataFrame:
    """rows with new columns: over all rows of the key up to and with the own one, sums and highs (the greatest value), which skip nulls, and lasts
    (the last value that is not null); and lags, the value of the row before, null for a key's first row. Sums of nothing are 0."""
    sums, highs, lasts, lags = sums or {}, highs or {}, lasts or {}, lags or {}
    names = [*sums, *highs, *lasts, *lags]
    values = {f"{name}_in": col for name, col in (sums | highs | lasts | lags).items()}
    n_ranges = n_ranges or tasks_for(rows.sparkSession, rows.count())
    ranged = dealt(in_ranges(rows.withColumns(values), by, order, n_ranges), n_ranges, *by, RANGE)
    last = lambda name, on=None: F.max_by(f"{name}_in", F.struct(*order) if on is None else F.when(on, F.struct(*order)))
    ends = ranged.groupBy(*by, RANGE).agg(
        *[F.coalesce(F.sum(f"{n}_in"), F.lit(0)).alias(n) for n in sums],
        *[F.max(f"{n}_in").alias(n) for n in highs],
        *[last(n, F.col(f"{n}_in").isNotNull()).alias(n) for n in lasts],
        *[last(n).alias(n) for n in lags],
    )
    across = Window.partitionBy(*by).orderBy(RANGE)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        *[F.col(c).alias(f"{c}_of") for c in (*by, RANGE)],
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums],
        *[F.max(n).over(earlier).alias(f"{n}_before") for n in highs],
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"{n}_before") for n in lasts],
        *[F.lag(n).over(across).alias(f"{n}_before") for n in lags],
        (F.row_number().over(across) > 1).alias("handed_"),
    ).filter("handed_").drop("handed_")
    inside = Window.partitionBy(*by, RANGE).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.select(
        "*",
        F.row_number().over(inside).alias("place_in"),
        *[F.coalesce(F.sum(f"{n}_in").over(upto), F.lit(0)).alias(f"{n}_own") for n in sums],
        *[F.max(f"{n}_in").over(upto).alias(f"{n}_own") for n in highs],
        *[F.last(f"{n}_in", ignorenulls=True).over(upto).alias(f"{n}_own") for n in lasts],
        *[F.lag(f"{n}_in").over(inside).alias(f"{n}_own") for n in lags],
    )
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*by, RANGE)]
    before, mine = (lambda n: F.col(f"{n}_before")), (lambda n: F.col(f"{n}_own"))
    out = own.join(F.broadcast(handed), same, "left").withColumns(
        {n: F.coalesce(before(n), F.lit(0)) + mine(n) for n in sums}
        | {n: F.greatest(before(n), mine(n)) for n in highs}
        | {n: F.coalesce(mine(n), before(n)) for n in lasts}
        | {n: F.when(F.col("place_in") == 1, before(n)).otherwise(mine(n)) for n in lags}
    )
    return out.select(*rows.columns, *names)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str, values: dict[str, str], n_ranges: int | None = None) -> DataFrame:
    """left with the values (new name to column of right) of the last row of right with equal keys and an at up to the own one.

    Of right's rows with one at, that with the greatest tie counts; it must not be null. Rows of left without such a row, and those with a null key or at, get nulls. Both sides go in one order: the
    cost is that of their rows, however many rows of right precede one of left.
    """
    fields = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    a = left.select(*by, F.col(at), F.lit(1).alias("side_"), F.lit(None).cast(right.schema[tie].dataType).alias("tie_"), F.struct(*left.columns).alias("row_"))
    b = right.select(*by, F.col(at), F.lit(0).alias("side_"), F.col(tie).alias("tie_"), fields.alias("found_")).dropna(subset=[*by, at])
    both = a.unionByName(b, allowMissingColumns=True)
    filled = running(both, by, [at, "side_", "tie_"], lasts={"last_": F.col("found_")}, n_ranges=n_ranges).filter("side_ = 1")
    known = F.col(at).isNotNull()
    return filled.select("row_.*", *[F.when(known, F.col(f"last_.{n}")).alias(n) for n in values])


def within_after(events: DataFrame, by: list[str], at: str, item: str, width: int, n_ranges: int | None = None) -> DataFrame:
    """events (item unique, at a whole number) with n and highest: how many events of the same keys have an at in (own, own + width], and their greatest item, null for none.

    Time is cut into stretches of width. A window is the end of one stretch, after the own at, and the beginning of the next one,
    up to at + width: two running totals, one backwards and one forwards, so that the cost is that of the rows and not of
    pairs. Null keys match nothing.
    """
    stretch = F.floor(F.col(at) / width)
    known = events.select(*by, at, item)
    part = lambda back, asks, value, own_stretch: known.select(*by, item, F.lit(back).alias("back_"), F.lit(asks).alias("asks_"), value.alias("v_"), own_stretch.alias("stretch_"))
    time = F.col(at)
    union = part(True, False, -time, stretch).unionByName(part(True, True, -time, stretch)).unionByName(part(False, False, time, stretch)).unionByName(part(False, True, time + width, stretch + 1))
    # Backwards a question comes before the events of its own time, forwards behind them.
    union = union.withColumn("side_", (F.col("back_") != F.col("asks_")).cast("int"))
    counted = ~F.col("asks_")
    totals = running(union, [*by, "stretch_", "back_"], ["v_", "side_", item], sums={"n": F.when(counted, 1).otherwise(0)}, highs={"highest": F.when(counted, F.col(item))}, n_ranges=n_ranges)
    answers = totals.filter("asks_").groupBy(item).agg(F.sum("n").alias("n"), F.max("highest").alias("highest"))
    matched = F.lit(True)
    for c in by:
        matched &= F.col(c).isNotNull()
    out = events.join(answers, item, "left")
    return out.select(*events.columns, F.when(matched, F.col("n")).otherwise(0).alias("n"), F.when(matched, F.col("highest")).alias("highest"))
