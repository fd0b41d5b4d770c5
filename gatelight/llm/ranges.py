"""Range partitions with known bounds, so that each row's place in the whole order is known while it streams by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that bounds are chosen from, for each range. The bounds decide only how even the ranges are.
SAMPLE_PER_RANGE = 60


def split(rows: DataFrame, keys: list[str], size: str, n_ranges: int) -> tuple[DataFrame, list[int]]:
    """Rows with range_, a number that grows with the keys, and the sum of the column size before each range.

    Bounds come from a bounded sample of the keys; sums come from all rows. Rows with equal keys share a range.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    key = F.struct(*keys)
    total = rows.count()
    share = min(1.0, n_ranges * SAMPLE_PER_RANGE / max(1, total))
    sample = rows.select(*keys).sample(share, seed=11).orderBy(*order).limit(2 * n_ranges * SAMPLE_PER_RANGE).collect()
    picks = list(dict.fromkeys(sample[len(sample) * k // n_ranges] for k in range(1, n_ranges))) if sample else []
    kinds = [rows.schema[k].dataType for k in keys]
    if picks:
        bounds = [F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, pick, kinds)]) for pick in picks]

        def search(low: int, high: int):
            """The number of bounds up to the key, by halves: as many comparisons as the number has bits."""
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(key >= bounds[middle], search(middle + 1, high)).otherwise(search(low, middle))

        place = search(0, len(picks))
    else:
        place = F.lit(0)
    marked = rows.withColumn("range_", place)
    sums = {r["range_"]: r["n"] for r in marked.groupBy("range_").agg(F.sum(size).alias("n")).collect()}
    before, at = [], 0
    for k in range(len(picks) + 1):
        before.append(at)
        at += sums.get(k, 0) or 0
    return marked, [*before, at]


def in_order(marked: DataFrame, keys: list[str], n_ranges: int) -> DataFrame:
    """The rows of each range in one partition of its own, in the order of the keys."""
    return marked.repartitionById(n_ranges, "range_").sortWithinPartitions("range_", *[F.col(k).asc_nulls_first() for k in keys])
