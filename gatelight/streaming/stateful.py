"""Streams with state: sessions by event time, gaps and areas of ordered samples, and copied digests across micro-batches.

A stream gives what a batch over the same rows gives, in whatever order they arrive, as long as none is later than the watermark allows. Rows that are later are dropped and counted (`late_rows`). State is
in Spark's state store, so a query that is started anew from its checkpoint goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatelight.operators import ordered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessions(events: DataFrame, key: str, at: str, value: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """key, session_start, session_end (the last event plus the gap), n, total, highest: runs of events less than a gap apart, of a stream or a batch.

    A stream gives a session once the watermark, delay behind the latest event, has passed its end. Rows without a time belong to none; a null key is a key.
    """
    marked = events.withWatermark(at, delay) if events.isStreaming else events
    window = F.session_window(at, gap)
    out = marked.groupBy(key, window).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("highest"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "total", "highest")


def late_rows(query: StreamingQuery) -> int:
    """How many rows the query's recent batches have dropped because they were later than the watermark."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])


GAP_ROWS = "{key} {kind}, item long, at timestamp, gap_us long, area double"


def gaps(events: DataFrame, key: str, at: str, item: str, value: str) -> DataFrame:
    """key, item, at, gap_us (since the key's sample before) and area (the trapezoid between both) of each sample of a batch; null for a key's first."""
    time = F.unix_micros(F.col(at))
    rows = events.select(key, F.col(item).cast("long").alias("item"), F.col(at).alias("at"), time.alias("t"), F.col(value).alias("v"))
    found = ordered.running(rows, [key], ["t", "item"], lags={"t0": F.col("t"), "v0": F.col("v")})
    return found.select(key, "item", "at", (F.col("t") - F.col("t0")).alias("gap_us"), ((F.col("v") + F.col("v0")) / 2 * ((F.col("t") - F.col("t0")) / 1e6)).alias("area"))


def gap_stream(events: DataFrame, key: str, at: str, item: str, value: str, delay: str = "1 hour") -> DataFrame:
    """The rows of gaps() for a stream: samples wait in the state until the watermark has passed them, and then go in order.

    What waits is what arrived within the delay; of earlier samples only the last one is kept. Null keys are one key.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col(item).cast("long").alias("item"), F.col(at).alias("at"), F.col(value).cast("double").alias("v")).withWatermark("at", delay)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_at, last_v, waiting = state.get if state.exists else (None, None, [])
        waiting = [tuple(x) for x in waiting]
        for batch in batches:
            waiting += zip(batch["at"].astype("datetime64[us]").astype("int64").tolist(), batch["item"].tolist(), batch["v"].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready = [x for x in waiting if x[0] <= passed]
        waiting = waiting[len(ready) :]
        out = []
        for t, number, v in ready:
            first = last_at is None
            out.append((name[0], number, t, None if first else t - last_at, None if first else (v + last_v) / 2 * ((t - last_at) / 1e6)))
            last_at, last_v = t, v
        state.update((last_at, last_v, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        found = pd.DataFrame(out, columns=["key", "item", "at", "gap_us", "area"])
        found["at"] = pd.to_datetime(found["at"], unit="us")
        yield found.astype({"gap_us": "Int64"})

    kept = "last_at long, last_v double, waiting array<struct<at:long,item:long,v:double>>"
    made = rows.groupBy("key").applyInPandasWithState(step, GAP_ROWS.format(key="key", kind=kind), kept, "append", GroupStateTimeout.EventTimeTimeout)
    return made.withColumnRenamed("key", key)


class _LastUse(StatefulProcessor):
    """The id that a digest was last used under, and the place of that use."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "place long, evidence string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        used = pd.concat(list(rows)).sort_values(["place", "evidence"], kind="stable")
        before = self.last.get()[1] if self.last.exists() else None
        prior = [before, *used["evidence"].tolist()[:-1]]
        self.last.update((int(used["place"].iloc[-1]), used["evidence"].iloc[-1]))
        priors = [None if p == e else p for p, e in zip(prior, used["evidence"])]
        yield pd.DataFrame({"digest": key[0], "place": used["place"].to_numpy(), "evidence": used["evidence"].to_numpy(), "prior_id": pd.Series(priors, dtype="object").to_numpy()})

    def close(self) -> None:
        pass


def copied_digest_stream(used: DataFrame, digest: Column, evidence: str, place: str, ttl: int = 30 * 86_400) -> DataFrame:
    """digest, place, evidence and prior_id (the id under which the digest was used just before, if another one) of records as they arrive.

    Order is that of arrival, and of place within a micro-batch; a batch over all records gives the same rows if places grow with arrival. A digest
    that isn't used for ttl seconds is forgotten. Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`). Rows without a digest are left out.
    A run over what is there (`availableNow`) ends only if `spark.sql.streaming.noDataMicroBatches.enabled` is false, as state that can expire asks for empty batches.
    """
    rows = used.select(digest.alias("digest"), F.col(place).cast("long").alias("place"), F.col(evidence).cast("string").alias("evidence")).filter("digest IS NOT NULL")
    return rows.groupBy("digest").transformWithStateInPandas(_LastUse(1000 * ttl), "digest string, place long, evidence string, prior_id string", "Append", "ProcessingTime")
