"""Importance resampling of documents by hashed n-gram models, drawn by Gumbel top-k.

Two generative models over BUCKETS hashed word n-grams (one and two words) are counted: the target from
labelled documents of good quality, the raw model from every document of the corpus. A document's weight is
the mean log ratio of its n-grams times LENGTH: every document counts as if it had that many, since the plain sum grows with
length and so measures length first. Adding Gumbel noise to the weights and taking the k largest draws k
documents without replacement, with chances that follow the weights. The noise is a hash of the id and a seed, so
a draw can be repeated and doesn't depend on the order of rows or on partitions.

Counts are vectors of BUCKETS numbers for each task, summed in Spark: what a task and the driver hold is
bounded by BUCKETS, and what is counted grows with the corpus. The target is fitted on at most about max_target rows
(a documented bound). The k-th largest key is found by counting keys in ever finer ranges, RANGES at a
time, so no sort of all rows and no list of keys is needed.

Defined results. A null or empty text has no n-grams and weight 0. Rows that share a null id share their noise. Keys
that tie at the threshold are all drawn. Without good labels the ratio is 0 everywhere, and the draw is uniform.
Repeated rows each give a row. Columns besides the named ones are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm import scratch
from gatelight.llm.text import mix, words

BUCKETS, RANGES, LENGTH = 1 << 16, 4096, 100


def _grams(part) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of the n-grams of one and two words."""
    h, of = part.hashes, part.of
    two = mix(h[:-1] + mix(h[1:] + np.uint64(1)))[of[:-1] == of[1:]]
    codes = np.concatenate([h, two])
    return (codes % np.uint64(BUCKETS)).astype("i8"), np.concatenate([of, of[:-1][of[:-1] == of[1:]]])


def _counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def counted(batches):
        total = np.zeros(BUCKETS, "i8")
        for batch in batches:
            for part in words(batch.column(0), lower=True):
                total += np.bincount(_grams(part)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, "i8")
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, max_target: int = 20_000, smooth: float = 1.0) -> np.ndarray:
    """The log ratio of target to raw of every bucket. labels: doc_id, quality (1: target)."""
    scratch.bounded_batches(docs.sparkSession)
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    n_good = good.count()
    if not n_good:
        return np.zeros(BUCKETS)
    share = int(min(1.0, 0.95 * max_target / n_good) * (1 << 20))
    good = good.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    target = _counts(texts.join(good, "id", "left_semi").select("text")) + smooth
    raw = _counts(texts.select("text")) + smooth
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """doc_id, n_grams, log_weight, key (log_weight and Gumbel noise)."""
    scratch.bounded_batches(docs.sparkSession)
    noise = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52)).alias("noise")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), noise)

    def weighed(batches):
        for batch in batches:
            total, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows, "i8")
            for part in words(batch.column(1), lower=True):
                codes, of = _grams(part)
                n = part.last - part.first
                total[part.first : part.last] = np.bincount(of, ratios[codes], n)
                counts[part.first : part.last] = np.bincount(of, minlength=n)
            total *= LENGTH / np.maximum(1, counts)
            u = (batch.column(2).to_numpy() + 0.5) / (1 << 52)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(total), pa.array(total - np.log(-np.log(u)))], names=["doc_id", "n_grams", "log_weight", "key"])

    return rows.mapInArrow(weighed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_grams long, log_weight double, key double")


def kth_largest(rows: DataFrame, k: int) -> float:
    """The k-th largest value of key, exactly, by counts over ever finer ranges."""
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return low
    above = 0
    while low < high:
        step = (high - low) / RANGES
        if low + step <= low or high - step >= high:
            # No value between the two: the upper one, or the lower one if too few are there.
            return high if above + rows.filter(F.col("key") == high).count() >= k else low
        place = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(RANGES - 1))
        inside = rows.filter(F.col("key").between(low, high)).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for place_ in sorted(inside.collect(), key=lambda r: -r["place"]):
            if above + place_["n"] >= k:
                low, high = place_["low"], place_["high"]
                break
            above += place_["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 17) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept. share: part of the rows to draw; by default the part of the labels that is good."""
    found, _ = scratch.written(weights(docs, fit(docs, labels), seed=seed), "weights")
    if share is None:
        good, known = labels.agg(F.sum((F.col("quality") == 1).cast("int")), F.count("quality")).first()
        share = (good or 0) / known if known else 1.0
    limit = kth_largest(found, round(share * found.count()))
    return found.withColumn("kept", F.col("key") >= F.lit(limit))
