"""Classification of records as they arrive: an extension, as one record never needs another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gatelight.plans.classify import classify
from gatelight.sources import shared

RECORDS = "record_key string, record string, manifest_key string"


def record_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Parquet files of records that appear in a folder."""
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", per_batch).parquet(folder)


def classify_stream(records: DataFrame, manifests: DataFrame, files: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch's classifications to a Parquet folder, once per batch: a batch that is run again
    replaces its own folder."""

    def store(batch: DataFrame, number: int) -> None:
        with shared.all_go(batch.sparkSession):
            classify(batch, manifests, files).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
