"""Label updates and generation events as streams. Not needed by any batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinlens.operators.updates import FIELDS, combine

SCHEMA = "ord bigint, label_uid string, " + ", ".join(f"{f} string" for f in FIELDS) + ", submitted_at timestamp"


def read_update_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def store_updates(updates: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Combines each batch per label and writes it under its batch number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        combine(batch).drop("conflicts").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per type and window of event time; rows later than the watermark are dropped. events: ts timestamp, event_type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "event_type", "events")
