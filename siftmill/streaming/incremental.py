"""Incremental work: what is new since a run, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def stream_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], key: str):
    """A query that takes new Parquet files of ``source``, leaves out keys that ``sink`` has, applies
    ``step`` and appends. Batches are exactly-once by the checkpoint and the keys."""
    rows = spark.readStream.schema(schema).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        try:
            done = spark.read.parquet(sink).select(key)
            batch = unprocessed(batch, done, key)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
        step(batch.dropDuplicates([key])).write.mode("append").parquet(sink)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window of ``ts``, for batches and streams alike."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("ts", late) if events.isStreaming else stamped
    return stamped.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
