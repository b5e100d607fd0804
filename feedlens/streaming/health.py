"""Structured Streaming versions of the health counters and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators.health import counters, merge_counters


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events in a folder of Parquet files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(path)


def merge_health(stream: DataFrame, state_path: str, checkpoint: str, threshold: int = 10):
    """Merges each micro-batch's counters into a versioned state table; a repeated batch writes the same version."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{state_path}/v{batch_id - 1}") if batch_id else None
        merge_counters(old, counters(batch, threshold), threshold).write.mode("overwrite").parquet(f"{state_path}/v{batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health_now(stream: DataFrame, path: str, threshold: int = 10) -> DataFrame | None:
    """Runs the stream over all that is there and returns the state (None without events)."""
    run = merge_health(stream, f"{path}/state", f"{path}/progress", threshold)
    run.awaitTermination()
    done = [p.batchId for p in run.recentProgress if p.numInputRows > 0]
    return stream.sparkSession.read.parquet(f"{path}/state/v{max(done)}") if done else None


def hourly_status(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Fetches per source, status and hour, with a watermark for late ones."""
    timed = stream.withColumn("at", F.col("collected_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 hour").alias("hour"), "source", "fetch_status").agg(F.count("*").alias("n"))
