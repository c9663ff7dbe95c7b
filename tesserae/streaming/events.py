"""Windowed and mergeable aggregates over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_window(events: DataFrame, late: str | None = None) -> DataFrame:
    """Count and value statistics by day and type; `late`: how long a stream waits for late events."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = held.withWatermark("ts", late) if late else held
    grouped = held.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return grouped.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total", "most")


def read_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def mergeable(events: DataFrame) -> DataFrame:
    """Sums that merge by adding: what a batch adds to the running error metrics."""
    return events.groupBy("event_type").agg(F.count("value").alias("n"), F.sum("value").alias("s1"), F.sum(F.abs("value")).alias("sa"), F.sum(F.col("value") * F.col("value")).alias("s2"))


def finish(sums: DataFrame) -> DataFrame:
    """Metrics of any union of mergeable sums."""
    total = sums.groupBy("event_type").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "sa", "s2")])
    return total.select("event_type", "n", F.try_divide("s1", "n").alias("bias"), F.try_divide("sa", "n").alias("mae"), F.sqrt(F.try_divide("s2", "n")).alias("rmse"))


def stream_metrics(stream: DataFrame, sums_path: str, checkpoint: str):
    """Run a stream to its end, each micro-batch adding its sums under its own number; safe to repeat."""

    def write(batch: DataFrame, number: int) -> None:
        mergeable(batch).write.mode("overwrite").parquet(f"{sums_path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
