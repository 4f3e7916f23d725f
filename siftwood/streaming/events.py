"""Counts in windows and sessions over event streams: an extension that the index itself doesn't need.

Late events up to the watermark are counted; a session ends after a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE, GAP = "10 minutes", "30 minutes"


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The events of a folder or file as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    single = name.endswith(".parquet")  # a file, or a folder named like one
    reader = spark.readStream.schema(schema)
    rows = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, every: str = "1 hour", late: str | None = LATE) -> DataFrame:
    """starts, event_type, n and total of each window."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    told = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return told.select(F.col("w.start").alias("starts"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, length: str = "6 hours", step: str = "1 hour") -> DataFrame:
    told = events.groupBy(F.window("ts", length, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("about_users"))
    return told.select(F.col("w.start").alias("starts"), "n", "about_users")


def sessions(events: DataFrame, gap: str = GAP, late: str | None = LATE) -> DataFrame:
    """user_id, starts, ends and n of each stretch of events without a gap."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    told = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return told.select("user_id", F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")


def to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to a table until what is there is done; in complete mode the table is replaced with each batch."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(replace).start() if mode == "complete" else writer.format("parquet").option("path", path).start()
