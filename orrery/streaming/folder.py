"""Structure files as a stream: new files of a folder are predicted as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of scored points (item, id, x, y, z, score) as they appear."""
    return spark.readStream.schema("item string, id long, x double, y double, z double, score double").parquet(folder)


def for_each_arrival(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start a query that writes handle(batch) for each batch under out/batch=<n>.

    A batch that is run again after a failure overwrites its own folder, so results are
    written once.
    """

    def write(batch: DataFrame, n: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value per type and window of time, with a watermark."""
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", user: str = "user_id") -> DataFrame:
    """Events of each user without a longer gap between them: begin, end (a gap after the last), number and total value."""
    ts = F.col("ts").cast("timestamp")
    x = events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(user, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "total")
