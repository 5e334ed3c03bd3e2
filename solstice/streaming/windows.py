"""Watermarked N-day means over an event stream (I5, re-aim of E1/E4).

``withWatermark`` bounds the state: a window is finalised once the event
time has moved ``lateness`` past its end, and rows later than that are not
counted.  Output mode *update* into a keyed upsert keeps the result table
complete at the end of an ``availableNow`` run (append mode would hold back
windows that the watermark has not yet closed).  Sliding windows start at
UTC day boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.streaming.ingest import upsert_partitions


def windowed_means(events: DataFrame, n_days: int, key: str = "event_type", ts: str = "ts",
                   value: str = "value", lateness: str = "5 days") -> DataFrame:
    """Streaming (or batch) DataFrame of (key, window_start, window_end, mean, n)."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    g = e.groupBy(F.window("_ts", f"{n_days} days", "1 day").alias("w"), F.col(key)).agg(
        F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    return g.select(key, F.col("w.start").cast("date").alias("window_start"),
                    F.col("w.end").cast("date").alias("window_end"), "mean_value", "n")


def start_windowed_means(spark: SparkSession, landing: str, schema, n_days: int, table: str, checkpoint: str,
                         key: str = "event_type", lateness: str = "5 days", max_files: int | None = None):
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    agg = windowed_means(reader.parquet(landing), n_days, key=key, lateness=lateness)

    def each(batch: DataFrame, epoch_id: int) -> None:
        upsert_partitions(batch.sparkSession, batch, table, [key, "window_start"], [key])

    return (agg.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
