"""Running totals of a stream of events, an extension of our own: the reference resumes batches and has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame) -> DataFrame:
    """(event_type, hour, n, total) of a batch or a stream with ``ts``, ``event_type`` and ``value``."""
    return events.groupBy("event_type", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def start_hourly(events: DataFrame, out: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Appends each hour's totals to a Parquet table once the watermark has passed it; restarts go on where they were."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    totals = marked.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = totals.select("event_type", F.col("window.start").alias("hour"), "n", "total")
    return flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
