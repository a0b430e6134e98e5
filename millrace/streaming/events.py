"""Windowed counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by hour and type; batch and stream alike, with late data dropped after the watermark on a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("cnt")).select(F.date_format("w.start", "yyyyMMddHH").alias("hr"), "event_type", "cnt")


def run_hourly(spark: SparkSession, source: str, sink: str, checkpoint: str) -> None:
    """Read what is there of a Parquet stream, append closed hours to the sink, and stop."""
    schema = spark.read.parquet(source).schema
    stream = hourly_counts(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query("SELECT strftime(date_trunc('hour', ts), '%Y%m%d%H') AS hr, event_type, count(*) AS cnt FROM events GROUP BY 1, 2")
def hourly_event_counts(t):
    return hourly_counts(t.events)
