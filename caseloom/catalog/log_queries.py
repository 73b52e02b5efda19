"""Prediction-log metrics, in batch and as streams, with the events table as the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog.base import query, table
from caseloom.session import work_path
from caseloom.sources import tables
from caseloom.streaming import predlog


def _log(df):
    return df.select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("predicted_label"), F.col("value").alias("latency_ms")
    )


def _log_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return _log(predlog.file_stream(spark, sf, schema, glob="events.parquet"))


@query(
    "log_metrics",
    """SELECT count(*) AS total_predictions, round(avg(value), 3) AS avg_latency_ms, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1) AS span_seconds,
  (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) AS classes FROM events""",
)
def log_metrics(spark, sf):
    m = tables.log_metrics(_log(table(spark, sf, "events")))
    pairs = F.transform(F.map_entries("class_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("total_predictions", "avg_latency_ms", "span_seconds", F.array_join(pairs, ",").alias("classes"))


@query(
    "log_running_counts",
    "SELECT event_type AS label, count(*) AS n, round(sum(value), 4) AS latency_sum, count(value) AS timed FROM events GROUP BY 1",
)
def log_running_counts(spark, sf):
    """Counters per class kept by a stream, durable through its checkpoint."""
    out, state = work_path(spark, "counts"), work_path(spark, "counts-state")
    predlog.drain(lambda: predlog.write_versions(predlog.running_counts(_log_stream(spark, sf)), out, state))
    return predlog.newest_version(spark, out).withColumn("latency_sum", F.round("latency_sum", 4))


@query(
    "log_windowed_counts",
    "SELECT date_trunc('day', ts) AS window_start, event_type AS label, count(*) AS n, round(sum(value), 4) AS latency_sum FROM events GROUP BY ALL",
)
def log_windowed_counts(spark, sf):
    """Daily counts per class, all windows shown."""
    out, state = work_path(spark, "windows"), work_path(spark, "windows-state")
    predlog.drain(lambda: predlog.write_versions(predlog.windowed_counts(_log_stream(spark, sf)), out, state))
    return predlog.newest_version(spark, out).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "label", "n", F.round("latency_sum", 4).alias("latency_sum")
    )


@query(
    "log_closed_windows",
    """WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type AS label, count(*) AS n, round(sum(value), 4) AS latency_sum FROM events GROUP BY ALL)
SELECT * FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def log_closed_windows(spark, sf):
    """Only windows the watermark has closed, each written once."""
    out, state = work_path(spark, "closed"), work_path(spark, "closed-state")
    predlog.drain(lambda: predlog.append_rows(predlog.windowed_counts(_log_stream(spark, sf)), out, state))
    return spark.read.parquet(out).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "label", "n", F.round("latency_sum", 4).alias("latency_sum")
    )
