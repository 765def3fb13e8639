"""Streaming forms of the append-only tables: revisions and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; on a stream, events later than ``late`` are left out."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def latest_revisions(revisions: DataFrame) -> DataFrame:
    """The last revision of each document: (document_id, created_at, payload)."""
    return revisions.groupBy("document_id").agg(F.max_by("payload", "created_at").alias("payload"), F.max("created_at").alias("created_at"))
