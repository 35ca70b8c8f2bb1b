"""Event-time windows on streams: tumbling, sliding and session windows with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, ts: str, late: str, width: str, slide: str | None = None, keys: list[str] | None = None, **aggs: Column) -> DataFrame:
    """Aggregates by time window (and keys); rows later than the watermark are dropped by Spark."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *(keys or [])).agg(*[a.alias(n) for n, a in aggs.items()])


def sessions(events: DataFrame, ts: str, late: str, gap: str, keys: list[str], **aggs: Column) -> DataFrame:
    """Aggregates by session: runs of events with no pause of ``gap`` or more."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])


def first_seen(events: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The stream without repeated keys within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def flat(df: DataFrame) -> DataFrame:
    """Window bounds as two timestamp columns."""
    rest = [c for c in df.columns if c != "w"]
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *rest)
