"""Streaming intake of audit logs. An extension: logs only grow, so that a stream follows them naturally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.audit import EVENT


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of the NDJSON files that arrive under path, with their time; lines that are no JSON have null fields."""
    lines = spark.readStream.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", EVENT).alias("e")).select("e.*", F.to_timestamp(F.col("e.ts")).alias("at"))


def findings_by_kind(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings by window of time and kind; events later than ``late`` are left out."""
    found = events.where("event = 'finding'").withWatermark("at", late)
    return found.groupBy(F.window("at", window), "kind").agg(F.count("*").alias("n")).select("window.start", "window.end", "kind", "n")
