"""Event log as lines of JSON: sanitised on the way in, tolerant on the way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.functions.privacy import sanitize_event_data
from lodeglass.operators.report import recent_events
from lodeglass.schema import EVENTS


def write_events(events: DataFrame, path: str, *, redact_source_text: bool = True, days: int = 3, now: Column | None = None) -> None:
    """Append events without secrets (and source text), leaving out what is older than some days."""
    clean = recent_events(events, days, now).withColumn("data", sanitize_event_data("data", redact_source_text))
    clean.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log; lines that are no JSON or have no event are left out."""
    lines = spark.read.text(path)
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", EVENTS).alias("e"))
    return parsed.where("e.event is not null").select("e.*")


def last_events(events: DataFrame, n: int) -> DataFrame:
    """The n latest events, one at least."""
    return events.orderBy(F.col("ts").desc_nulls_last(), F.col("id").desc()).limit(max(1, n))
