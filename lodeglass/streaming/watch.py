"""Change feeds, debouncing and refreshes as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeglass.operators.health import snapshot_drift
from lodeglass.sources.files import listing

CHANGES = "root string, path string, kind string, at timestamp"


def sweep(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and kind (new, changed, deleted) between two states (path, mtime_ms, size_bytes)."""
    mark = F.concat_ws(":", F.col("mtime_ms").cast("string"), F.col("size_bytes").cast("string"))
    drift = snapshot_drift(before.select("path", mark.alias("content_hash")), now.select("path", mark.alias("content_hash")))
    return drift.select("path", F.when(F.col("state") == "missing", "deleted").when(F.col("state") == "extra", "new").otherwise("changed").alias("kind"))


def poll(spark: SparkSession, root: str, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What changed below a root since a state, and the state now."""
    now = listing(spark, root)
    return sweep(before, now), now


def change_feed(spark: SparkSession, folder: str, schema: str = CHANGES, per_trigger: int = 100) -> DataFrame:
    """Change events as files of JSON lines dropped into a folder; times carry a zone, as watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def debounced(changes: DataFrame, gap_ms: int = 100, late: str = "1 minute") -> DataFrame:
    """Bursts of changes below each root that end when nothing happens there for gap_ms: root, first_at, last_at, the
    sorted distinct paths, and events. A burst comes out once, when no event can belong to it any more."""
    calm = changes.withWatermark("at", late).groupBy("root", F.session_window("at", f"{gap_ms} milliseconds").alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("events"))
    return calm.select("root", F.col("w.start").alias("first_at"), F.col("w.end").alias("last_at"), "paths", "events")


def poll_interval(debounce_ms: int) -> int:
    """Milliseconds between sweeps: the debounce, but 50 at least and 250 at most."""
    return min(250, max(50, debounce_ms))


def watch(changes: DataFrame, on_paths: Callable[[DataFrame, int], None], checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Call on_paths(paths, batch) with the distinct changed paths (path, kind of the last change) of every micro-batch.

    A failed batch is replayed with the same paths, as long as on_paths may run twice for one batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("kind", "at").alias("kind"))
        if not last.isEmpty():
            on_paths(last, number)

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "100 milliseconds"})).start()


def report_stream(events: DataFrame, *, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls, bands and mean duration of finished calls per window of event time, each window once it is closed."""
    ms = F.try_element_at("data", F.lit("durationMs")).try_cast("double")
    done = events.withWatermark("ts", late).where(F.col("event") == "mcp.tool.finished")
    per = done.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("calls"), F.count_if(ms < 100).alias("under_100_ms"), F.count_if((ms >= 100) & (ms < 1000)).alias("under_1000_ms"), F.count_if(ms >= 1000).alias("over_1000_ms"), F.avg(ms).alias("mean_ms"))
    return per.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls", "under_100_ms", "under_1000_ms", "over_1000_ms", "mean_ms")


def distinct_changes(changes: DataFrame, late: str = "1 minute") -> DataFrame:
    """Changes without repeats of the same path and kind within the allowed lateness."""
    return changes.withWatermark("at", late).dropDuplicatesWithinWatermark(["path", "kind"])
