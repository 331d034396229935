"""Stored tables: versions that are swapped as a whole, upserts, artifacts, bookmarks, metadata, and cache pruning."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The fields of an artifact's fingerprint, in the order of its key.
FINGERPRINT = ("content_hash", "language", "parser_version", "summary_strategy", "extraction_config_fingerprint", "dependency_analysis_version", "storage_schema_version")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, path_of = _filesystem(spark, path)
    p = path_of(path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename: readers see the old text or the new one."""
    fs, path_of = _filesystem(spark, path)
    fresh = path_of(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    target = path_of(path)
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(fresh, target):
        raise OSError(f"can't replace {path}")


def publish(df: DataFrame, root: str, partition_by: str | None = None) -> str:
    """Write a table as a new version and point to it. Readers keep the version they began with; a failed write leaves
    the old one in place. Old versions stay until vacuum."""
    version = uuid.uuid4().hex
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{root}/versions/{version}")
    _write_text(df.sparkSession, f"{root}/CURRENT", version)
    return version


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The published version of a table, or None."""
    version = _read_text(spark, f"{root}/CURRENT")
    return spark.read.parquet(f"{root}/versions/{version.strip()}") if version else None


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete all versions but the published one; how many there were."""
    fs, path_of = _filesystem(spark, root)
    keep = (_read_text(spark, f"{root}/CURRENT") or "").strip()
    folder = path_of(f"{root}/versions")
    gone = 0
    for s in fs.listStatus(folder) if fs.exists(folder) else []:
        if s.getPath().getName() != keep:
            fs.delete(s.getPath(), True)
            gone += 1
    return gone


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key isn't among the new ones, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per key the row of the latest time, ties by the greatest row; null times are earliest. Aggregated before the
    shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != at]
    return rows.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("m")).select(*keys, "m.*").select(*rows.columns)


def artifact_key() -> F.Column:
    """Key of an analysis by all that determines it."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*FINGERPRINT)), 256))


def resolve_artifacts(wanted: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The wanted analyses (columns of FINGERPRINT) with artifact_key and reused, whether a stored one will do."""
    known = artifacts.select("artifact_key", F.lit(True).alias("_known")).distinct()
    return wanted.withColumn("artifact_key", artifact_key()).join(known, "artifact_key", "left").withColumn("reused", F.coalesce("_known", F.lit(False))).drop("_known")


def add_artifacts(artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """The artifacts with those new ones whose key isn't there yet, one a key."""
    fresh = new.join(artifacts.select("artifact_key"), "artifact_key", "left_anti").dropDuplicates(["artifact_key"])
    return artifacts.unionByName(fresh, allowMissingColumns=True)


def best_artifacts(artifacts: DataFrame) -> DataFrame:
    """One row per key: the latest, and of equal times the one with the richer payload."""
    rest = [c for c in artifacts.columns if c not in ("artifact_key", "created_at")]
    richness = F.coalesce(F.length("parse_output_json"), F.lit(-1))
    return artifacts.groupBy("artifact_key").agg(F.max(F.struct("created_at", richness.alias("_n"), *rest)).alias("m")).select("artifact_key", "m.*").select(*artifacts.columns)


def resolve_bookmarks(bookmarks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bookmarks (name, symbol_id, ...) with status available or missing and where the symbol is now."""
    known = symbols.where("id is not null").select(F.col("id").alias("symbol_id"), "file_path", "start_line").distinct()
    return bookmarks.join(known, "symbol_id", "left").withColumn("status", F.when(F.col("file_path").isNull(), "missing").otherwise("available"))


def add_bookmark(bookmarks: DataFrame, name: str, symbol_id: str) -> DataFrame:
    """The bookmarks with one of this name, which replaces an older one."""
    if not name.strip() or len(name) > 120 or not symbol_id.strip():
        raise ValueError("a bookmark needs a name of at most 120 characters and a symbol id")
    new = bookmarks.sparkSession.createDataFrame([(name.strip(), symbol_id.strip())], "name string, symbol_id string")
    return upsert(bookmarks, new, ["name"])


def remove_bookmark(bookmarks: DataFrame, name: str) -> DataFrame:
    return bookmarks.where(F.col("name") != name)


# -- metadata beside a store


def write_meta(folder: str, meta: dict) -> None:
    """Metadata and the hash of its text, in two files."""
    os.makedirs(folder, exist_ok=True)
    text = json.dumps(meta, sort_keys=True)
    for name, content in (("meta.json", text), ("meta.sha256", hashlib.sha256(text.encode()).hexdigest())):
        fresh = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(fresh, "w") as f:
            f.write(content)
        os.replace(fresh, os.path.join(folder, name))


def meta_health(folder: str) -> tuple[str, dict | None]:
    """State (ok, missing, unreadable, missing-integrity, integrity-mismatch) and the metadata, where it can be trusted
    or at least read."""
    path, seal = os.path.join(folder, "meta.json"), os.path.join(folder, "meta.sha256")
    if not os.path.exists(path):
        return "missing", None
    with open(path) as f:
        text = f.read()
    try:
        meta = json.loads(text)
    except ValueError:
        return "unreadable", None
    if not isinstance(meta, dict):
        return "unreadable", None
    if not os.path.exists(seal):
        return "missing-integrity", meta
    with open(seal) as f:
        return ("ok" if f.read().strip() == hashlib.sha256(text.encode()).hexdigest() else "integrity-mismatch"), meta


# -- caches


def cache_status(entries: DataFrame) -> DataFrame:
    """One row: entries, bytes, and how many are in use. entries: key, bytes, used_at, active."""
    return entries.agg(F.count("*").cast("bigint").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"), F.count_if(F.col("active")).cast("bigint").alias("active"))


def prune_plan(entries: DataFrame, max_bytes: int, *, buckets: int = 64) -> DataFrame:
    """key and bytes of the entries to archive, oldest first, until the rest fits; those in use stay.

    The running sum is taken in two steps: sums of time ranges first, then within ranges, so that no task orders all
    entries.
    """
    total = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    idle = entries.where(~F.coalesce("active", F.lit(False))).select("key", "bytes", "used_at")
    edges = idle.agg(F.percentile_approx(F.unix_micros(F.col("used_at").cast("timestamp")), [k / buckets for k in range(1, buckets)], 10_000).alias("e"))
    placed = idle.join(F.broadcast(edges)).withColumn("_b", F.size(F.filter("e", lambda x: x < F.unix_micros(F.col("used_at").cast("timestamp"))))).drop("e")  # one row
    sums = placed.groupBy("_b").agg(F.sum("bytes").alias("s"))
    before = sums.select("_b", (F.sum("s").over(Window.orderBy("_b")) - F.col("s")).alias("_before"))  # one row a range
    inner = Window.partitionBy("_b").orderBy("used_at", "key").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("_inner", F.sum("bytes").over(inner)).join(F.broadcast(before), "_b").join(F.broadcast(total))  # ranges, and one row
    freed_before = F.col("_before") + F.col("_inner") - F.col("bytes")
    return running.where(F.col("total") - freed_before > max_bytes).select("key", "bytes")


def archive(plan: DataFrame, root: str, archive_root: str, *, dry_run: bool = True) -> list[str]:
    """Move the entries of a prune plan (key: a path below root) to the same place below archive_root; which they are.
    The driver reads one partition of keys at a time; a dry run moves nothing."""
    moved = []
    for row in plan.select("key").orderBy("key").toLocalIterator(prefetchPartitions=False):
        source, target = os.path.join(root, row["key"]), os.path.join(archive_root, row["key"])
        if os.path.exists(source):
            moved.append(row["key"])
            if not dry_run:
                os.makedirs(os.path.dirname(target), exist_ok=True)
                os.replace(source, target)
    return moved


def restore(root: str, archive_root: str, key: str) -> bool:
    """Bring an archived entry back, unless there is one in its place already."""
    source, target = os.path.join(archive_root, key), os.path.join(root, key)
    if not os.path.exists(source) or os.path.exists(target):
        return False
    os.makedirs(os.path.dirname(target), exist_ok=True)
    os.replace(source, target)
    return True
