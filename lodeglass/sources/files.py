"""Source trees as tables: discovery with ignore rules, contents, states, and listings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.functions.hashing import content_fingerprint, integrity_hash
from lodeglass.functions.languages import language_of
from lodeglass.functions.text import dirname, glob_regex, path_matches
from lodeglass.schema import Limits

# Folders that are never read, and the names of configuration files that are no source.
SKIPPED_FOLDERS = (".git", ".next", ".turbo", ".vercel", ".codeintel", "coverage", "dist", "node_modules")


def _relative(path: Column, root: str) -> Column:
    base = re.sub(r"/+$", "", root if root.startswith("/") else re.sub(r"^file:(//)?", "", root))
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), "^" + re.escape(base) + "/+", "")


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(ignored, regular expression) of the lines of an ignore file, in order; the last match decides."""
    out = []
    for line in text.splitlines():
        rule = line.rstrip()
        if not rule.strip() or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        rule = rule[1:] if negated else rule
        anchored = "/" in rule.rstrip("/")
        body = glob_regex(rule.strip("/"))[1:-1]
        inside = "/.*" if rule.endswith("/") else "(?:/.*)?"
        out.append((not negated, ("^" if anchored else "^(?:.*/)?") + body + inside + "$"))
    return out


def ignored(path: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    """Whether the rules ignore a path."""
    out = F.lit(False)
    for yes, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(yes)).otherwise(out)
    return out


def listing(spark: SparkSession, root: str, *, skipped: Sequence[str] = SKIPPED_FOLDERS, rules: Sequence[tuple[bool, str]] = ()) -> DataFrame:
    """path, size_bytes and mtime_ms of all files below a root, of any kind, without the skipped folders and ignored
    paths. Contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = raw.select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") / 1000).cast("bigint").alias("mtime_ms"))
    inside = "(?:^|/)(?:" + "|".join(map(re.escape, skipped)) + ")/"
    return rows.where(~F.col("path").rlike(inside) & ~ignored(F.col("path"), rules))


def discover(spark: SparkSession, root: str, *, include: Sequence[str] = (), exclude: Sequence[str] = (), rules: Sequence[tuple[bool, str]] = (), config_names: Sequence[str] = (), limits: Limits = Limits()) -> DataFrame:
    """path, language, size_bytes and mtime_ms of the files to index: those with a known extension, not too large, that
    the globs allow. A ValueError if there are more than the limit of files."""
    rows = listing(spark, root, rules=rules).withColumn("language", language_of("path"))
    found = rows.where(F.col("language").isNotNull() & (F.col("size_bytes") <= limits.file_bytes) & path_matches("path", include, exclude))
    if config_names:
        found = found.where(~F.col("path").isin(*config_names))
    if found.limit(limits.files_discovered + 1).count() > limits.files_discovered:
        raise ValueError(f"more than {limits.files_discovered} files; narrow the globs")
    return found.select("path", "language", "size_bytes", "mtime_ms")


def supported_files(spark: SparkSession, root: str, **options) -> DataFrame:
    return discover(spark, root, **options).select("path")


def read_contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """path and content, decoded as UTF-8, of the files of a listing (column path)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = raw.select(_relative(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("content"))
    return text.join(paths.select("path"), "path", "left_semi")


def snapshot(contents: DataFrame) -> DataFrame:
    """path, content_hash and integrity_hash of contents."""
    return contents.select("path", content_fingerprint("content").alias("content_hash"), integrity_hash("content").alias("integrity_hash"))


def file_states(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, mtime_ms and size_bytes of the files to index."""
    return discover(spark, root, **options).select("path", "mtime_ms", "size_bytes")


def folder_states(states: DataFrame) -> DataFrame:
    """path and mtime_ms of folders, as of the last change of a file directly in them."""
    return states.groupBy(dirname("path").alias("path")).agg(F.max("mtime_ms").alias("mtime_ms"))
