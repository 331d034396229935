"""Building and refreshing an index: what to parse, what happened to each file, and the tables that follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.hashing import content_fingerprint, integrity_hash
from lodeglass.functions.imports import extract_imports
from lodeglass.operators.extract import fingerprints, parse_symbols
from lodeglass.operators.graph import CodeIndex, direct_importers, resolve_dependencies
from lodeglass.schema import Limits
from lodeglass.session import cut

# What can happen to a file.
OUTCOMES = ("unchanged", "content-unchanged", "reindexed", "symbol-limit-exceeded", "removed")


@dataclass(frozen=True)
class IndexResult:
    index: CodeIndex
    outcomes: DataFrame  # path, outcome
    summary: DataFrame  # one row of counters


def file_ids(paths: DataFrame, known: DataFrame | None) -> DataFrame:
    """path and file_id: known files keep theirs, new ones get the hash of their path."""
    new = F.abs(F.xxhash64("path"))
    if known is None:
        return paths.select("path", new.alias("file_id"))
    old = known.select("path", F.col("file_id").alias("_id")).distinct()
    return paths.join(old, "path", "left").select("path", F.coalesce("_id", new).alias("file_id"))


def changed_paths(current: DataFrame, known: DataFrame) -> DataFrame:
    """path and state (new, touched or unchanged) by size and time of change."""
    old = known.select("path", F.col("size_bytes").alias("_s"), F.col("mtime_ms").alias("_m")).distinct()
    joined = current.select("path", "size_bytes", "mtime_ms").join(old, "path", "left")
    same = (F.col("size_bytes") == F.col("_s")) & (F.col("mtime_ms") == F.col("_m"))
    return joined.select("path", F.when(F.col("_m").isNull(), "new").when(same, "unchanged").otherwise("touched").alias("state"))


def removed_paths(current: DataFrame, known: DataFrame) -> DataFrame:
    """path of the known files that aren't there any more."""
    return known.select("path").distinct().join(current.select("path"), "path", "left_anti")


def index_summary(outcomes: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: indexed, reused, parsed and removed files, and indexed symbols."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names)).cast("bigint")
    counts = outcomes.agg(n("unchanged", "content-unchanged", "reindexed").alias("indexed_files"), n("unchanged", "content-unchanged").alias("reused_files"), n("reindexed", "symbol-limit-exceeded").alias("parsed_files"), n("removed").alias("removed_files"))
    return counts.join(F.broadcast(symbols.agg(F.count("*").cast("bigint").alias("indexed_symbols"))))  # one row each


def build_index(states: DataFrame, contents: DataFrame, previous: CodeIndex | None = None, *, strategy: str = "doc-comments-first", limits: Limits = Limits(), force: DataFrame | None = None) -> IndexResult:
    """The index of a listing (path, language, size_bytes, mtime_ms) and its contents (path, content).

    Against a previous index only new and touched files, and those of `force` (path), are read on; those whose content
    is the same are kept, the others parsed. Files with too many symbols and files that are gone are left out. Edges are
    resolved anew.
    """
    ids = file_ids(states.select("path"), previous.files if previous else None)
    rows = states.join(ids, "path")
    if previous is None:
        look, kept = rows, None
    else:
        state = changed_paths(rows, previous.files)
        if force is not None:
            state = state.join(force.select("path", F.lit(True).alias("_f")).distinct(), "path", "left").withColumn("state", F.when(F.col("_f"), "touched").otherwise(F.col("state"))).drop("_f")
        kept = rows.join(state.where("state = 'unchanged'").select("path"), "path", "left_semi")
        look = rows.join(state.where("state != 'unchanged'").select("path"), "path", "left_semi")
    text = contents.where("content is not null").join(look.select("path", "file_id", "language", "size_bytes", "mtime_ms"), "path").withColumn("content_hash", content_fingerprint("content")).withColumn("integrity_hash", integrity_hash("content"))
    text = cut(text)
    same = None
    if previous is not None:
        old = previous.files.select("file_id", F.col("integrity_hash").alias("_h")).distinct()
        forced = force.select("path").distinct() if force is not None else None
        same = text.join(old, "file_id").where(F.col("_h") == F.col("integrity_hash")).select("file_id", "path")
        if forced is not None:
            same = same.join(forced, "path", "left_anti")
        same = cut(same)
    parse = text if same is None else text.join(same.select("file_id"), "file_id", "left_anti")
    found = cut(parse_symbols(parse.select("file_id", "path", "language"), parse.select("file_id", "content"), strategy))
    imported = extract_imports(parse.where(F.col("language").isin("ts", "tsx", "js", "jsx")).select("file_id", "content"))
    counts = found.groupBy("file_id").agg(F.count("*").cast("int").alias("symbol_count"))
    over = cut(counts.where(F.col("symbol_count") > limits.symbols_per_file).select("file_id"))
    good = parse.join(over, "file_id", "left_anti")
    found, imported = found.join(over, "file_id", "left_anti"), imported.join(over, "file_id", "left_anti")
    marks = fingerprints(found, imported)
    fresh = good.join(marks, "file_id", "left").join(counts, "file_id", "left").select(
        "file_id", "path", "language", "content_hash", "integrity_hash", "size_bytes", "mtime_ms", "symbol_signature_hash", "import_hash", F.lit("scanner").alias("parser_backend"), F.lit(False).alias("parser_fallback_used"),
        F.lit(None).cast("string").alias("parser_fallback_reason"), F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.current_timestamp().alias("updated_at"),
    )
    outcomes = good.select("path", F.lit("reindexed").alias("outcome")).unionByName(parse.join(over, "file_id", "left_semi").select("path", F.lit("symbol-limit-exceeded").alias("outcome")))
    files, symbols, imports, bodies = fresh, found, imported, good.select("file_id", "path", "content")
    if previous is not None:
        stay = kept.select("file_id").unionByName(same.select("file_id"))
        touched = text.select("file_id", F.col("size_bytes").alias("_s"), F.col("mtime_ms").alias("_m"))
        old_files = previous.files.join(stay, "file_id", "left_semi").join(touched, "file_id", "left").withColumn("size_bytes", F.coalesce("_s", "size_bytes")).withColumn("mtime_ms", F.coalesce("_m", "mtime_ms")).drop("_s", "_m")
        files = old_files.unionByName(fresh, allowMissingColumns=True)
        symbols = previous.symbols.join(stay, "file_id", "left_semi").unionByName(found)
        imports = previous.imports.join(stay, "file_id", "left_semi").unionByName(imported)
        bodies = previous.contents.join(stay, "file_id", "left_semi").unionByName(bodies)
        gone = removed_paths(states, previous.files)
        outcomes = outcomes.unionByName(kept.select("path", F.lit("unchanged").alias("outcome"))).unionByName(same.select("path", F.lit("content-unchanged").alias("outcome"))).unionByName(gone.select("path", F.lit("removed").alias("outcome")))
    files, symbols, imports, bodies = (cut(t) for t in (files, symbols, imports, bodies))
    index = CodeIndex(files, bodies, symbols, imports, cut(resolve_dependencies(files, imports)))
    return IndexResult(index, outcomes, index_summary(outcomes, symbols))


def refresh(states: DataFrame, contents: DataFrame, previous: CodeIndex, changed: DataFrame, **options) -> IndexResult:
    """The index after some paths changed: those and the files that import them directly are read again."""
    more = direct_importers(previous.dependencies, changed)
    return build_index(states, contents, previous, force=changed.select("path").unionByName(more), **options)


def record_checkout(mappings: DataFrame | None, checkout_id: str, files: DataFrame) -> DataFrame:
    """The mappings with what a checkout holds now; a path it had before is replaced."""
    from lodeglass.sources.store import upsert

    new = files.select(F.lit(checkout_id).alias("checkout_id"), F.col("path").alias("relative_path"), F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "integrity_hash", "language"), 256)).alias("artifact_key"), F.col("content_hash").alias("observed_content_hash"), F.col("size_bytes").alias("observed_size_bytes"), F.col("mtime_ms").alias("observed_mtime_ms"), F.current_timestamp().alias("observed_at"))
    return new if mappings is None else upsert(mappings, new, ["checkout_id", "relative_path"])
