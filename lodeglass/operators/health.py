"""Health of an index: parser, dependencies, privacy, drift, readiness, and what it means for retrieval."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.privacy import secret_like
from lodeglass.operators.graph import CodeIndex, imports_by_edge
from lodeglass.schema import OPERATIONS

# Reasons for staleness and the states they come from.
UNRESOLVED_IMPORTS, UNRESOLVED_SYMBOLS = "unresolved relative imports", "unresolved relative symbol imports"
META_STATES = ("ok", "missing", "unreadable", "missing-integrity", "integrity-mismatch")


def parser_health(files: DataFrame) -> DataFrame:
    """One row: indexed, known, fallback and unknown files, and the share of known files with a fallback."""
    known, fallback = F.count_if(F.col("parser_backend").isNotNull()), F.count_if(F.coalesce("parser_fallback_used", F.lit(False)))
    return files.agg(F.count("*").cast("bigint").alias("indexed_files"), known.cast("bigint").alias("known_files"), fallback.cast("bigint").alias("fallback_files"), F.count_if(F.col("parser_backend").isNull()).cast("bigint").alias("unknown_files"), F.round(F.try_divide(fallback, known), 6).alias("fallback_rate"))


def fallback_reasons(files: DataFrame) -> DataFrame:
    used = files.where(F.col("parser_fallback_used") & F.col("parser_fallback_reason").isNotNull() & (F.col("parser_fallback_reason") != ""))
    return used.groupBy(F.col("parser_fallback_reason").alias("reason")).agg(F.count("*").cast("bigint").alias("files"))


def summary_sources(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("summary_source").agg(F.count("*").cast("bigint").alias("symbols"))


def _relative(source: Column) -> Column:
    return source.startswith("./") | source.startswith("../") | source.startswith("/")


def broken_imports(index: CodeIndex) -> DataFrame:
    """importer_path and source of relative imports that lead to no file."""
    paths = index.files.select("file_id", F.col("path").alias("importer_path")).distinct()
    wanted = index.imports.where(_relative(F.col("source"))).select("file_id", "source").distinct()
    found = index.dependencies.select(F.col("importer_file_id").alias("file_id"), "source")
    return wanted.join(found, ["file_id", "source"], "left_anti").join(paths, "file_id").select("importer_path", "source")


def broken_specifiers(index: CodeIndex) -> DataFrame:
    """importer_path, target_path and name of named imports that the target doesn't export, by one equality anti-join over
    names and qualified names."""
    edges = imports_by_edge(index).where(_relative(F.col("source")))
    asked = edges.select("importer_path", "target_path", "source", F.xxhash64("specifiers").alias("statement"), F.posexplode("specifiers").alias("pos", "s")).where("s.kind = 'named'").select("importer_path", "target_path", "statement", "pos", F.col("s.importedName").alias("name"))
    exported = index.symbols.where("exported").select(F.col("file_path").alias("target_path"), F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"))
    return asked.join(exported, ["target_path", "name"], "left_anti").select("importer_path", "target_path", "name")


def first_in_order(rows: DataFrame, column: str, n: int = 5) -> DataFrame:
    """One row with the first n values of a column as an array."""
    return rows.select(column).distinct().orderBy(column).limit(n).agg(F.array_sort(F.collect_list(column)).alias(f"sample_{column}s"))


def dependency_health(index: CodeIndex) -> DataFrame:
    """One row: broken imports, broken symbol imports, affected importers and a sample of five, importers of broken
    imports first."""
    a = broken_imports(index)
    b = broken_specifiers(index)
    importers = a.select("importer_path", F.lit(0).alias("o")).unionByName(b.select("importer_path", F.lit(1).alias("o"))).groupBy("importer_path").agg(F.min("o").alias("o"))
    sample = importers.orderBy("o", "importer_path").limit(5).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "importer_path"))), lambda x: x["importer_path"]).alias("sample_importer_paths"))
    one = [a.agg(F.count("*").cast("bigint").alias("broken_imports")), b.agg(F.count("*").cast("bigint").alias("broken_symbol_imports")), importers.agg(F.count("*").cast("bigint").alias("affected_importers")), sample]
    return reduce(lambda x, y: x.join(F.broadcast(y)), one)  # one row each


def privacy_files(contents: DataFrame) -> DataFrame:
    """path of the files that hold something like a secret."""
    return contents.where(secret_like("content") & F.col("path").isNotNull()).select("path").distinct()


def privacy_health(contents: DataFrame) -> DataFrame:
    """One row: number of files with something like a secret, and the first five paths."""
    found = privacy_files(contents)
    return found.agg(F.count("*").cast("bigint").alias("secret_like_files")).join(F.broadcast(first_in_order(found, "path")))  # one row each


def unmapped_files(files: DataFrame, mappings: DataFrame, checkout_id: str) -> DataFrame:
    own = mappings.where(F.col("checkout_id") == checkout_id).select(F.col("relative_path").alias("path"))
    return files.where("path is not null").select("path").distinct().join(own, "path", "left_anti")


def missing_checkout_edges(dependencies: DataFrame, checkout_dependencies: DataFrame, checkout_id: str) -> DataFrame:
    key = ["importer_path", "target_path", "source"]
    return dependencies.select(*key).distinct().join(checkout_dependencies.where(F.col("checkout_id") == checkout_id).select(*key), key, "left_anti")


def snapshot_drift(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """path and state (missing, extra, changed) of two listings of path and content_hash; null hashes equal null."""
    a = indexed.select("path", F.col("content_hash").alias("a"), F.lit(True).alias("in_a"))
    b = current.select("path", F.col("content_hash").alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, "path", "full_outer")
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("path", state.alias("state")).where("state is not null")


def drift_counts(drift: DataFrame) -> DataFrame:
    return drift.agg(*(F.count_if(F.col("state") == s).cast("bigint").alias(f"{s}_files") for s in ("missing", "changed", "extra")))


def folder_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """path of folders (path, mtime_ms) that are gone or changed."""
    joined = before.select("path", F.col("mtime_ms").alias("a")).join(now.select("path", F.col("mtime_ms").alias("b"), F.lit(True).alias("there")), "path", "left")
    return joined.where("there is null or not (a <=> b)").select("path", F.when(F.col("there").isNull(), "missing").otherwise("changed").alias("state"))


# -- chains of rules over one row


def readiness_stage(indexed_files: Column, discovered_files: Column, deep_indexed: Column, pending_files: Column) -> Column:
    """not-ready, discovery-ready, deepening or deep-retrieval-ready. pending_files is null unless an index is being
    built."""
    deep = F.coalesce(deep_indexed, F.lit(False)) | (indexed_files > 0)
    return F.when(F.coalesce(pending_files, F.lit(0)) > 0, "deepening").when(deep, "deep-retrieval-ready").when(discovered_files > 0, "discovery-ready").otherwise("not-ready")


def stale_reasons(*, meta_state: Column, checkout_known: Column, unmapped: Column, missing_edges: Column, broken: Column, broken_symbols: Column, indexed_files: Column, missing: Column | None = None, changed: Column | None = None, extra: Column | None = None) -> Column:
    """Array of all reasons why an index is stale, in a fixed order. The last three count only after a scan."""
    some = lambda c, text: F.when(c, F.lit(text))
    checkout = F.when(indexed_files == 0, F.lit(None)).when(~checkout_known, "checkout mapping missing").when(unmapped > 0, "checkout path mappings incomplete").when(missing_edges > 0, "checkout dependency mappings incomplete")
    meta = F.when(meta_state == "unreadable", "index metadata unreadable").when(meta_state == "missing-integrity", "index metadata integrity file missing").when(meta_state == "integrity-mismatch", "index metadata integrity mismatch")
    scan = [some(c > 0, text) for c, text in ((missing, "missing files"), (changed, "content drift"), (extra, "new files")) if c is not None]
    return F.array_compact(F.array(meta, checkout, some(broken > 0, UNRESOLVED_IMPORTS), some(broken_symbols > 0, UNRESOLVED_SYMBOLS), *scan))


def stale_status(reasons: Column, has_meta: Column, stored: Column, scanned: bool) -> Column:
    """fresh, stale or unknown; without a scan what was stored holds, unless there is a reason against it."""
    if scanned:
        return F.when(~has_meta, "unknown").when(F.size(reasons) == 0, "fresh").otherwise("stale")
    return F.when(F.size(reasons) > 0, F.when(has_meta, "stale").otherwise("unknown")).otherwise(F.when(has_meta, F.coalesce(stored, F.lit("unknown"))).otherwise("unknown"))


def _operations(names: Sequence[str]) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def retrieval_health(*, stage: Column, discovery_ready: Column, indexed_files: Column, reasons: Column, status: Column, broken: Column, broken_symbols: Column) -> Column:
    """struct(status, affected, safe): what can be relied on. Rules in order: nothing indexed; being built; only imports
    unresolved; not fresh; all well."""
    only_imports = (F.size(reasons) > 0) & F.forall(reasons, lambda r: r.isin(UNRESOLVED_IMPORTS, UNRESOLVED_SYMBOLS)) & ((broken > 0) | (broken_symbols > 0))
    verdict = lambda s, bad: F.struct(F.lit(s).alias("status"), _operations([o for o in OPERATIONS if o in bad]).alias("affected"), _operations([o for o in OPERATIONS if o not in bad]).alias("safe"))
    return (
        F.when(~discovery_ready & (indexed_files == 0), verdict("unsafe", OPERATIONS)).when(stage == "deepening", verdict("degraded", OPERATIONS[1:])).when(only_imports, verdict("degraded", OPERATIONS[3:]))
        .when(status != "fresh", verdict("unsafe", OPERATIONS)).otherwise(verdict("safe", ()))
    )


def diagnostics(index: CodeIndex, *, checkouts: DataFrame | None = None, mappings: DataFrame | None = None, checkout_dependencies: DataFrame | None = None, root: str | None = None, current: DataFrame | None = None, has_meta: bool = True, stored_status: str = "fresh", meta_state: str = "ok", discovered_files: int | None = None, pending_files: int | None = None) -> DataFrame:
    """One row: all that is known of an index. `current` (path, content_hash) makes it a scan; without `root` no checkout
    is asked for."""
    spark = index.files.sparkSession
    one = spark.range(1).select(F.lit(meta_state).alias("meta_state"), F.lit(has_meta).alias("has_meta"))
    parts = [parser_health(index.files.select("path", "parser_backend", "parser_fallback_used").distinct()), dependency_health(index), index.symbols.select("id").distinct().agg(F.count("*").cast("bigint").alias("indexed_symbols"))]
    if current is not None:
        parts.append(drift_counts(snapshot_drift(index.files.select("path", "content_hash").distinct(), current)))
    checkout = None
    if root is not None and checkouts is not None:
        found = checkouts.where(F.col("canonical_root") == root).select("checkout_id").limit(1).collect()
        checkout = found[0][0] if found else None
        if checkout and mappings is not None:
            parts.append(unmapped_files(index.files, mappings, checkout).agg(F.count("*").cast("bigint").alias("unmapped")))
        if checkout and checkout_dependencies is not None:
            parts.append(missing_checkout_edges(index.dependencies, checkout_dependencies, checkout).agg(F.count("*").cast("bigint").alias("missing_edges")))
    row = reduce(lambda a, b: a.join(F.broadcast(b)), parts, one)  # one row each
    for c in ("unmapped", "missing_edges"):
        if c not in row.columns:
            row = row.withColumn(c, F.lit(0).cast("bigint"))
    scan = {c: F.col(f"{c}_files") for c in ("missing", "changed", "extra")} if current is not None else {}
    row = row.withColumn("stale_reasons", stale_reasons(meta_state=F.col("meta_state"), checkout_known=F.lit(root is None or checkout is not None), unmapped=F.col("unmapped"), missing_edges=F.col("missing_edges"), broken=F.col("broken_imports"), broken_symbols=F.col("broken_symbol_imports"), indexed_files=F.col("indexed_files"), **scan))
    row = row.withColumn("stale_status", stale_status(F.col("stale_reasons"), F.col("has_meta"), F.lit(stored_status), current is not None))
    discovered = F.lit(discovered_files) if discovered_files is not None else F.col("indexed_files")
    row = row.withColumn("readiness", readiness_stage(F.col("indexed_files"), discovered, F.lit(None).cast("boolean"), F.lit(pending_files).cast("int")))
    health = retrieval_health(stage=F.col("readiness"), discovery_ready=discovered > 0, indexed_files=F.col("indexed_files"), reasons=F.col("stale_reasons"), status=F.col("stale_status"), broken=F.col("broken_imports"), broken_symbols=F.col("broken_symbol_imports"))
    return row.withColumn("retrieval", health)


def project_status(diagnosed: DataFrame) -> DataFrame:
    """What a status line shows of a diagnosis."""
    return diagnosed.select("stale_status", "readiness", "indexed_files", "indexed_symbols", F.col("retrieval.status").alias("retrieval_status"), F.array_join("stale_reasons", "; ").alias("reasons"))


def doctor(diagnosed: DataFrame, contents: DataFrame, *, watching: bool = False) -> DataFrame:
    """The diagnosis with index_status, privacy, and warnings and suggested actions in plain words."""
    row = diagnosed.join(F.broadcast(privacy_health(contents)))  # one row each
    status = F.when(F.col("indexed_files") == 0, "not-indexed").when(F.col("stale_status") == "stale", "stale").otherwise("indexed")
    say = lambda c, *text: F.when(c, F.concat(*(F.lit(t) if isinstance(t, str) else t.cast("string") for t in text)))
    rate = F.coalesce("fallback_rate", F.lit(0.0))
    sample = lambda c: F.coalesce(F.get(c, 0), F.lit("one of them"))
    warnings = F.array_compact(F.array(
        say(status == "not-indexed", "This repository has no index yet."), say(status == "stale", "The index is stale."),
        say(F.col("unknown_files") > 0, "Parser health is unknown for ", F.col("unknown_files"), " files."), say(rate > 0, "The parser fell back for ", F.col("fallback_files"), " of ", F.col("indexed_files"), " files."),
        say(F.col("broken_imports") > 0, F.col("broken_imports"), " relative imports of ", F.col("affected_importers"), " files lead nowhere."), say(F.col("broken_symbol_imports") > 0, F.col("broken_symbol_imports"), " imported names aren't exported."),
        say(F.col("secret_like_files") > 0, F.col("secret_like_files"), " files hold something like a secret."), say(F.lit(not watching), "Nothing watches for changes."),
    ))
    actions = F.array_compact(F.array(
        say(status != "indexed", "Index the repository."), say(F.col("unknown_files") > 0, "Index again to record parser health."), say(F.col("broken_imports") > 0, "Mend the imports of ", sample("sample_importer_paths"), "."),
        say(F.col("broken_symbol_imports") > 0, "Export what ", sample("sample_importer_paths"), " imports."), say(F.col("secret_like_files") > 0, "Look at ", sample("sample_paths"), " and rotate what is real."), say(F.lit(not watching), "Watch for changes while editing."),
    ))
    return row.withColumn("index_status", status).withColumn("warnings", warnings).withColumn("actions", actions)
