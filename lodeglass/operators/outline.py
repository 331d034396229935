"""Outlines, exact sources, file search and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.functions import validation
from lodeglass.functions.hashing import integrity_hash, verified
from lodeglass.functions.languages import discovery_summary, language_of, support_reason, support_tier
from lodeglass.functions.text import basename, extension, inside_root, line_window, path_matches
from lodeglass.operators.ranking import file_score, locale_order
from lodeglass.operators.search import unique_symbols
from lodeglass.schema import EngineConfig


def repo_outline(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files and symbols per language; a null language is a row of its own."""
    own = files.select("file_id", "language").distinct()
    per = unique_symbols(symbols).groupBy("file_id").agg(F.count("*").alias("n"))
    return own.join(per, "file_id", "left").groupBy("language").agg(F.count("*").cast("bigint").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("symbols"))


def file_tree(files: DataFrame) -> DataFrame:
    """path, language and symbol_count of every file; sort by path to show."""
    return files.where("path is not null").select("path", "language", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count")).distinct()


def file_outline(symbols: DataFrame, path: str) -> DataFrame:
    """The symbols of a file in order of line."""
    return unique_symbols(symbols).where(F.col("file_path") == inside_root(path)).orderBy("start_line", "start_byte", "id")


def suggest_queries(symbols: DataFrame, n: int = 5) -> DataFrame:
    """rank and suggestion: what to ask first about a repository, from exported symbols, classes and functions first."""
    order = [F.col("exported").desc(), (F.col("kind") == "class").desc(), (F.col("kind") == "function").desc(), F.col("name").asc(), F.col("id").asc()]
    best = unique_symbols(symbols).orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
    return best.select("rank", F.format_string("Inspect %s %s in %s", "kind", "name", "file_path").alias("suggestion"))


def symbol_sources(symbols: DataFrame, files: DataFrame, contents: DataFrame, *, ids: Sequence[str] | None = None, context: int = 0, verify: bool = False) -> DataFrame:
    """id, file_path, source, lines, bytes, hash, parser and verified of symbols, read by line from the stored content.

    All symbols, or those of some ids, each once; an id without a symbol has no row, nor has a symbol without content.
    """
    validation.context_lines(context)
    rows = unique_symbols(symbols)
    if ids is not None:
        asked = symbols.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        rows = rows.join(F.broadcast(asked), "id", "left_semi") if len(ids) < 50_000 else rows.join(asked, "id", "left_semi")
    text = contents.where("content is not null").select("file_id", "content")
    info = files.select("file_id", "content_hash", "integrity_hash", "parser_backend", "parser_fallback_used", "parser_fallback_reason").distinct()
    joined = rows.join(text, "file_id").join(info, "file_id", "left")
    window = line_window(F.col("content"), F.col("start_line"), F.col("end_line"), context)
    good = verified(F.col("content"), F.col("integrity_hash"), F.col("content_hash")) if verify else F.lit(False)
    return joined.select("id", "file_path", *(c.alias(n if n == "source" else f"source_{n}") for n, c in window.items()), integrity_hash(window["source"]).alias("source_hash"), good.alias("verified"), "parser_backend", F.coalesce("parser_fallback_used", F.lit(False)).alias("parser_fallback_used"), "parser_fallback_reason").distinct()


def missing_ids(symbols: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Those of some ids that no symbol has."""
    asked = symbols.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    return asked.join(symbols.select("id"), "id", "left_anti")


def file_content(contents: DataFrame, path: str) -> DataFrame:
    """The content of one file; an empty result for an unknown one."""
    return contents.where(F.col("path") == inside_root(path)).select("path", "content").distinct()


def find_files(listing: DataFrame, files: DataFrame, *, query: str | None = None, file_pattern: str | None = None, limit: int | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The best files of a listing (path) for a query or glob: name before path, whole before part, indexed ones first."""
    if query is None and file_pattern is None:
        raise ValueError("a query or a pattern is needed")
    validation.positive_limit(limit)
    n = min(limit or config.limits.symbol_results, config.limits.files_discovered)
    indexed = files.where("path is not null").select("path", F.lit(True).alias("_indexed")).distinct()
    rows = listing.where("path is not null").select("path").distinct()
    if file_pattern:
        rows = rows.where(path_matches("path", [file_pattern]))
    scored = rows.withColumn("m", file_score(F.col("path"), query)).where("m.score > 0").join(indexed, "path", "left")
    shown = scored.select(
        F.col("path").alias("file_path"), basename("path").alias("file_name"), language_of("path").alias("language"), support_tier("path").alias("support_tier"), F.coalesce("_indexed", F.lit(False)).alias("indexed"),
        F.col("m.reason").alias("match_reason"), F.col("m.score").alias("score"),
    )
    return shown.orderBy(F.col("score").desc(), F.col("indexed").desc(), locale_order("file_path", config.collation).asc(), F.col("file_path").asc()).limit(n).drop("score")


def file_summaries(files: DataFrame, symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """path, summary_source, summary, confidence, symbol_count, top_symbols and hints of every file: from its symbols, or
    from its content where there are none. Files with neither have no row."""
    first = F.struct("start_line", "start_byte", "id", "name", "kind")
    per = unique_symbols(symbols).groupBy("file_id").agg(F.count("*").cast("bigint").alias("n"), F.slice(F.array_sort(F.collect_list(first)), 1, 3).alias("top"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    known = files.where("path is not null").select("file_id", "path").distinct()
    with_symbols = known.join(per, "file_id").withColumn("content", F.lit(None).cast("string"))
    without = known.join(per.select("file_id"), "file_id", "left_anti").join(contents.where("content is not null").select("file_id", "content"), "file_id")
    rows = with_symbols.unionByName(without, allowMissingColumns=True)
    said = discovery_summary(F.col("path"), F.col("content"))
    ext = F.upper(F.regexp_replace(extension("path"), r"^\.", ""))
    has = F.col("n").isNotNull()
    lines = F.transform("top", lambda s: F.format_string("%s %s at line %d", s["kind"], s["name"], s["start_line"]))
    return rows.select(
        "path", language_of("path").alias("language"), F.when(has, "structured").otherwise("discovery").alias("active_tier"), support_reason("path").alias("support_reason"),
        F.when(has, "structured").otherwise(said["summary_source"]).alias("summary_source"),
        F.when(has, F.concat(F.when(ext == "", "Source").otherwise(ext), F.lit(" file with "), F.col("n").cast("string"), F.lit(" indexed symbols"))).otherwise(said["summary"]).alias("summary"),
        F.when(has | language_of("path").isNotNull(), "high").otherwise("medium").alias("confidence"), F.coalesce("n", F.lit(0)).cast("bigint").alias("symbol_count"),
        F.when(has, F.concat(F.array(F.concat(F.lit("symbol kinds: "), F.array_join("kinds", ", "))), lines)).otherwise(said["hints"]).alias("hints"),
    ).distinct()
