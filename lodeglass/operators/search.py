"""Ranked symbol search, line search, and what goes with their results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.functions import validation
from lodeglass.functions.codec import SYMBOL_FIELDS
from lodeglass.functions.text import dirname, path_matches, phrases
from lodeglass.operators.postings import bm25, content_hits
from lodeglass.operators.ranking import has_intent, match_reason, matches_any_column, symbol_order, symbol_score
from lodeglass.schema import EngineConfig

_COLUMNS = ("id", "file_id", "file_path", "name", "qualified_name", "kind", "signature", "summary", "summary_source", "start_line", "end_line", "start_byte", "end_byte", "exported")


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """One row per id; repeated deliveries are equal rows."""
    return symbols.where("id is not null").select(*_COLUMNS).distinct()


def with_language(symbols: DataFrame, files: DataFrame | None, language: str | None) -> DataFrame:
    """Only symbols of files of a language; files without a row have none."""
    if language is None or files is None:
        return symbols
    return symbols.join(files.where(F.col("language") == language).select("file_id").distinct(), "file_id", "left_semi")


def ranked_symbols(symbols: DataFrame, query: str, *, files: DataFrame | None = None, kind: str | None = None, language: str | None = None, file_pattern: str | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """All symbols that match a query, with bm25_score, score and reason, unordered.

    The full-text index narrows to its best candidates, unless the query means an intent; those must also hold a term in
    a column. Where it finds nothing, the columns alone decide. Rows need a score above 0; a blank query finds nothing.
    """
    validation.kind_and_language(kind, language)
    # repeated rows are told apart among what is found, not in the whole table
    scored = bm25(symbols.where("id is not null").select(*_COLUMNS), "" if has_intent(query) else query, "id")
    filtered = with_language(scored, files, language)
    if kind is not None:
        filtered = filtered.where(F.col("kind") == kind)
    wanted = filtered.where(matches_any_column(query))
    if not has_intent(query) and phrases(query):
        best = filtered.where("bm25_score is not null").select("id", "bm25_score").distinct().orderBy(F.col("bm25_score").asc(), F.col("id").asc()).select("id").limit(config.limits.symbol_candidates)
        count = best.agg(F.count("*").alias("_hits"))
        marked = wanted.join(best.withColumn("_hit", F.lit(True)), "id", "left").join(F.broadcast(count))  # one row
        wanted = marked.where("_hits = 0 or _hit").withColumn("bm25_score", F.when(F.col("_hits") > 0, F.col("bm25_score"))).select(*scored.columns)
    if file_pattern:
        wanted = wanted.where(path_matches("file_path", [file_pattern]))
    return wanted.withColumn("score", symbol_score(query, config.weights, config.presets)).withColumn("reason", match_reason(query)).where("score > 0").distinct()


def search_symbols(symbols: DataFrame, query: str, *, limit: int | None = None, config: EngineConfig = EngineConfig(), **options) -> DataFrame:
    """The best symbols for a query with their rank; at most limit, and never more than the configured cap."""
    validation.positive_limit(limit)
    n = min(limit or config.limits.symbol_results, config.limits.symbol_results)
    order = symbol_order(config.collation)
    best = ranked_symbols(symbols, query, config=config, **options).orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def symbol_json(prefix: str = "") -> Column:
    """A symbol as the object its readers get."""
    source = dict(zip(SYMBOL_FIELDS, ("id", "name", "qualified_name", "kind", "file_path", "signature", "summary", "summary_source", "start_line", "end_line", "start_byte", "end_byte", "exported")))
    return F.to_json(F.struct(*(F.col(prefix + c).alias(f) for f, c in source.items())), {"ignoreNullFields": "false"})


def search_envelope(symbols: DataFrame, query: str, *, limit: int | None = None, config: EngineConfig = EngineConfig(), **options) -> DataFrame:
    """One row about a search: total, returned, truncated, hint_limit, hint_file_pattern, hint_kind, and the tokens that
    the limit saves against all ranked symbols."""
    n = min(limit or config.limits.symbol_results, config.limits.symbol_results)
    ranked = ranked_symbols(symbols, query, config=config, **options)
    totals = ranked.select(F.length(symbol_json()).alias("c")).agg(F.count("*").alias("total"), (F.coalesce(F.sum("c"), F.lit(0)) + F.greatest(F.count("*") - 1, F.lit(0)) + 2).alias("characters"))
    items = ranked.orderBy(*symbol_order(config.collation)).limit(n).select("file_path", "kind", F.length(symbol_json()).alias("c"))
    shown = items.agg(
        F.count("*").alias("returned"), (F.coalesce(F.sum("c"), F.lit(0)) + F.greatest(F.count("*") - 1, F.lit(0)) + 2).alias("returned_characters"),
        most_common(F.filter(F.collect_list(dirname("file_path")), lambda d: d != ".")).alias("directory"), most_common(F.collect_list("kind")).alias("kind"),
    )
    one = totals.join(F.broadcast(shown))  # one row each
    truncated = F.col("total") > F.col("returned")
    tokens = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / 4)).cast("bigint")
    saved = F.greatest(F.lit(0), tokens("characters") - tokens("returned_characters"))
    return one.select(
        F.col("total").cast("bigint").alias("total"), F.col("returned").cast("bigint").alias("returned"), truncated.alias("truncated"),
        F.when(truncated, F.greatest(F.lit(1), F.floor(F.col("returned") / 2))).cast("bigint").alias("hint_limit"),
        F.when(truncated & F.lit(not options.get("file_pattern")), F.concat("directory", F.lit("/**"))).alias("hint_file_pattern"),
        F.when(truncated & F.lit(options.get("kind") is None), F.col("kind")).alias("hint_kind"),
        tokens("characters").alias("baseline_tokens"), tokens("returned_characters").alias("returned_tokens"), saved.cast("bigint").alias("saved_tokens"),
        F.round(100.0 * saved / tokens("characters")).cast("bigint").alias("saved_percent"),
    )


def most_common(values: Column) -> Column:
    """The most frequent element of an array, the first in order among equals; null for none. For arrays that a limit
    bounds."""
    counted = F.transform(F.array_distinct(values), lambda x: F.struct((-F.size(F.filter(values, lambda y: y == x))).alias("n"), x.alias("v")))
    return F.array_min(counted)["v"]


def search_text(contents: DataFrame, query: str, *, file_pattern: str | None = None, limit: int | None = None, config: EngineConfig = EngineConfig(), narrow: bool = True) -> DataFrame:
    """file_path, line and preview of the first lines, in order of path and line, that hold the whole query, whatever
    its case.

    The full-text index narrows to its first files (in order of file_id), where it finds any; narrow=False searches all
    files. Null contents are not searched, repeated deliveries count once.
    """
    validation.query_text(query)
    validation.positive_limit(limit)
    n = min(limit or config.limits.text_results, config.limits.text_results)
    rows = contents.where("content is not null and path is not null").select("file_id", "path", "content")
    if narrow and phrases(query):
        hits = rows.where(content_hits(rows, query)).select("file_id").distinct().orderBy("file_id").limit(config.limits.text_candidates)
        count = hits.agg(F.count("*").alias("_hits"))
        rows = rows.join(F.broadcast(hits.withColumn("_hit", F.lit(True))), "file_id", "left").join(F.broadcast(count)).where("_hits = 0 or _hit")  # 200 rows and one
    if file_pattern:
        rows = rows.where(path_matches("path", [file_pattern]))
    wanted = query.lower()
    lines = rows.where(F.lower("content").contains(wanted)).select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).where(F.lower("text").contains(wanted))
    found = lines.select(F.col("path").alias("file_path"), (F.col("pos") + 1).alias("line"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("preview")).distinct()
    return found.orderBy("file_path", "line").limit(n)


def search_live(lines: DataFrame, query: str, *, per_file: int = 100, limit: int = 100, output_bytes: int = 1_000_000) -> DataFrame:
    """Fallback over files as they lie on disk: file_path, line, preview, source and reason of lines that hold the query
    with its case. At most per_file lines of a file; nothing at all if the matches exceed output_bytes.

    lines: path, content of each file.
    """
    found = lines.where("content is not null").select(F.col("path").alias("file_path"), F.posexplode(F.split("content", "\n")).alias("pos", "text")).where(F.col("text").contains(query))
    kept = found.withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy("pos"))).where(F.col("_n") <= per_file)
    size = kept.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("file_path") + 2), F.lit(0)).alias("_bytes"))
    good = kept.join(F.broadcast(size)).where(F.col("_bytes") <= output_bytes)  # one row
    return good.select("file_path", (F.col("pos") + 1).alias("line"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("preview"), F.lit("live_disk_match").alias("source"), F.lit("ripgrep_fallback").alias("reason")).orderBy("file_path", "line").limit(limit)


def search_many(symbols: DataFrame, queries: Sequence[str], *, config: EngineConfig = EngineConfig(), **options) -> DataFrame:
    """The results of several queries, with column query; a query without results has no rows."""
    parts = [search_symbols(symbols, q, config=config, **options).withColumn("query", F.lit(q)) for q in dict.fromkeys(queries)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
