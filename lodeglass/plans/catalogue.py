"""The catalogue of queries over whole tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.functions.hashing import content_fingerprint
from lodeglass.functions.imports import extract_imports
from lodeglass.functions.languages import language_of, support_tier
from lodeglass.functions.privacy import redact_secrets, secret_like
from lodeglass.functions.text import dirname, path_matches, token_estimate
from lodeglass.operators import context, graph, health, outline, report
from lodeglass.operators.extract import parse_symbols
from lodeglass.operators.graph import CodeIndex
from lodeglass.operators.postings import bm25, bm25_from_postings, build_postings
from lodeglass.operators.ranking import symbol_score
from lodeglass.operators.search import ranked_symbols, search_envelope, search_symbols, search_text, unique_symbols
from lodeglass.schema import SPECIFIER, EngineConfig
from lodeglass.session import cut, table
from lodeglass.sources.store import best_artifacts, latest, prune_plan

#: Binary order, as SQL has it, instead of a locale's.
BINARY = EngineConfig(collation=None)
PHRASE, WORD, PART, INTENT, LINE = "merge lease", "session", "ergelease", "generated message", "seed list"
GLOBS, NOT_GLOBS = ("*/packages/**/src/**/*.{ts,js}", "**/lib/*.py"), ("**/vendor/**", "**/*.min.js")
CHECKOUT_SHARE = "co_"


def _t(spark: SparkSession, root: str, *names: str) -> list[DataFrame]:
    return [table(spark, root, n) for n in names]


# -- search


def symbol_search(spark, root):
    symbols, files = _t(spark, root, "symbols", "files")
    best = search_symbols(symbols, PHRASE, files=files, kind="function", config=BINARY)
    return best.select("rank", "id", "name", "file_path", F.round("bm25_score", 6).alias("bm25_score"), F.col("score").cast("bigint").alias("score"), "reason")


def symbol_search_fallback(spark, root):
    best = search_symbols(table(spark, root, "symbols"), PART, config=BINARY)
    return best.select("rank", "id", "name", "file_path", F.col("score").cast("bigint").alias("score"))


def symbol_search_intent(spark, root):
    best = search_symbols(table(spark, root, "symbols"), INTENT, config=BINARY)
    return best.select("rank", "id", "name", "file_path", F.col("score").cast("bigint").alias("score"))


def symbol_bm25(spark, root):
    scored = bm25(table(spark, root, "symbols").where("id is not null"), PHRASE, "id").where("bm25_score is not null")
    return scored.select("id", F.round("bm25_score", 6).alias("bm25_score")).distinct()


def symbol_bm25_postings(spark, root):
    """The same from stored postings: searches read the ranges of terms that hold their prefixes, and no symbols."""
    symbols = unique_symbols(table(spark, root, "symbols"))
    postings, lengths = build_postings(symbols)
    scored = bm25_from_postings(cut(postings.repartitionByRange("term", "id")), cut(lengths), PHRASE)
    return scored.select("id", F.round("bm25_score", 6).alias("bm25_score"))


def symbol_scores(spark, root):
    scored = table(spark, root, "symbols").where("id is not null").select("id", symbol_score(WORD).cast("bigint").alias("score"))
    return scored.where("score > 0").distinct()


def symbol_matches(spark, root):
    """All symbols a search ranks, before its limit."""
    return ranked_symbols(table(spark, root, "symbols"), WORD).select("id", F.col("score").cast("bigint").alias("score"), F.round("bm25_score", 6).alias("bm25_score"), "reason")


def search_result_envelope(spark, root):
    return search_envelope(table(spark, root, "symbols"), WORD, config=BINARY)


def text_search(spark, root):
    return search_text(table(spark, root, "file_content"), LINE, narrow=False).select("file_path", F.col("line").cast("bigint").alias("line"), "preview")


def text_search_narrowed(spark, root):
    return search_text(table(spark, root, "file_content"), LINE).select("file_path", F.col("line").cast("bigint").alias("line"), "preview")


def document_lines(spark, root):
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.coalesce("lang", F.lit("none")), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"))
    return search_text(docs, "token budget", narrow=False).select("file_path", F.col("line").cast("bigint").alias("line"), "preview")


def file_search(spark, root):
    files = table(spark, root, "files")
    listing = files.select("path")
    return outline.find_files(listing, files, query="lease", file_pattern="**/src/**", limit=50, config=BINARY)


def glob_filter(spark, root):
    return table(spark, root, "files").where(path_matches("path", GLOBS, NOT_GLOBS)).select("path").distinct()


# -- outlines and sources


def repo_outline(spark, root):
    return outline.repo_outline(*_t(spark, root, "files", "symbols"))


def file_tree(spark, root):
    return outline.file_tree(table(spark, root, "files")).select("path", "language", F.col("symbol_count").cast("bigint").alias("symbol_count"))


def query_suggestions(spark, root):
    return outline.suggest_queries(table(spark, root, "symbols"))


def file_summaries(spark, root):
    rows = outline.file_summaries(*_t(spark, root, "files", "symbols", "file_content"))
    return rows.select("path", "active_tier", "support_reason", "summary_source", "summary", "confidence", "symbol_count", F.array_join("hints", "|").alias("hints"))


def symbol_sources(spark, root):
    rows = outline.symbol_sources(*_t(spark, root, "symbols", "files", "file_content"), context=1, verify=True)
    return rows.select("id", "source_hash", "verified", *(F.col(c).cast("bigint").alias(c) for c in ("source_start_line", "source_end_line", "source_start_byte", "source_end_byte")))


def language_support(spark, root):
    files = table(spark, root, "files").select("path", "language").distinct()
    return files.groupBy("language", language_of("path").alias("by_extension"), support_tier("path").alias("tier")).agg(F.count("*").cast("bigint").alias("files"))


def content_verification(spark, root):
    """How many stored hashes are their content's, of either kind."""
    files, contents = _t(spark, root, "files", "file_content")
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    hashes = contents.where("content is not null").select("file_id", content_fingerprint("content").alias("fast"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("strong")).distinct()
    joined = hashes.join(files, "file_id")
    fast, strong = clean("content_hash") == F.col("fast"), clean("integrity_hash") == F.col("strong")
    return joined.groupBy(fast.alias("fingerprint_holds"), strong.alias("integrity_holds")).agg(F.count("*").cast("bigint").alias("files"))


def integrity_verification(spark, root):
    files, contents = _t(spark, root, "files", "file_content")
    strong = F.lower(F.regexp_replace("integrity_hash", r"^\s+|\s+$", "")) == F.col("strong")
    return contents.where("content is not null").select("file_id", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("strong")).distinct().join(files, "file_id").groupBy(strong.alias("integrity_holds")).agg(F.count("*").cast("bigint").alias("files"))


def token_estimates(spark, root):
    docs = table(spark, root, "documents")
    return docs.groupBy("kind").agg(F.sum(token_estimate("text")).cast("bigint").alias("tokens"), F.count("*").cast("bigint").alias("documents"))


def redacted_contents(spark, root):
    clean = redact_secrets("content")
    return table(spark, root, "file_content").where(secret_like("content")).select("file_id", F.sha2(clean, 256).alias("redacted_hash")).distinct()


# -- extraction and dependencies


def extracted_symbols(spark, root):
    return parse_symbols(*_t(spark, root, "files", "file_content"))


def extracted_imports(spark, root):
    rows = extract_imports(table(spark, root, "file_content"))
    return rows.select("file_id", "source", F.explode("specifiers").alias("s")).groupBy("source").agg(F.count_distinct("file_id").cast("bigint").alias("files"), F.count("*").cast("bigint").alias("specifiers"))


def resolved_dependencies(spark, root):
    files, contents = _t(spark, root, "files", "file_content")
    return graph.resolve_dependencies(files, extract_imports(contents)).groupBy("source").agg(F.count("*").cast("bigint").alias("edges"))


def trade_index(spark: SparkSession, root: str) -> CodeIndex:
    """An index made of the trade tables: customers and suppliers are files, customers import the suppliers whose parts
    they bought; each supplier's file declares the parts it sold, each customer's file the customer."""
    customer, supplier, part, orders, lineitem = _t(spark, root, "customer", "supplier", "part", "orders", "lineitem")
    c_path, s_path = F.concat(F.lit("customers/c"), F.col("c_custkey").cast("string"), F.lit(".ts")), F.concat(F.lit("suppliers/s"), F.col("s_suppkey").cast("string"), F.lit(".ts"))
    files = customer.select(F.col("c_custkey").alias("file_id"), c_path.alias("path")).unionByName(supplier.select((F.col("s_suppkey") + 1_000_000_000).alias("file_id"), s_path.alias("path"))).withColumn("language", F.lit("ts"))
    bought = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", "l_partkey").distinct()
    names = part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size", "p_type")
    empty = F.lit("")
    sold = lineitem.select("l_suppkey", "l_partkey").distinct().join(names, "l_partkey")
    kind = F.when(F.col("p_size") < 10, "class").when(F.col("p_size") < 30, "function").otherwise("constant")
    columns = lambda sid, path, fid, name, k, line, exported: [sid.alias("id"), fid.alias("file_id"), path.alias("file_path"), name.alias("name"), name.alias("qualified_name"), k.alias("kind"), name.alias("signature"), empty.alias("summary"), F.lit("signature").alias("summary_source"), line.cast("int").alias("start_line"), line.cast("int").alias("end_line"), F.lit(0).alias("start_byte"), F.length(name).alias("end_byte"), exported.alias("exported")]
    of_supplier = F.concat(F.lit("suppliers/s"), F.col("l_suppkey").cast("string"), F.lit(".ts"))
    parts = sold.select(*columns(F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")), of_supplier, F.col("l_suppkey") + 1_000_000_000, F.concat_ws("#", "p_name", F.col("l_partkey").cast("string")), kind, F.col("l_partkey"), F.col("p_size") % 2 == 0))
    people = customer.select(*columns(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), c_path, F.col("c_custkey"), F.col("c_name"), F.lit("class"), F.lit(1), F.lit(True)))
    source = F.concat(F.lit("../suppliers/s"), F.col("l_suppkey").cast("string"), F.lit(".ts"))
    spec = F.struct(F.lit("named").alias("kind"), F.concat_ws("#", "p_name", F.col("l_partkey").cast("string")).alias("importedName"), F.col("p_name").alias("localName"))
    imports = bought.join(names, "l_partkey").groupBy(F.col("o_custkey").alias("file_id"), source.alias("source")).agg(F.array_sort(F.collect_list(spec)).cast(f"array<{SPECIFIER}>").alias("specifiers"))
    dependencies = bought.select(F.col("o_custkey").alias("importer_file_id"), F.concat(F.lit("customers/c"), F.col("o_custkey").cast("string"), F.lit(".ts")).alias("importer_path"), of_supplier.alias("target_path"), source.alias("source")).distinct()
    symbols = parts.unionByName(people)
    contents = symbols.select("file_id", F.col("file_path").alias("path"), "name").groupBy("file_id", "path").agg(F.rpad(F.max("name"), 64, " ").alias("content"))
    return CodeIndex(files, contents, symbols, imports, dependencies)


def stored_trade_index(spark: SparkSession, root: str) -> CodeIndex:
    """The same with its tables stored, as an index has them; expansions read them several times."""
    i = trade_index(spark, root)
    return CodeIndex(i.files, i.contents, cut(i.symbols), cut(i.imports), cut(i.dependencies))


def representatives(spark, root):
    return graph.representative_symbols(trade_index(spark, root).symbols)


def dependency_picks(spark, root):
    picks = graph.dependency_picks(stored_trade_index(spark, root))
    return picks.groupBy("importer_path").agg(F.count("*").cast("bigint").alias("picks"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def importer_picks(spark, root):
    return graph.importer_picks(trade_index(spark, root)).groupBy("target_path").agg(F.count("*").cast("bigint").alias("importers"), F.min("id").alias("first_id"))


def reference_picks(spark, root):
    return graph.reference_picks(trade_index(spark, root)).groupBy("target_path", "name").agg(F.count("*").cast("bigint").alias("refs"), F.min("id").alias("first_id"))


def _seeds(index: CodeIndex) -> DataFrame:
    return index.symbols.where("id in ('c1', 'c2')").select("id", F.array(F.lit("0"), "id").alias("order"), F.lit("explicit_symbol_id").alias("reason"))


def graph_expansion(spark, root):
    """Symbols within two hops of two customers, over dependencies and importers, counted by depth."""
    index = stored_trade_index(spark, root)
    found = graph.expand(index, _seeds(index), depth=2, importers=True)
    return found.groupBy("depth").agg(F.count("*").cast("bigint").alias("symbols"))


def discovered_symbols(spark, root):
    index = stored_trade_index(spark, root)
    found = graph.discover(index, _seeds(index), depth=1, dependencies=True)
    return found.select("id", "depth", F.array_join(F.array_sort("reasons"), ",").alias("reasons"), "file_path", "start_line", "exported")


def direct_importers(spark, root):
    """Importers of the files whose suppliers have no money left."""
    index = trade_index(spark, root)
    poor = table(spark, root, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("suppliers/s"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("path"))
    return graph.direct_importers(index.dependencies, poor)


# -- context


def bundle_items(spark, root):
    index = stored_trade_index(spark, root)
    bundle = context.context_bundle(index, symbol_ids=("c1", "c2"), token_budget=400)
    return bundle.items.select("id", "role", "reason", "token_count")


def bundle_summary(spark, root):
    index = stored_trade_index(spark, root)
    return context.context_bundle(index, symbol_ids=("c1", "c2"), token_budget=400).summary


def ranked_candidates(spark, root):
    symbols, files, contents = _t(spark, root, "symbols", "files", "file_content")
    none = spark.createDataFrame([], f"file_id bigint, source string, specifiers array<{SPECIFIER}>")
    edges = spark.createDataFrame([], "importer_file_id bigint, importer_path string, target_path string, source string")
    candidates, _ = context.ranked_context(CodeIndex(files, contents, symbols, none, edges), WORD, config=BINARY)
    return candidates.select("rank", "id", "score", "reason", "selected")


def task_context(spark, root):
    found = context.task_context(stored_trade_index(spark, root), symbol_ids=("c1", "c2"), depth=1)
    return found.items.select("id", "role", "reason", "cost")


# -- health


def parser_health(spark, root):
    return health.parser_health(table(spark, root, "files"))


def parser_fallback_reasons(spark, root):
    return health.fallback_reasons(table(spark, root, "files"))


def summary_source_counts(spark, root):
    return health.summary_sources(unique_symbols(table(spark, root, "symbols")))


def privacy_files(spark, root):
    return health.privacy_files(table(spark, root, "file_content"))


def privacy_health(spark, root):
    return health.privacy_health(table(spark, root, "file_content")).select("secret_like_files", F.array_join("sample_paths", "|").alias("sample_paths"))


def _file_index(spark, root) -> CodeIndex:
    files, contents, symbols = _t(spark, root, "files", "file_content", "symbols")
    imports = extract_imports(contents)
    return CodeIndex(files, contents, symbols, imports, graph.resolve_dependencies(files, imports))


def broken_imports(spark, root):
    return health.broken_imports(_file_index(spark, root)).groupBy("importer_path").agg(F.count("*").cast("bigint").alias("broken"))


def broken_specifiers(spark, root):
    """Imported parts that their supplier's file doesn't export, per importer of the trade index."""
    return health.broken_specifiers(trade_index(spark, root)).groupBy("importer_path").agg(F.count("*").cast("bigint").alias("broken"))


def snapshot_drift(spark, root):
    """What the latest snapshots differ in from the files of their repositories."""
    files, entries = _t(spark, root, "files", "snapshot_entries")
    last = latest(entries.select("repository_id", "path", "content_hash", "received_at"), ["repository_id", "path"], "received_at")
    indexed = last.select(F.concat_ws("/", "repository_id", "path").alias("path"), "content_hash")
    return health.snapshot_drift(indexed, files.select("path", "content_hash")).groupBy("state").agg(F.count("*").cast("bigint").alias("files"))


def unmapped_files(spark, root):
    """Files that the checkout with the most mappings doesn't map; it mirrors all repositories."""
    files, mappings = _t(spark, root, "files", "checkout_path_mappings")
    largest = mappings.groupBy("checkout_id").count().orderBy(F.col("count").desc(), "checkout_id").limit(1).collect()
    return health.unmapped_files(files, mappings, largest[0][0] if largest else "")


def index_diagnosis(spark, root):
    files, contents, symbols = _t(spark, root, "files", "file_content", "symbols")
    found = health.diagnostics(_file_index(spark, root), current=files.select("path", "content_hash").distinct())
    return health.project_status(found)


def doctor_report(spark, root):
    contents = table(spark, root, "file_content")
    return health.doctor(health.diagnostics(_file_index(spark, root)), contents).select("index_status", "stale_status", "secret_like_files", F.array_join("warnings", "|").alias("warnings"), F.array_join("actions", "|").alias("actions"))


def top_folders(spark, root):
    """Folders of files that lie in no other folder of files."""
    return graph.compact_folders(table(spark, root, "files").where("path is not null").select(dirname("path").alias("path")))


# -- reports


def event_report(spark, root):
    events = table(spark, root, "events")
    kind = F.when(F.col("event_type").isin("purchase", "click"), report.FINISHED).otherwise(report.FORMATTED)
    rows = events.select(kind.alias("event"), F.create_map(F.lit("durationMs"), F.col("value").cast("string"), F.lit("tokenBudgetUsed"), F.get_json_object("props", "$.k"), F.lit("tokens"), F.get_json_object("props", "$.k"), F.lit("savedTokens"), F.get_json_object("props", "$.k"), F.lit("responseRepresentation"), F.when(F.col("user_id") % 2 == 0, "reference").otherwise("full")).alias("data"))
    return report.event_report(rows)


def event_latency(spark, root):
    return report.latency_bands(table(spark, root, "events"), "event_type", "value")


def session_references(spark, root):
    rows = table(spark, root, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_type").alias("content_id"), "event_id")
    return report.session_references(rows, tie="event_id").groupBy("content_id", "representation").agg(F.count("*").cast("bigint").alias("answers"))


def _tasks(spark, root) -> DataFrame:
    part = table(spark, root, "part")
    targets = part.select(F.col("p_brand").alias("task"), F.col("p_type").alias("target"), F.lit("contains").alias("mode")).distinct()
    by_price = part.select(F.col("p_brand").alias("task"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.struct((-F.col("p_retailprice")).alias("a"), F.col("p_partkey").alias("b")).alias("o"))
    best = by_price.groupBy("task").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "text"))), 1, 10).alias("x")).select("task", F.posexplode("x").alias("pos", "e"))
    return report.task_metrics(report.evidence_ranks(targets, best.select("task", (F.col("pos") + 1).alias("rank"), F.col("e.text").alias("text"))))


def judged_tasks(spark, root):
    return _tasks(spark, root)


def judged_summary(spark, root):
    return report.metrics_summary(_tasks(spark, root).withColumn("workflow", F.substring("task", 1, 7)), "workflow")


# -- stores


def latest_mappings(spark, root):
    rows = latest(table(spark, root, "checkout_path_mappings"), ["checkout_id", "relative_path"], "observed_at")
    return rows.groupBy("checkout_id").agg(F.count("*").cast("bigint").alias("paths"), F.max("observed_at").alias("last_at"))


def richest_artifacts(spark, root):
    rows = best_artifacts(table(spark, root, "analysis_artifacts"))
    return rows.select("artifact_key", "parse_output_json", "created_at")


def cache_prune(spark, root):
    """The files a cache of half the bytes would let go, oldest first."""
    files = table(spark, root, "files").where("size_bytes is not null and updated_at is not null")
    half = files.agg((F.sum("size_bytes") / 2).cast("bigint")).first()[0] or 0
    return prune_plan(files.select(F.col("path").alias("key"), F.col("size_bytes").alias("bytes"), F.col("updated_at").alias("used_at"), (F.col("language") == "css").alias("active")), half)


def retained_events(spark, root):
    """Events of the last three days before the latest one, per type."""
    events = table(spark, root, "events")
    last = events.agg(F.max("ts").alias("now"))
    rows = events.join(F.broadcast(last))  # one row
    return report.recent_events(rows, 3, F.col("now")).groupBy("event_type").agg(F.count("*").cast("bigint").alias("events"))


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return symbol_search(spark, root)


_QUERIES = (
    symbol_search, symbol_search_fallback, symbol_search_intent, symbol_bm25, symbol_bm25_postings, symbol_scores, symbol_matches, search_result_envelope, text_search, text_search_narrowed, document_lines, file_search, glob_filter,
    repo_outline, file_tree, query_suggestions, file_summaries, symbol_sources, language_support, content_verification, integrity_verification, token_estimates, redacted_contents,
    extracted_symbols, extracted_imports, resolved_dependencies, representatives, dependency_picks, importer_picks, reference_picks, graph_expansion, discovered_symbols, direct_importers,
    bundle_items, bundle_summary, ranked_candidates, task_context, parser_health, parser_fallback_reasons, summary_source_counts, privacy_files, privacy_health, broken_imports, broken_specifiers, snapshot_drift, unmapped_files,
    index_diagnosis, doctor_report, top_folders, event_report, event_latency, session_references, judged_tasks, judged_summary, latest_mappings, richest_artifacts, cache_prune, retained_events,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    from lodeglass.plans.catalogue_sql import SQL

    return SQL
