import math
import re

import pytest
from pyspark.sql import functions as F

from lodeglass import schema
from lodeglass.operators import context, graph, health, outline
from lodeglass.operators.postings import COLUMN_WEIGHTS, bm25, bm25_from_postings, build_postings, write_postings
from lodeglass.operators.search import most_common, search_envelope, search_live, search_many, search_symbols, search_text
from lodeglass.schema import EngineConfig, PathPresets


def symbol(id, name, path="src/a.ts", kind="function", summary=None, qualified=None, line=1, exported=True, start=0, end=10, file_id=1, signature=None):
    s = signature or f"function {name}() {{}}"
    return (id, file_id, path, name, qualified, kind, s, summary or s, "signature", line, line + 1, start, end, exported)


def table(spark, rows):
    return spark.createDataFrame(rows, schema.SYMBOLS)


ROWS = [
    symbol("1", "HTTPServer", "src/server.ts", "class"), symbol("2", "refreshSessionToken", "src/auth.ts", summary="Renews an expired session."), symbol("3", "rankingWidget", "src/ranking/widget.ts", summary="Ranks a widget."), symbol("4", "Widget", "src/other.ts", "class", exported=False),
    symbol("5", "generateApiHooks", "tools/gen.ts"), symbol("6", "generatedApiHooksUsageTest", "src/api.test.ts"), symbol("7", "appWidgetUsage", "src/app.ts"), symbol("8", "resolveWidget", "z-app/r.ts"), symbol("9", "foo_bar", "src/foo.ts", qualified="Ns.foo_bar"),
]


def names(df):
    return [r.name for r in df.orderBy("rank").collect()]


def test_judged_queries(spark):
    t = table(spark, ROWS + [ROWS[0]])
    assert names(search_symbols(t, "HTTPServer"))[0] == "HTTPServer" and names(search_symbols(t, "expired session"))[0] == "refreshSessionToken"
    assert names(search_symbols(t, "widget", file_pattern="src/ranking/**")) == ["rankingWidget"] and names(search_symbols(t, "zzznothing")) == [] and names(search_symbols(t, "  ")) == []
    assert names(search_symbols(t, "reshSess")) == ["refreshSessionToken"]  # the full-text index has no such word
    assert names(search_symbols(t, "widget", kind="class")) == ["Widget"] and names(search_symbols(t, "widget", limit=1)) == names(search_symbols(t, "widget"))[:1]
    many = search_many(t, ["HTTPServer", "widget", "nope"])
    assert {r.query for r in many.collect()} == {"HTTPServer", "widget"}


def test_intents_and_presets(spark):
    t = table(spark, ROWS)
    found = names(search_symbols(t, "generated api hooks"))
    assert set(found) >= {"generateApiHooks", "generatedApiHooksUsageTest"} and found[0] == "generateApiHooks"
    assert names(search_symbols(t, "app widget"))[0] == "appWidgetUsage"
    liked = EngineConfig(presets=PathPresets(app_code=("z-app/**",)))
    twice = EngineConfig(presets=PathPresets(app_code=("z-app/**",), shared_runtime=("z-app/**",)))
    score = lambda c: {r.name: r.score for r in search_symbols(t, "app widget", config=c).collect()}
    assert score(liked)["resolveWidget"] - score(EngineConfig())["resolveWidget"] == 90 == score(twice)["resolveWidget"] - score(EngineConfig())["resolveWidget"]


def brute_bm25(rows, query_phrases):
    docs = [{c: re.findall(r"[^\W_]+", (r[k] or "").lower()) for c, k in (("name", 3), ("qualified_name", 4), ("signature", 6), ("summary", 7))} for r in rows]
    length = [sum(map(len, d.values())) for d in docs]
    mean, out = sum(length) / len(docs), {}
    for p in query_phrases:
        f = [sum(w * sum(d[c][i : i + len(p) - 1] == p[:-1] and i + len(p) <= len(d[c]) and d[c][i + len(p) - 1].startswith(p[-1]) for i in range(len(d[c]))) for c, w in COLUMN_WEIGHTS.items()) for d in docs]
        n = sum(x > 0 for x in f)
        idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else 1e-6
        for k, x in enumerate(f):
            if x:
                out[rows[k][0]] = out.get(rows[k][0], 0) - idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * length[k] / mean))
    return out


@pytest.mark.parametrize("query,found", [("widget", [["widget"]]), ("foo bar", [["foo", "bar"], ["foo"], ["bar"]]), ("session function", [["session", "function"], ["session"], ["function"]])])
def test_bm25_agrees_with_brute_force_and_postings(spark, tmp_path, query, found):
    t = table(spark, ROWS)
    want = {k: round(v, 9) for k, v in brute_bm25(ROWS, found).items()}
    assert {r.id: round(r.bm25_score, 9) for r in bm25(t, query).where("bm25_score is not null").collect()} == want
    assert {r.id: round(r.bm25_score, 9) for r in bm25_from_postings(*build_postings(t), query).collect()} == want
    write_postings(t, str(tmp_path), 2)
    stored = spark.read.parquet(f"{tmp_path}/postings")
    assert {r.id: round(r.bm25_score, 9) for r in bm25_from_postings(stored, spark.read.parquet(f"{tmp_path}/lengths"), query).collect()} == want
    plan = stored.where(F.col("term").startswith("wid"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,wid)" in plan
    assert {r.id: round(r.bm25_score, 9) for r in bm25(t.repartition(7), query).where("bm25_score is not null").collect()} == want


def test_envelope(spark):
    t = table(spark, [symbol(str(i), f"widget{i}", f"src/d{i % 2}/f{i}.ts") for i in range(20)])
    e = search_envelope(t, "widget").first()
    assert (e.total, e.returned, e.truncated, e.hint_limit, e.hint_kind) == (20, 8, True, 4, "function") and e.hint_file_pattern in ("src/d0/**", "src/d1/**") and 0 < e.saved_percent < 100
    small = search_envelope(t.where("id = '1'"), "widget").first()
    assert not small.truncated and small.hint_limit is None and small.saved_tokens == 0
    assert spark.range(1).select(most_common(F.array(*map(F.lit, "abba"))).alias("m")).first().m == "a"


def test_text_search(spark):
    contents = spark.createDataFrame([(1, "b.ts", "Hello World\nhello\n"), (2, "a.ts", "say hello there\nHELLO"), (3, "c.ts", None), (2, "a.ts", "say hello there\nHELLO"), (4, "d.ts", "Othello")], "file_id bigint, path string, content string")
    got = [(r.file_path, r.line, r.preview) for r in search_text(contents, "Hello").collect()]
    assert got == [("a.ts", 1, "say hello there"), ("a.ts", 2, "HELLO"), ("b.ts", 1, "Hello World"), ("b.ts", 2, "hello")]
    assert [r.file_path for r in search_text(contents, "thell").collect()] == ["d.ts"]  # no such word: all files are searched
    assert search_text(contents, "Hello", limit=1).count() == 1 and search_text(contents, "hello", file_pattern="b.*").count() == 2
    live = search_live(contents.select("path", "content").distinct(), "hello").collect()
    assert [(r.file_path, r.line) for r in live] == [("a.ts", 1), ("b.ts", 2), ("d.ts", 1)] and live[0].source == "live_disk_match"
    assert search_live(contents, "hello", output_bytes=10).count() == 0
    with pytest.raises(ValueError):
        search_text(contents, " ")


@pytest.fixture(scope="module")
def index(spark):
    texts = {1: ("src/math.ts", 'import { formatLabel } from "./strings.js";\nexport const PI = 3;\n/** Größe. */\nexport function area() { return formatLabel() }\n'), 2: ("src/strings.ts", "export function formatLabel() {}\nexport class Greeter {\n  greet() {}\n}\n"), 3: ("src/use.ts", 'import { area, missing } from "./math";\nimport x from "./gone";\nexport function use() {}\n'), 4: ("src/alias.ts", 'import { Greeter as G } from "./strings";\nfunction wrap() {}\n')}
    from lodeglass.functions.hashing import content_fingerprint, integrity_hash
    from lodeglass.functions.imports import extract_imports
    from lodeglass.operators.extract import parse_symbols

    contents = spark.createDataFrame([(i, p, t) for i, (p, t) in texts.items()], schema.CONTENT)
    files = contents.select("file_id", "path", F.lit("ts").alias("language"), content_fingerprint("content").alias("content_hash"), integrity_hash("content").alias("integrity_hash"), F.lit(1).cast("bigint").alias("size_bytes"), F.lit(1).cast("bigint").alias("mtime_ms"), F.lit("scanner").alias("parser_backend"), (F.col("file_id") == 4).alias("parser_fallback_used"), F.when(F.col("file_id") == 4, "odd").alias("parser_fallback_reason"), F.lit(1).alias("symbol_count")).cache()
    symbols = parse_symbols(files, contents).cache()
    imports = extract_imports(contents).cache()
    return graph.CodeIndex(files, contents, symbols, imports, graph.resolve_dependencies(files, imports).cache())


def ids(index, *wanted):
    by = {r.name: r.id for r in index.symbols.collect()}
    return [by[w] for w in wanted]


def seeds(index, *wanted):
    return index.symbols.where(F.col("id").isin(ids(index, *wanted))).select("id", F.array(F.lit("0"), "name").alias("order"), F.lit("query_match").alias("reason"))


def test_resolution(index):
    assert {(r.importer_path, r.target_path, r.source) for r in index.dependencies.collect()} == {("src/math.ts", "src/strings.ts", "./strings.js"), ("src/use.ts", "src/math.ts", "./math"), ("src/alias.ts", "src/strings.ts", "./strings")}
    assert [r.path for r in graph.direct_importers(index.dependencies, index.files.where("path = 'src/math.ts'")).collect()] == ["src/use.ts"]


def test_neighbours(index):
    met = lambda **o: {(r.name, r.depth, tuple(r.reasons)) for r in graph.discover(index, seeds(index, o.pop("seed")), **o).collect()}
    assert met(seed="area", dependencies=True) == {("area", 0, ("query_match",)), ("formatLabel", 1, ("imports_matched_file",))}
    assert ("area", 1, ("imported_by_match",)) in met(seed="formatLabel", importers=True)
    assert met(seed="formatLabel", references=True) == {("formatLabel", 0, ("query_match",)), ("area", 1, ("references_match",))}
    assert met(seed="Greeter", references=True) == {("Greeter", 0, ("query_match",)), ("wrap", 1, ("references_match",))}
    assert ("formatLabel", 2, ("imports_matched_file",)) in met(seed="use", dependencies=True, depth=2) and len(met(seed="use", dependencies=True, depth=1)) == 2 and len(met(seed="area")) == 1


def test_context(index):
    bundle = context.context_bundle(index, symbol_ids=ids(index, "area"))
    rows = bundle.items.orderBy("order").collect()
    assert [(r.name, r.role, r.reason) for r in rows] == [("area", "target", "explicit_symbol_id"), ("formatLabel", "dependency", "imports_matched_file")]
    assert rows[0].source.startswith("export function area") and rows[0].source.endswith("}")  # bytes, though ö stands before
    s = bundle.summary.first()
    assert s.used_tokens == sum(r.token_count for r in rows) and not s.truncated
    tight = context.context_bundle(index, symbol_ids=ids(index, "area"), token_budget=rows[0].token_count)
    assert [r.name for r in tight.items.collect()] == ["area"] and tight.summary.first().truncated
    candidates, _ = context.ranked_context(index, "area")
    assert [(r.rank, r.name, r.reason, r.selected) for r in candidates.collect()] == [(1, "area", "exact_symbol_match", True)]


def test_task_context(spark, index):
    task = context.task_context(index, symbol_ids=ids(index, "area"), query="fix a crash in Greeter")
    assert {(r.name, r.role) for r in task.items.collect()} >= {("area", "anchor"), ("formatLabel", "relation")}
    s = task.summary.first()
    assert s.intent == "debug" and s.used_payload_tokens <= 1200 and s.payload_token_budget == 1200
    small = context.task_context(index, symbol_ids=ids(index, "area", "use"), payload_token_budget=160)
    assert small.summary.first().used_payload_tokens <= 160 and {r.reason for r in small.exclusions.collect()} >= {"budget"}
    with pytest.raises(ValueError):
        context.task_context(index, symbol_ids=ids(index, "area"), payload_token_budget=100)
    intents = [spark.range(1).select(context.infer_intent(q).alias("i")).first().i for q in ("rename it", "security review", "look", None)]
    assert intents == ["refactor", "audit", "explore", "explore"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_greedy_budget_agrees_with_a_loop(spark, chunk):
    costs = [30, 50, 10, 90, 20, 5, 5, 40, 1, 100]
    rows = spark.createDataFrame([(str(i), ["0", f"{i:04d}"], c) for i, c in enumerate(costs)], "id string, order array<string>, cost int")
    want, left = [], 100
    for i, c in enumerate(costs):
        if c <= left:
            want.append(str(i))
            left -= c
    assert context.greedy_budget(rows, 100, chunk=chunk) == want and context.greedy_budget(rows.limit(0), 100) == []


def test_outline(spark, index):
    assert [tuple(r) for r in outline.repo_outline(index.files, index.symbols).collect()] == [("ts", 4, 7)]
    assert [r.name for r in outline.file_outline(index.symbols, "./src/strings.ts").collect()] == ["formatLabel", "Greeter", "greet"]
    assert outline.suggest_queries(index.symbols).first().suggestion == "Inspect class Greeter in src/strings.ts"
    source = outline.symbol_sources(index.symbols, index.files, index.contents, ids=ids(index, "area"), verify=True).first()
    assert source.verified and source.source_start_line == 4 and source.source.startswith("export function area")
    assert [r.id for r in outline.missing_ids(index.symbols, [*ids(index, "area"), "nope"]).collect()] == ["nope"]
    assert outline.file_content(index.contents, "src/use.ts").count() == 1 and outline.file_content(index.contents, "src/none.ts").count() == 0
    listing = spark.createDataFrame([("src/math.ts",), ("docs/math.md",), ("math.ts",), ("x/mathematics.txt",)], "path string")
    found = outline.find_files(listing, index.files, query="math.ts").collect()
    assert [(r.file_path, r.match_reason, r.indexed) for r in found] == [("src/math.ts", "name", True), ("math.ts", "name", False)]
    assert {r.path: r.summary for r in outline.file_summaries(index.files, index.symbols, index.contents).collect()}["src/strings.ts"] == "TS file with 3 indexed symbols"


def test_health(spark, index):
    h = health.dependency_health(index).first()
    assert (h.broken_imports, h.broken_symbol_imports, h.affected_importers, h.sample_importer_paths) == (1, 1, 1, ["src/use.ts"])
    p = health.parser_health(index.files).first()
    assert (p.indexed_files, p.fallback_files, p.fallback_rate) == (4, 1, 0.25) and [tuple(r) for r in health.fallback_reasons(index.files).collect()] == [("odd", 1)]
    now = index.files.select("path", "content_hash").where("path != 'src/use.ts'").withColumn("content_hash", F.when(F.col("path") == "src/math.ts", "x").otherwise(F.col("content_hash"))).unionByName(spark.createDataFrame([("new.ts", None)], "path string, content_hash string"))
    assert {(r.path, r.state) for r in health.snapshot_drift(index.files, now).collect()} == {("src/use.ts", "missing"), ("src/math.ts", "changed"), ("new.ts", "extra")}
    d = health.diagnostics(index, current=now)
    row = d.first()
    assert row.stale_status == "stale" and row.stale_reasons == ["unresolved relative imports", "unresolved relative symbol imports", "missing files", "content drift", "new files"] and row.retrieval.status == "unsafe"
    calm = health.diagnostics(index).first()
    assert calm.retrieval.status == "degraded" and calm.retrieval.affected == ["dependency_graph"]
    report = health.doctor(d, index.contents).first()
    assert report.index_status == "stale" and report.secret_like_files == 0 and len(report.warnings) >= 4 and len(report.actions) >= 4
    empty = graph.CodeIndex(*(t.limit(0) for t in (index.files, index.contents, index.symbols, index.imports, index.dependencies)))
    nothing = health.diagnostics(empty, has_meta=False).first()
    assert nothing.readiness == "not-ready" and nothing.retrieval.status == "unsafe" and nothing.stale_status == "unknown"
    assert health.diagnostics(index, pending_files=2).first().readiness == "deepening"


def test_checkouts(spark, index):
    checkouts = spark.createDataFrame([("c1", "/w")], "checkout_id string, canonical_root string")
    mappings = spark.createDataFrame([("c1", "src/math.ts")], "checkout_id string, relative_path string")
    edges = graph.copy_dependencies(index.dependencies.limit(1), "c1")
    assert health.unmapped_files(index.files, mappings, "c1").count() == 3 and health.missing_checkout_edges(index.dependencies, edges, "c1").count() == 2
    assert health.diagnostics(index, checkouts=checkouts, mappings=mappings, root="/w").first().stale_reasons[0] == "checkout path mappings incomplete"
    assert health.diagnostics(index, checkouts=checkouts, root="/x").first().stale_reasons[0] == "checkout mapping missing"


def test_folders(spark):
    rows = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d/e",), ("c/d",)], "path string")
    assert {r.path for r in graph.compact_folders(rows).collect()} == {"a", "ab", "c/d"}
    before = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, mtime_ms bigint")
    now = spark.createDataFrame([("a", 1), ("b", 2)], "path string, mtime_ms bigint")
    assert {(r.path, r.state) for r in health.folder_drift(before, now).collect()} == {("b", "changed"), ("c", "missing")}
