import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeglass import schema
from lodeglass.operators import report
from lodeglass.operators.extract import extract_symbols
from lodeglass.operators.indexing import build_index, changed_paths, record_checkout, refresh
from lodeglass.sources import events, files, store
from lodeglass.streaming import sessions, watch

T0 = datetime(2026, 1, 1)


# -- extraction


def got(path, language, text):
    return [(s["kind"], s["qualified_name"], s["exported"]) for s in extract_symbols(path, language, text)]


@pytest.mark.parametrize("language,text,want", [
    ("ts", "export function f(a: string): void { if (a) { return } }\nexport class A<T> extends B {\n  x = 1;\n  constructor() { super() }\n  get status() { return 1 }\n  set status(v) {}\n  async run<T>(a: T) { for (;;) {} }\n}\nconst y = { a: 1 };\ninterface I { a: string }\nexport * from './z';\n", [("function", "f", True), ("class", "A", True), ("method", "A.constructor", False), ("method", "A.status", False), ("method", "A.status", False), ("method", "A.run", False), ("constant", "y", False), ("type", "I", False)]),
    ("python", 'X = 1\nclass A:\n    """d\nx = 1\n"""\n    def f(self):\n        return 1\n\n    async def g(self): pass\n\ndef h(a,\n      b):\n    return (a,\n  b)\n', [("constant", "X", False), ("class", "A", False), ("method", "A.f", False), ("method", "A.g", False), ("function", "h", False)]),
    ("go", "package a\n\nconst X = \"{\"\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) F(a int) any {\n\treturn 1\n}\n\nfunc g() {\n}\n", [("constant", "X", False), ("class", "T", False), ("method", "T.F", False), ("function", "g", False)]),
    ("java", "package a;\n\npublic class A {\n    int x = 1;\n    @Override\n    public Object f(String a, int b) {\n        if (a) { return 1; }\n        return b;\n    }\n}\n", [("class", "A", False), ("method", "A.f", False)]),
    ("json", '{"a": 1, "b": {"a": [1, 2]}, "c": "}"}', [("constant", "a", False), ("constant", "b", False), ("constant", "c", False)]), ("json", "[1]", []), ("json", "{bad", []),
    ("bash", '#!/bin/bash\nX=1\nf() {\n  echo "}"\n}\n', [("constant", "X", False), ("function", "f", False)]), ("css", ".a {\n  b: c;\n}\n.d .e{f:g}\n", [("constant", ".a", False), ("constant", ".d .e", False)]), ("template", "<%= x %>", []),
])
def test_extraction(language, text, want):
    assert got("p", language, text) == want


def test_places_and_summaries():
    text = "// Größe\r\n/** Says what. */\r\nexport function f() {\r\n  return 1;\r\n}\r\n"
    (s,) = extract_symbols("a.ts", "ts", text)
    raw = text.encode()
    assert raw[s["start_byte"] : s["end_byte"]].decode() == "export function f() {\r\n  return 1;\r\n}" and (s["start_line"], s["end_line"]) == (3, 5)
    assert (s["summary"], s["summary_source"]) == ("Says what.", "doc-comment") and s["signature"] == "export function f() { return 1; }"
    assert extract_symbols("a.ts", "ts", text, "signature-only")[0]["summary_source"] == "signature"


# -- indexing


def state(spark, texts, mtime=1):
    rows = [(p, "ts", len(t), mtime if isinstance(mtime, int) else mtime.get(p, 1)) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, language string, size_bytes bigint, mtime_ms bigint"), spark.createDataFrame(list(texts.items()), "path string, content string")


def outcomes(result):
    return {r.path: r.outcome for r in result.outcomes.collect()}


def test_incremental_index(spark):
    texts = {"a.ts": 'import { b } from "./b";\nexport function a() {}\n', "b.ts": "export function b() {}\n", "c.ts": "const c = 1;\n"}
    first = build_index(*state(spark, texts))
    assert outcomes(first) == dict.fromkeys(texts, "reindexed") and first.summary.first().asDict() == {"indexed_files": 3, "reused_files": 0, "parsed_files": 3, "removed_files": 0, "indexed_symbols": 3}
    again = build_index(*state(spark, texts), first.index)
    assert outcomes(again) == dict.fromkeys(texts, "unchanged")
    touched = build_index(*state(spark, texts, {"b.ts": 2}), first.index)
    assert outcomes(touched)["b.ts"] == "content-unchanged" and {r.mtime_ms for r in touched.index.files.where("path = 'b.ts'").collect()} == {2}
    del texts["c.ts"]
    texts["b.ts"] = "export function bee() {}\nexport function b2() {}\n"
    edited = build_index(*state(spark, texts, {"b.ts": 3}), first.index)
    assert outcomes(edited) == {"a.ts": "unchanged", "b.ts": "reindexed", "c.ts": "removed"} and {r.name for r in edited.index.symbols.collect()} == {"a", "bee", "b2"}
    assert edited.index.dependencies.count() == 1
    wider = refresh(*state(spark, texts, {"b.ts": 3}), first.index, spark.createDataFrame([("b.ts",)], "path string"))
    assert outcomes(wider)["a.ts"] == "reindexed"
    limited = build_index(*state(spark, texts), limits=schema.Limits(symbols_per_file=1))
    assert outcomes(limited)["b.ts"] == "symbol-limit-exceeded" and limited.index.files.count() == 1
    mapped = record_checkout(None, "c1", first.index.files)
    assert record_checkout(mapped, "c1", first.index.files.limit(1)).count() == 3
    assert {r.state for r in changed_paths(state(spark, texts)[0], first.index.files).collect()} == {"unchanged", "touched"}
    assert build_index(*(t.limit(0) for t in state(spark, texts))).summary.first().indexed_files == 0


def test_result_does_not_depend_on_partitions(spark):
    texts = {f"d{i}.ts": f'import {{ f{i + 1} }} from "./d{i + 1}";\nexport function f{i}() {{}}\n' for i in range(12)}
    s, c = state(spark, texts)
    one, many = build_index(s.coalesce(1), c.coalesce(1)).index, build_index(s.repartition(9), c.repartition(5)).index
    rows = lambda t: sorted(map(str, t.collect()))
    assert rows(one.symbols) == rows(many.symbols) and rows(one.dependencies) == rows(many.dependencies) and one.dependencies.count() == 11


# -- sources and stores


def test_discovery(spark, tmp_path):
    for name, text in {"src/a.ts": "x", "src/b.md": "y", "src/big.ts": "z" * 300_000, "node_modules/m/i.js": "x", "src/ignored.ts": "x", "lib/keep.py": "é", "src/sub/d.go": "package a"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    root = str(tmp_path)
    rules = files.ignore_rules("# no\nignored.ts\n*.go\n!src/sub/d.go\n")
    assert {r.path for r in files.listing(spark, root).collect()} == {"src/a.ts", "src/b.md", "src/big.ts", "src/ignored.ts", "lib/keep.py", "src/sub/d.go"}
    found = files.discover(spark, root, rules=rules)
    assert {(r.path, r.language) for r in found.collect()} == {("src/a.ts", "ts"), ("lib/keep.py", "python"), ("src/sub/d.go", "go")}
    assert files.supported_files(spark, root, include=["src/**"], exclude=["**/ignored.*"]).count() == 2
    with pytest.raises(ValueError):
        files.discover(spark, root, limits=schema.Limits(files_discovered=1))
    contents = files.read_contents(spark, root, found)
    assert {r.path: r.content for r in contents.collect()}["lib/keep.py"] == "é" and files.snapshot(contents).count() == 3
    assert {r.path for r in files.folder_states(files.file_states(spark, root)).collect()} == {"src", "lib", "src/sub"}
    before = spark.createDataFrame(files.listing(spark, root).collect())
    (tmp_path / "src/a.ts").write_text("changed")
    (tmp_path / "src/b.md").unlink()
    (tmp_path / "src/new.ts").write_text("n")
    changed, _ = watch.poll(spark, root, before)
    assert {(r.path, r.kind) for r in changed.collect()} == {("src/a.ts", "changed"), ("src/b.md", "deleted"), ("src/new.ts", "new")}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert store.current(spark, root) is None
    store.publish(spark.range(3), root)
    old = store.current(spark, root)
    store.publish(spark.range(5), root)
    assert old.count() == 3 and store.current(spark, root).count() == 5 and store.vacuum(spark, root) == 1 and store.current(spark, root).count() == 5


def test_upserts_and_artifacts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert {tuple(r) for r in store.upsert(old, spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int"), ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    rows = spark.createDataFrame([("a", None, "x"), ("a", T0, "y"), ("a", T0, "z"), ("b", None, None)], "k string, at timestamp, v string")
    assert {(r.k, r.v) for r in store.latest(rows, ["k"], "at").collect()} == {("a", "z"), ("b", None)}
    wanted = spark.createDataFrame([("h", "ts", "p", "s", "c", "d", 7), ("h2", "ts", "p", "s", "c", "d", 7)], ", ".join(f"{c} {'int' if c == 'storage_schema_version' else 'string'}" for c in store.FINGERPRINT))
    key = wanted.limit(1).select(store.artifact_key().alias("artifact_key"))
    assert {(r.content_hash, r.reused) for r in store.resolve_artifacts(wanted, key).collect()} == {("h", True), ("h2", False)}
    assert store.add_artifacts(key, wanted.select(store.artifact_key().alias("artifact_key")).union(key)).count() == 2


def test_bookmarks_and_meta(spark, tmp_path):
    marks = store.add_bookmark(store.add_bookmark(spark.createDataFrame([], "name string, symbol_id string"), "one", "s1"), "one", "s2")
    marks = store.add_bookmark(marks, "two", "gone")
    symbols = spark.createDataFrame([("s2", "a.ts", 3)], "id string, file_path string, start_line int")
    assert {(r.name, r.status) for r in store.resolve_bookmarks(marks, symbols).collect()} == {("one", "available"), ("two", "missing")}
    assert [r.name for r in store.remove_bookmark(marks, "one").collect()] == ["two"]
    with pytest.raises(ValueError):
        store.add_bookmark(marks, " ", "x")
    folder = str(tmp_path)
    assert store.meta_health(folder) == ("missing", None)
    store.write_meta(folder, {"a": 1})
    assert store.meta_health(folder) == ("ok", {"a": 1})
    (tmp_path / "meta.sha256").write_text("x")
    assert store.meta_health(folder)[0] == "integrity-mismatch"
    (tmp_path / "meta.sha256").unlink()
    assert store.meta_health(folder)[0] == "missing-integrity"
    (tmp_path / "meta.json").write_text("{")
    assert store.meta_health(folder)[0] == "unreadable"


def test_prune(spark):
    rows = spark.createDataFrame([(f"k{i}", 10, T0 + timedelta(hours=i), i == 0) for i in range(10)], "key string, bytes bigint, used_at timestamp, active boolean")
    assert sorted(r.key for r in store.prune_plan(rows, 75).collect()) == ["k1", "k2", "k3"] and store.prune_plan(rows, 100).count() == 0 and store.prune_plan(rows, 0).count() == 9 and store.prune_plan(rows.limit(0), 0).count() == 0
    assert tuple(store.cache_status(rows).first()) == (10, 100, 1)


# -- events, reports


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    key = "ghp_" + "a1" * 12
    rows = [("1", T0, "r", "s", "e", "info", None, {"text": "code", "n": key}), ("2", T0 - timedelta(days=9), "r", "s", "e", "info", None, {}), ("3", None, "r", "s", "e", "info", None, {})]
    events.write_events(spark.createDataFrame(rows, schema.EVENTS), path, now=F.lit(T0).cast("timestamp"))
    with open(os.path.join(path, "extra.json"), "w") as f:
        f.write("no json\n\n{\"id\": \"9\"}\n")
    back = events.read_events(spark, path)
    assert {r.id: r.data for r in back.collect()} == {"1": {"text": "[REDACTED:source-text]", "n": "[REDACTED:secret]"}, "3": {}}
    assert [r.id for r in events.last_events(back, 0).collect()] == ["1"]


def test_report(spark):
    done, sent = report.FINISHED, report.FORMATTED
    rows = [(done, {"durationMs": "25", "tokenBudgetUsed": "12", "responseRepresentation": "full"}), (done, {"durationMs": "250", "tokenBudgetUsed": "80", "responseRepresentation": "reference"}), (sent, {"tokens": "10", "savedTokens": "4", "responseRepresentation": "full"}), (sent, {"tokens": "8", "savedTokens": "99", "responseRepresentation": "reference"}), ("other", {"durationMs": "x"})]
    r = report.event_report(spark.createDataFrame(rows, "event string, data map<string,string>")).first()
    assert (r.calls, r.token_budget_total, r.delivered_tokens, r.saved_tokens, r.unavailable_savings, r.full_responses, r.reference_responses, r.under_100_ms, r.under_1000_ms, r.over_1000_ms) == (2, 92, 18, 4, 1, 1, 1, 1, 1, 0)
    assert report.event_report(spark.createDataFrame([], "event string, data map<string,string>")).first().calls == 0


def test_judged(spark):
    targets = spark.createDataFrame([("t", "a.ts", "exact"), ("t", "zzz", "contains"), ("u", "q", "contains")], "task string, target string, mode string")
    evidence = spark.createDataFrame([("t", 1, "x/a.ts"), ("t", 2, "a.ts"), ("t", 3, "none")], "task string, rank int, text string")
    m = {r.task: r for r in report.task_metrics(report.evidence_ranks(targets, evidence)).collect()}
    assert (m["t"].hits, m["t"].recall_pct, m["t"].first_rank, m["t"].reciprocal_rank, m["t"].precision_at_3, m["t"].top1, m["t"].top3) == (1, 50.0, 2, 0.5, 0.333, False, True) and m["u"].reciprocal_rank == 0.0
    total = report.metrics_summary(report.task_metrics(report.evidence_ranks(targets, evidence))).first()
    assert (total.tasks, total.targets, total.hits, total.mean_reciprocal_rank) == (2, 3, 1, 0.25)
    files_ = spark.createDataFrame([("src/a", "x" * 9), ("lib/b", "y")], "path string, content string")
    assert tuple(report.baseline_tokens(files_, ["src/**"]).first()) == (1, 3)
    assert {tuple(r) for r in report.first_occurrences(spark.createDataFrame([("a", 3), ("a", 1)], "k string, p int"), "k", "p").collect()} == {("a", 1)}


def test_session_references(spark):
    rows = [("s", T0, "x"), ("s", T0 + timedelta(minutes=1), "x"), ("s", T0 + timedelta(minutes=2), "y"), ("s", T0 + timedelta(minutes=30), "x"), ("t", T0, "x")]
    found = report.session_references(spark.createDataFrame(rows, "session string, ts timestamp, content_id string"))
    assert [r.representation for r in found.orderBy("session", "ts").collect()] == ["full", "reference", "full", "full", "full"]


# -- streams


def run(stream, checkpoint, rows):
    """Take what is there, add its results to rows, and stop; the next call goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(lambda batch, n: rows.extend(batch.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
    return rows


def feed(folder, name, rows):
    fresh = os.path.join(folder, f".{name}")
    with open(fresh, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.replace(fresh, os.path.join(folder, f"{name}.json"))


def test_debounce_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    at = lambda s: (T0 + timedelta(seconds=s)).isoformat() + "Z"
    feed(folder, "a", [{"path": "b", "kind": "changed", "at": at(0)}, {"path": "a", "kind": "new", "at": at(0.05)}, {"path": "b", "kind": "changed", "at": at(0.1)}, {"path": "c", "kind": "new", "at": at(5)}])
    rows = []
    run(watch.debounced(watch.change_feed(spark, folder), 100, "0 seconds"), tmp_path / "cp", rows)
    feed(folder, "b", [{"path": "z", "kind": "new", "at": at(60)}])
    run(watch.debounced(watch.change_feed(spark, folder), 100, "0 seconds"), tmp_path / "cp", rows)
    assert [(r.paths, r.events) for r in sorted(rows, key=lambda r: r.first_at)] == [(["a", "b"], 3), (["c"], 1)]


def test_watch_retries_and_coalesces(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    feed(folder, "a", [{"path": "a", "kind": "new", "at": "2026-01-01T00:00:00Z"}, {"path": "a", "kind": "deleted", "at": "2026-01-01T00:00:01Z"}])
    seen = []

    def fail_once(paths, number):
        seen.append({(r.path, r.kind) for r in paths.collect()})
        if len(seen) == 1:
            raise RuntimeError("not yet")

    for _ in range(2):
        query = watch.watch(watch.change_feed(spark, folder), fail_once, str(tmp_path / "cp"), trigger={"availableNow": True})
        try:
            query.awaitTermination(60)
        except Exception:
            pass
        finally:
            query.stop()
    assert seen == [{("a", "deleted")}] * 2 and watch.poll_interval(10) == 50 and watch.poll_interval(999) == 250


def test_report_and_session_streams(spark, tmp_path):
    folder, other = str(tmp_path / "in"), str(tmp_path / "se")
    os.makedirs(folder)
    os.makedirs(other)
    at = lambda m: (T0 + timedelta(minutes=m)).isoformat() + "Z"
    feed(folder, "a", [{"id": str(i), "ts": at(i), "event": report.FINISHED, "data": {"durationMs": str(d)}} for i, d in enumerate((50, 500, 5000))] + [{"id": "x", "ts": at(1), "event": "other", "data": {}}])
    stream = spark.readStream.schema(schema.EVENTS).json(folder)
    rows = run(watch.report_stream(stream, late="0 seconds"), tmp_path / "cp1", [])
    feed(folder, "b", [{"id": "9", "ts": at(60), "event": report.FINISHED, "data": {"durationMs": "1"}}])
    run(watch.report_stream(stream, late="0 seconds"), tmp_path / "cp1", rows)
    assert [(r.calls, r.under_100_ms, r.under_1000_ms, r.over_1000_ms) for r in rows] == [(3, 1, 1, 1)]
    feed(other, "a", [{"session": "s", "content_id": c, "ts": at(m)} for m, c in ((0, "x"), (1, "x"), (2, "y"), (40, "x"))])
    answers = spark.readStream.schema("session string, content_id string, ts timestamp").json(other)
    rows = run(sessions.session_references_stream(answers), tmp_path / "cp2", [])
    feed(other, "b", [{"session": "s", "content_id": "x", "ts": at(41)}])
    run(sessions.session_references_stream(answers), tmp_path / "cp2", rows)
    assert [r.representation for r in sorted(rows, key=lambda r: r.ts)] == ["full", "reference", "full", "full", "reference"]
    assert sessions.remember(["a", "b"], "c", 2) == ("full", ["b", "c"])
