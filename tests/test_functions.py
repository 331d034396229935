import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodeglass.functions import codec, validation
from lodeglass.functions.hashing import chained_snapshot_hash, content_fingerprint, content_id, integrity_hash, snapshot_hash, symbol_id
from lodeglass.functions.imports import clause_specifiers, extract_imports, parse_specifiers
from lodeglass.functions.languages import discovery_summary, language_by_extension, language_of, support_reason, support_tier
from lodeglass.functions.privacy import redact_map, redact_secrets, sanitize_event_data, secret_like
from lodeglass.functions.text import basename, byte_slice, comment_summary, contains_word, dirname, extension, glob_regex, inside_root, line_window, matches_allowed, path_matches, phrases, query_terms, query_tokens, squeeze, token_estimate, words


def one(spark, expr, **cols):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_terms():
    assert query_tokens(" Refresh session_Token! ") == ["refresh", "session_token"]
    assert query_terms("a b a") == ["a b a", "a", "b"] and query_terms("  ") == []
    assert phrases("foo_bar x") == [["foo", "bar", "x"], ["foo", "bar"]]


def test_words(spark):
    assert one(spark, words(F.lit("fooBar_baz Größe-2"))) == ["foobar", "baz", "größe", "2"] and one(spark, words(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("glob,path,hit", [
    ("src/**/*.ts", "src/a.ts", True), ("src/**/*.ts", "src/a/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("*.{ts,js}", "a.js", True), ("*.{ts,js}", "a.py", False), ("**/*.ts", ".hidden/a.ts", True), ("a?c.ts", "abc.ts", True),
    ("[ab].ts", "b.ts", True), ("[!ab].ts", "b.ts", False), ("src/**", "src/a/b", True), ("src/**", "src", True), ("./a.ts", "a.ts", True), ("src\\*.ts", "src/a.ts", True), ("**", "x/y", True), ("a.b", "aXb", False),
])
def test_globs(glob, path, hit):
    assert bool(re.match(glob_regex(glob), path)) == hit


def test_path_matches(spark):
    rows = spark.createDataFrame([("src/a.ts",), ("src/a.test.ts",), ("lib\\b.ts",), (None,)], "p string")
    got = [r.p for r in rows.where(path_matches("p", ["**/*.ts"], ["**/*.test.ts"])).collect()]
    assert got == ["src/a.ts", "lib\\b.ts"]
    assert rows.where(path_matches("p")).count() >= 3
    assert [r.p for r in rows.where(matches_allowed(F.col("p"), ["src/**"])).collect()] == ["src/a.ts", "src/a.test.ts"]


def test_inside_root():
    assert inside_root("./a/../b.ts") == "b.ts" and inside_root("a\\b") == "a/b"
    for bad in ("", "/etc/x", "../x", "a/../../x", "C:\\x"):
        with pytest.raises(ValueError):
            inside_root(bad)


def test_paths(spark):
    assert one(spark, dirname(F.lit("a/b/c.ts"))) == "a/b" and one(spark, dirname(F.lit("c.ts"))) == "." and one(spark, basename(F.lit("a/c.ts"))) == "c.ts"
    assert one(spark, extension(F.lit("a.b/C.TS"))) == ".ts" and one(spark, extension(F.lit("a/.env"))) == "" and one(spark, extension(F.lit("x"))) == ""


def test_text(spark):
    assert one(spark, squeeze(F.lit("  a \n\t b "))) == "a b"
    assert one(spark, token_estimate(F.lit("12345"))) == 2 and one(spark, token_estimate(F.lit(""))) == 1
    assert one(spark, contains_word(F.lit("a Session b"), "session")) and not one(spark, contains_word(F.lit("sessions"), "session")) and one(spark, contains_word(F.lit("x a.b y"), "a.b")) and not one(spark, contains_word(F.lit("x aXb y"), "a.b"))
    assert one(spark, comment_summary(F.lit("/**\n * \n * First line.\n * more\n */"))) == "First line." and one(spark, comment_summary(F.lit("//\n// a  b"))) == "a b" and one(spark, comment_summary(F.lit("/** */"))) is None


def test_lines_and_bytes(spark):
    text = "Größe\r\nzwei\r\ndrei\nvier"
    w = line_window(F.lit(text), F.lit(2), F.lit(3), 0)
    row = spark.range(1).select(*(c.alias(n) for n, c in w.items())).first()
    raw = text.encode()
    assert row.source == "zwei\r\ndrei" and raw[row.start_byte : row.end_byte].decode() == row.source and (row.start_line, row.end_line) == (2, 3)
    wide = spark.range(1).select(*(c.alias(n) for n, c in line_window(F.lit(text), F.lit(2), F.lit(3), 9).items())).first()
    assert (wide.source, wide.start_byte, wide.end_byte) == (text, 0, len(raw))
    assert one(spark, byte_slice(F.lit(text), F.lit(0), F.lit(7))) == "Größe"


def test_hashes(spark):
    assert one(spark, integrity_hash(F.lit("abc"))) == "sha256:" + hashlib.sha256(b"abc").hexdigest()
    assert spark.createDataFrame([("abc",), (None,)], "t string").select(content_fingerprint("t")).collect()[0][0] == "xxh64:44bc2cf5ad770999"
    assert one(spark, symbol_id(F.lit("a.ts"), F.lit("function"), F.lit("f"), F.lit(3))) == hashlib.sha256(b"a.ts:function:f:3").hexdigest()[:16]
    rows = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, content_hash string")
    assert snapshot_hash(rows).first()[0] == hashlib.sha256(b"a:1\nb:2").hexdigest()
    assert chained_snapshot_hash(rows).first() == chained_snapshot_hash(rows.repartition(3)).first() != chained_snapshot_hash(rows.limit(1)).first()
    assert len(rows.select(content_id("path").alias("i")).first().i) == 64


def test_privacy(spark):
    key = "sk-" + "a1" * 12
    assert one(spark, secret_like(F.lit("x " + key))) and not one(spark, secret_like(F.lit("sk-short"))) and one(spark, secret_like(F.lit(None).cast("string"))) is False
    assert one(spark, redact_secrets(F.lit(f"a {key} b"))) == "a [REDACTED:secret] b"
    data = spark.range(1).select(F.create_map(F.lit("content"), F.lit("code"), F.lit("a.preview"), F.lit("p"), F.lit("n"), F.lit(key)).alias("m"))
    assert data.select(sanitize_event_data("m").alias("m")).first().m == {"content": "[REDACTED:source-text]", "a.preview": "[REDACTED:source-text]", "n": "[REDACTED:secret]"}
    assert data.select(sanitize_event_data("m", False).alias("m")).first().m["content"] == "code" and data.select(redact_map("m").alias("m")).first().m["n"] == "[REDACTED:secret]"


def test_languages(spark):
    assert one(spark, language_of(F.lit("a/B.MJS"))) == "js" and one(spark, language_of(F.lit("x.md"))) is None
    assert [one(spark, support_tier(F.lit(p))) for p in ("a.ts", "a.go", "a.md")] == ["graph", "structured", "discovery"]
    assert [one(spark, support_reason(F.lit(p))) for p in ("a.ts", "a.md", "a.bin")] == ["supported-language", "fallback-extension", "generic-discovery"]
    with pytest.raises(ValueError):
        language_by_extension({"a": (".x",), "b": (".X",)})


@pytest.mark.parametrize("path,text,source,summary,hints", [
    ("a.md", "# One\n\ntext\n## Two\n", "markdown-headings", "Markdown file with 2 headings", ["One", "Two"]), ("a.yml", "a: 1\nb-c:\n  d: 2\n", "yaml-top-level-keys", "YAML file with 2 top-level keys", ["a", "b-c"]),
    ("a.sql", 'CREATE TABLE "x.y" (a int);\nalter view z as', "sql-schema-objects", "SQL file with 2 schema object references", ["x.y", "z"]), ("a.txt", "\n one \r\n", "text-lines", "Discovery-only file with 1 non-empty line", ["one"]),
])
def test_summaries(spark, path, text, source, summary, hints):
    row = spark.range(1).select(*(c.alias(n) for n, c in discovery_summary(F.lit(path), F.lit(text)).items())).first()
    assert (row.summary_source, row.summary, row.hints) == (source, summary, hints)


def test_import_clauses(spark):
    got = lambda c: [tuple(s) for s in one(spark, clause_specifiers(F.lit(c)))]
    assert got("a, { b as c, type d, e }") == [("default", "default", "a"), ("named", "b", "c"), ("named", "d", "d"), ("named", "e", "e")]
    assert got("* as ns") == [("namespace", "*", "ns")] and got("type { T }") == [("named", "T", "T")] and got("") == []


def test_imports_and_stored_specifiers(spark):
    text = 'import a from "./a";\nimport {\n  b,\n  c as d\n} from \'../b.js\'\nexport * from "./e";\nimport "./side";\nconst x = 1;\n'
    rows = extract_imports(spark.createDataFrame([(1, text), (2, None)], "file_id bigint, content string")).collect()
    assert {(r.source, tuple(s.importedName for s in r.specifiers)) for r in rows} == {("./a", ("default",)), ("../b.js", ("b", "c")), ("./e", ()), ("./side", ())}
    stored = lambda j: [s.importedName for s in one(spark, parse_specifiers(F.lit(j)))]
    assert stored('[{"kind":"named","importedName":"a","localName":"b"},{"kind":"odd"}]') == ["a"] and stored('["x","y"]') == ["x", "y"] and stored("{bad") == [] and stored("[]") == []


def test_validation():
    assert validation.seeds(" q ", ["b", "a", "b", " "]) == ("q", ("b", "a")) and validation.relation_depth(9) == 3 and validation.relation_depth(None) == 1
    for call in (lambda: validation.seeds(" ", []), lambda: validation.query_text(" "), lambda: validation.positive_limit(0), lambda: validation.context_lines(-1), lambda: validation.kind_and_language("x", None), lambda: validation.kind_and_language(None, "x"), lambda: validation.relation_depth(4, True), lambda: validation.intent("x")):
        with pytest.raises(ValueError):
            call()


def test_compact_rows_round_trip(spark):
    rows = spark.createDataFrame([("a/b.ts", None, 3), ('q"x', "ts", 0)], "path string, language string, symbolCount int")
    packed = rows.select("*", codec.compact_row({c: F.col(c) for c in rows.columns}, codec.TREE_FIELDS).alias("c"))
    for r in packed.select("*", codec.expand_row(F.col("c"), codec.TREE_FIELDS).alias("m")).collect():
        assert r.m == {"path": r.path, "language": r.language, "symbolCount": str(r.symbolCount)}
    assert one(spark, codec.expand_row(F.lit("[1]"), codec.TREE_FIELDS)) is None
    assert one(spark, codec.worth_compacting(F.lit(100), F.lit(70))) and not one(spark, codec.worth_compacting(F.lit(100), F.lit(90))) and not one(spark, codec.worth_compacting(F.lit(40), F.lit(25)))
    assert [one(spark, codec.error_code(F.lit(m))) for m in ("Unknown tool x", "limit must be positive", "boom")] == ["tool_not_found", "invalid_argument", "internal_error"]
