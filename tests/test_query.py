import pytest

from lodeglass.operators.graph import CodeIndex
from lodeglass.operators.query import Discovery, Sources, query_code, query_intent, search_text_or_live
from lodeglass.schema import CONTENT, DEPENDENCIES, FILES, IMPORTS, SYMBOLS

BODY = "import { two } from './b';\nexport function one() {\n  return two();\n}\n"


@pytest.fixture(scope="module")
def index(spark):
    empty = (None,) * 10
    files = spark.createDataFrame([(1, "src/a.ts", "ts", None, None, *empty[:9]), (2, "src/b.ts", "ts", None, None, *empty[:9])], FILES)
    contents = spark.createDataFrame([(1, "src/a.ts", BODY), (2, "src/b.ts", "export function two() { return 2; }\n"), (2, "src/b.ts", "export function two() { return 2; }\n")], CONTENT)
    row = lambda i, f, p, n, a, b: (i, f, p, n, n, "function", f"function {n}()", "", "signature", a, b, 0, 10, True)
    symbols = spark.createDataFrame([row("s1", 1, "src/a.ts", "one", 2, 4), row("s2", 2, "src/b.ts", "two", 1, 1), row("s2", 2, "src/b.ts", "two", 1, 1)], SYMBOLS)
    imports = spark.createDataFrame([(1, "./b", [("named", "two", "two")])], IMPORTS)
    edges = spark.createDataFrame([(1, "src/a.ts", "src/b.ts", "./b")], DEPENDENCIES)
    return CodeIndex(files, contents, symbols, imports, edges)


def test_intent():
    assert query_intent(None) == query_intent("auto") == "discover" and query_intent("auto", file_path="a") == query_intent(None, symbol_ids=["x"]) == "source"
    assert query_intent("discover", file_path="a") == "discover"
    with pytest.raises(ValueError):
        query_intent("guess")


def test_discover_with_relations_and_text(index):
    found = query_code(index, query="one", text=True, dependencies=True)
    assert isinstance(found, Discovery) and [r.id for r in found.symbols.collect()] == ["s1"]
    assert {(r.id, r.depth) for r in found.related.collect()} == {("s1", 0), ("s2", 1)}
    assert [(r.file_path, r.line, r.source) for r in found.text.collect()] == [("src/a.ts", 2, None)]
    plain = query_code(index, query="one")
    assert plain.text is None and {(r.id, r.depth) for r in plain.related.collect()} == {("s1", 0)}
    with pytest.raises(ValueError):
        query_code(index, query=" ")
    with pytest.raises(ValueError):
        query_code(index, query="one", depth=9)


def test_sources_and_what_is_missing(index):
    found = query_code(index, symbol_ids=["s1", "s1"], file_path="src/b.ts")
    assert isinstance(found, Sources) and found.symbols.collect()[0].source == "export function one() {\n  return two();\n}" and found.content.count() == 1
    for wrong in ({"symbol_ids": ["s1", "nope"]}, {"file_path": "src/none.ts"}):
        with pytest.raises(LookupError):
            query_code(index, **wrong)
    with pytest.raises(ValueError):
        query_code(index, intent="source")


def test_stale_indexes_answer_text_from_disk(spark, index):
    live = spark.createDataFrame([("src/a.ts", "one more\n"), ("lib/c.py", "x\none\n")], "path string, content string")
    for status in ("stale", "unknown", None):
        found = query_code(index, query="one", text=True, status=status, live=live)
        assert found.symbols is None and found.related is None and [(r.file_path, r.line, r.source) for r in found.text.collect()] == [("lib/c.py", 2, "live_disk_match"), ("src/a.ts", 1, "live_disk_match")]
    assert query_code(index, query="one", status="stale", live=live).symbols.count() == 1
    assert [r.file_path for r in search_text_or_live(index.contents, "one", status="stale", live=live, file_pattern="**/*.py").collect()] == ["lib/c.py"]
