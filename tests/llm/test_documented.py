import pytest

from lodeglass.llm.documented import comment_spans, documentation, documented_functions, with_code

REAL = ["/** Orders candidates by distance first. */", "/**\n * @internal\n * Walks the list in byte order.\n */", "// loadMap.\n// Callers must hold the lease.", '"""Returns the path of the cache.\n\n@param x\n"""', "/* Note:\n   Guards against a dirty list. */", "# @deprecated\n# Merges two rows of one file."]
EMPTY = ["/** */", "// TODO", "/** TODO: document */", "/** {@inheritDoc} */", "/** @internal */", "// load map", "/** The load map. */", "/** Function loadMap */", "// eslint-disable-next-line no-console", "# noqa", "/** --------- */", "/** @param input - input @return return value */", "// @param input\n// @returns", "/** return oldLoadMap(input); */", "// ...", '"""FIXME"""', "/** XXX later */", "/** Loads map. */"]


@pytest.mark.parametrize("text", REAL)
def test_real(text):
    assert documentation(text, "loadMap")


@pytest.mark.parametrize("text", EMPTY)
def test_empty(text):
    assert documentation(text, "loadMap") is None


def test_spans():
    code = b'x = "/* no */"; // behind code\n// a\n// b\n\nfunction f() {}\n'
    spans = comment_spans(code, "a.ts")
    assert [(k, code[a:b], code[n : n + 8]) for k, a, b, n, _ in spans] == [("comment", b"// a\n// b", b"function")]
    py = b'def f(a, b="):"):\n    """Doc."""\n    return "def g():"\n\nclass A:\n    async def h(self):\n        # first\n        \'\'\'More.\'\'\'\n'
    assert [(k, t, py[n : n + 5]) for k, _, _, n, t in comment_spans(py, "a.py") if k == "docstring"] == [("docstring", '"""Doc."""', b"def f"), ("docstring", "'''More.'''", b"async")]


def test_operator(spark):
    code = "/** Größe: sorts the rows by their size. */\nfunction sortRows() {}\n\n// Only about the constant below.\nconst a = 1;\nfunction other() {}\n\n/** Splits lines at their ends. */\n\nfunction split() {}\n"
    raw = code.encode()
    at = lambda s: raw.index(s.encode())
    symbols = spark.createDataFrame(
        [("a", 1, "sortRows", "function", "sig a", at("function sortRows"), 0), ("a", 1, "sortRows", "function", "sig a", at("function sortRows"), 0), ("b", 1, "other", "function", "sig b", at("function other"), 0), ("c", 1, "split", "method", "sig c", at("function split"), 0), ("d", 1, "a", "constant", "sig d", at("const a"), 0), ("e", 1, None, "function", None, None, 0), (None, 1, "x", "function", "s", 0, 0), ("f", 2, "x", "function", "s", 0, 0)],
        "id string, file_id long, name string, kind string, signature string, start_byte int, documentation int",
    )
    contents = spark.createDataFrame([(1, "p/x.ts", code), (1, "p/x.ts", code), (2, "p/y.ts", None), (None, "p/z.ts", code)], "file_id long, path string, content string")
    pairs = documented_functions(symbols, contents)
    assert {(r.symbol_id, r.documentation, r.code) for r in with_code(pairs, symbols).collect()} == {("a", "Größe: sorts the rows by their size.", "sig a"), ("c", "Splits lines at their ends.", "sig c")}
    assert documented_functions(symbols.limit(0), contents.limit(0)).count() == 0


def test_long_headers_keep_their_docstring():
    header = "def load(\n" + "".join(f"    name{i}: str = 'x',  # (see: {i}\n" for i in range(400)) + ") -> None:\n"
    spans = comment_spans((header + '    """Reads all of it."""\n').encode(), "a/x.py")
    assert [(s[0], s[3], s[4]) for s in spans if s[0] == "docstring"] == [("docstring", 0, '"""Reads all of it."""')]
    assert not [s for s in comment_spans(b'def load(a,\ndef other():\n    """Reads."""\n', "a/x.py") if s[0] == "docstring" and s[3] == 0]


def test_syntax_of_late_declarations():
    late = "VALUE = 1\n" * 3000 + "\n# Reads all of it.\ndef load(name):\n    return name\n"
    assert [s[4] for s in comment_spans(late.encode(), "a/x.ts")] == ["# Reads all of it."]


def test_scripts_without_blanks_and_short_comments():
    from lodeglass.llm.documented import documentation

    assert documentation("/** \u30d5\u30a1\u30a4\u30eb\u306e\u5185\u5bb9\u3092\u8aad\u307f\u8fbc\u3093\u3067\u89e3\u6790\u3059\u308b */", "parseFile") and documentation("// \u8bfb\u53d6\u6587\u4ef6\u5e76\u8fd4\u56de\u5185\u5bb9", "read")
    assert documentation("// \u8bfb", "read") is None and documentation("// x", "read") is None
