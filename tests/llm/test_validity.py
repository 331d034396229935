import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeglass.llm.parsing import syntax_errors
from lodeglass.llm.validity import acceptance, parsed_files

GOOD = {
    "js": ['import a, {b as c} from "x";\nexport default class extends A { static #x=1; get y(){return this.#x} }', "for(const x of y) z(x)\nx=>y\nasync (a,b)=>{await c}", "`a${b+`c${d}`}e`; let r = /a[/]b/g.test(x) ? 1 : 2; a / b / c", 'f("<<<<<<< ours"); // ((('],
    "ts": ["export function a<T extends B = C>(x?: T[], ...y: Map<string, Array<T>>[]): x is T { return x as unknown as T }", "type X = keyof typeof a | {[K in T as U]?: V} & ((a: b) => c)", "abstract class A<T> implements B { private readonly x: number = 1; abstract f(): void; get z(): T { return x! } }", "const f = <T,>(x: T): x is T => x; f<string>(1); a < b; x = y ? (z) : w"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n)\n\ntype T[K comparable] struct { sync.Mutex; a, b int `x` }\n\nfunc (t *T[K]) f(a ...string) (x, y int) {\n\tif x, ok := m[\"a\"]; ok && (x == T{}) { return }\n\tswitch v := x.(type) { case int, *string: a(); default: }\n\tgo func() { defer w.Done() }()\n\treturn 1, 2\n}\n"],
    "java": ["package a.b;\nimport java.util.*;\npublic class X<T extends A & B> extends Y<List<Map<String, T>>> {\n  int[] a = {1}; X() { this(1); }\n  <U> List<? super U> f(final String i, int... n) throws E { for (String s : x) { g(s); } int c = a < b ? 1 : 2 >> 1; Runnable r = () -> {}; return (List<U>) o; }\n  enum E { A(1) { void f() {} }, B; int x; }\n}"],
    "bash": ["#!/bin/bash\nf() {\n  if [ -n \"$1\" ]; then echo \"a $(b \"c\") ${d:-x}\"; fi\n  for i in \"$@\"; do g; done\n}\ncat <<'E'\n( \" '\nE\ncase $1 in a|b) x;; *) y;; esac\n"],
    "json": ['{"a":[true,null,-1.5e3,"\\u00e9"]}', " 1 "],
    "python": ["def f(a, *, b=1, **c):\n    '''x'''\n    return [y for y in a if y != 3]\n\nclass A(B):\n    async def g(self):\n        async with x as y: await z\n", "match x:\n    case [1, *y] if z: pass\n    case A(b=1) | None: pass\n"],
}
BAD = {
    "js": ["<<<<<<< HEAD\na", "return 1", "if ((", "class A", "const x", "let x: string = 1", '"abc', "<!doctype html>", "x = 1 = 2", "{"],
    "ts": ["function (", "from a import b", 'import  a } from "x";', "function f(x: ) {}", 'return "x;'],
    "go": ["func f() {}", "package a\nx := 1", "package a\nfunc f() {\n if ((\n}", "package a\nfunc f() { x y }", "package a\nfunc f() {", "import os"],
    "java": ["class A {", "class A { int x = ; }", "import os", "def f(x):\n  pass", "class A { void f() { a + b; } }", "class A { } }"],
    "bash": ["if x; then", "f() {", 'echo "abc', "fi", "<<<<<<< HEAD", "def f(value, limit=1):", "echo ${a", "a && ", "if x; then\nfi"],
    "json": ["", "{,}", "[1,]", "{a:1}", "{'a':1}", "01", "NaN", "// x\n{}", '{"a":1}}'],
    "python": ["x = = 1", "def f():\nreturn 1", "  x=1", 'print "x"', "<<<<<<< HEAD", "x = (1", "class A\n  pass", "def f():\n    x\n  y\n", "else:\n  x", "const x = 1;"],
}


@pytest.mark.parametrize("language", GOOD)
def test_accepted(language):
    for text in GOOD[language]:
        assert syntax_errors(text, language) == [], text


@pytest.mark.parametrize("language", BAD)
def test_refused(language):
    for text in BAD[language]:
        assert syntax_errors(text, language), text


@pytest.mark.parametrize("language", ["js", "ts", "go", "java", "bash", "python"])
def test_every_truncation_inside_brackets_is_refused(language):
    text = GOOD[language][0]
    for at in range(1, len(text)):
        errors = syntax_errors(text[:at], language)
        if language == "python":
            try:
                ast.parse(text[:at])
                assert errors == []
            except SyntaxError:
                assert errors


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=20))
def test_json_agrees_with_the_library(value):
    text = json.dumps(value)
    assert syntax_errors(text, "json") == []
    assert syntax_errors(text + ",", "json")


def test_recovery_finds_all_errors_with_lines():
    text = "function a() {\n  x = ;\n  y();\n  z = = 1;\n}\nconst q = 1;\nlet = = 2;\n"
    assert [n for n, _ in syntax_errors(text, "js")] == [2, 4, 7]


def test_deep_nesting_and_long_texts():
    assert syntax_errors("(" * 100_000, "js") is None or syntax_errors("(" * 100_000, "js")
    assert syntax_errors("[" * 50_000 + "]" * 50_000, "json") == []
    assert syntax_errors("a = 1;\n" * 50_000, "js") == []


def test_operator(spark):
    files = spark.createDataFrame([(1, "json"), (2, "js"), (3, "css"), (4, None), (5, "python")], "file_id long, language string")
    rows = [(1, "r/a.json", "{", 1), (2, "r/b.js", "a();\n", 1), (2, "r/b.js", "a();\n", 1), (3, "r/c.css", "{", 1), (4, "r/d", "x", 1), (5, "s/e.py", None, 1), (None, "s/f.py", "x", 1), (7, "s/g.py", "x", 1)]
    contents = spark.createDataFrame(rows, "file_id long, path string, content string, valid int")
    parsed = parsed_files(files, contents)
    assert {r.file_id: r.valid for r in parsed.collect()} == {1: False, 2: True, 3: None, 4: None, 7: None}
    assert {(r.repository, r.language, r.files, r.invalid) for r in acceptance(parsed).collect()} == {("r", "json", 1, 1), ("r", "js", 1, 0)}
    assert parsed_files(files.limit(0), contents.limit(0)).count() == 0


@pytest.mark.parametrize("language, bad, good", [("js", "let = = 1;\n", "let a = 1;\n"), ("go", "package a\n\nfunc f( {\n}\n\n", "package a\n\n"), ("python", "x = = 1\n", "x = 1\n")])
def test_errors_before_nesting_beyond_measure(language, bad, good):
    deep = ("var x = " if language == "go" else "x = ") + "(" * 6000 + "1" + ")" * 6000 + "\n"
    errors = syntax_errors(bad + deep, language)
    assert errors and errors[0][0] <= 3
    assert not syntax_errors(good + deep, language)


PYTHON = """import os
from a.b import (c, d as e)

@dec(1)
class A(B, metaclass=C):
    x: int = 0x1f + 1_000 - 0o17
    async def f(self, a, /, b=1, *args, c, **kw) -> None:
        async with x as y, z:
            await q
        return [w async for w in v if w]
    def g(self):
        total = 0
        def h():
            nonlocal total
            total += 1
        for i in range(3):
            if i: continue
            yield i
        else:
            pass
        with open(f"{x!r:>{w}} {a['k']} {{}}") as f: print(f'{x = }', "\\N{DASH}".lower(), b"\\x00", r"\\N")
        try:
            del a[0], b.c
        except (E, F) as e:
            raise G from e
        finally:
            lambda p, q=1, *r: p if q else r
match x:
    case {"a": [1, *_], **rest} if rest: pass
    case A(b=1) | None: pass
while True:
    if a and not b or c: break
"""


def compiles(text, read=lambda t: compile(t, "text", "exec", dont_inherit=True)):
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            read(text)
        return True
    except (SyntaxError, ValueError):
        return False


def own_verdict(text):
    """The parser's own word, before the library is asked."""
    from lodeglass.llm.parsing import python_text

    p = python_text.Python(*python_text.kinds(text))
    p.parse()
    return not p.errors


PIECES = ["0777", "00", "0.7", "\t", " ", "    ", "\n", ":", "break", "await x", "yield", "nonlocal a", "return", "a, a", "(", ")", "[", "]", "=", "==", "else:", "*", "**k", "f'{a b}'", "f'{a}'", '"\\N{foo}"', '"\\x4"', "b'\u00e9'", "lambda a, a: 1", "async ", "def f(a, a): pass", "if", "in", "not", ",", "\"", "#"]


@settings(max_examples=400, deadline=None)
@given(st.integers(0, len(PYTHON)), st.integers(0, 6), st.sampled_from(PIECES))
def test_changed_python_agrees_with_the_compiler(at, cut, piece):
    assert compiles(PYTHON.replace("DASH", "EM DASH")) and own_verdict(PYTHON.replace("DASH", "EM DASH"))
    text = PYTHON.replace("DASH", "EM DASH")
    text = text[:at] + piece + text[at + cut :]
    accepted = syntax_errors(text, "python") == []
    # what only the table of names can tell (a nonlocal without a binding) isn't syntax
    assert accepted if compiles(text) else not accepted or compiles(text, ast.parse)


@pytest.mark.parametrize("text", ["x = 0777", "x = 09", '"\\N{foo}"', "f'{a b}'", "if a:\n        x\n\ty\n", "def f(a, a): pass", "lambda a, *a: 1", "break", "nonlocal x", "await x", "def f():\n  await x", "class A:\n  yield 1", "try:\n  a\nexcept A, e:\n  b", '"\\xg"', 'f"{a!z}"', 'f"{}"', 'f"{a"', 'f"}"'])
def test_python_is_refused_by_the_parser_itself(text):
    assert not compiles(text) and not own_verdict(text)


def test_modules_are_strict_and_declare_once():
    for text in ("let a; let a", "const a = 1;\nclass a {}\n", "function f() {}\nfunction f() {}\n", "x = 010;", "x = 09;", "let a = 1\nlet a = 2"):
        assert syntax_errors(text, "js"), text
    assert syntax_errors("var b;\nvar b;\nlet x; { let x; }\nfunction c() {\nlet d;\n}\nfunction e() {\nlet d;\n}\nconst y = `\nlet y; let y\n`;", "js") == []


def test_nesting_in_linear_time():
    import sys
    import time

    began, limit = time.process_time(), sys.getrecursionlimit()
    for language, text in (("js", "(" * 50_000), ("js", "(" * 50_000 + "a" + ")" * 50_000), ("ts", "f<" * 20_000), ("java", "class A { void f() { x = " + "(" * 20_000 + "1" + ")" * 20_000 + "; } }"), ("python", "[" * 50_000), ("bash", "(" * 20_000), ("go", "package a\nvar x = " + "(" * 20_000)):
        assert syntax_errors(text, language) is not None, language
    assert time.process_time() - began < 60 and sys.getrecursionlimit() == limit


def test_files_whose_language_their_ending_does_not_tell(spark):
    files = spark.createDataFrame([(1, "json"), (2, "python"), (3, "js"), (4, None)], "file_id long, language string")
    contents = spark.createDataFrame([(1, "r/a.py", "{}"), (2, "r/b", "x = = 1"), (3, "r/c.JS", "x = ;"), (4, "r/d.py", "x = = 1"), (2, None, "x = 1")], "file_id long, path string, content string")
    for limit in (100, 0):
        assert {(r.file_id, r.path, r.language, r.valid) for r in parsed_files(files, contents, broadcast_rows=limit).collect()} == {(1, "r/a.py", "json", True), (2, "r/b", "python", False), (3, "r/c.JS", "js", False), (4, "r/d.py", None, None), (2, None, "python", True)}
