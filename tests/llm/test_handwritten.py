import time

from lodeglass.llm.handwritten import file_origins, origin, statistics

CODE = "package a\n\nimport \"fmt\"\n\nfunc Do(input []string) any {\n\tfor _, x := range input {\n\t\tfmt.Println(x)\n\t}\n\treturn input\n}\n" * 4
FILES = "file_id long, language string, path string, extra int"
CONTENTS = "file_id long, path string, content string, language string, origin string"


def kind(path, language, content):
    return origin(path, language, content)[0]


def test_generated_by_note_and_name():
    assert kind("a/b/src/x.go", "go", "// Code generated by protoc. DO NOT EDIT.\n" + CODE) == "generated"
    assert kind("a/b/src/x.go", "go", CODE.replace("func Do", "// @generated by x\nfunc Do", 1)) == "generated"
    assert kind("a/b/src/x.pb.go", "go", CODE) == "generated"
    assert kind("a/b/package-lock.json", "json", "{}") == "generated"


def test_mentions_are_written_by_hand():
    assert kind("a/b/src/gen.go", "go", CODE + 'const banner = "Code generated by x. DO NOT EDIT."\n') is None
    assert kind("a/b/src/gen.go", "go", "// Used by the code generator, whose output starts with: Code generated by x.\n" + CODE) is None
    assert kind("a/b/src/generated_marker_list.go", "go", CODE) is None
    assert kind("a/b/src/vendor-list.go", "go", "// Do not edit the vendor list without asking.\n" + CODE) is None


def test_minified_and_long_imports():
    assert kind("a/b/x.js", "js", "".join(f"function a{i}(x){{return x.b({i})}};" for i in range(60))) == "minified"
    names = "import { " + ", ".join(f"collectEverythingNumber{i}" for i in range(40)) + ' } from "./x.js";\n'
    assert kind("a/b/x.js", "js", names + "export const a = 1;\n") is None


def test_data_and_configuration():
    assert kind("a/b/x.py", "python", "TABLE = [\n" + "".join(f"  {i}, {i * 7}, {i * 13},\n" for i in range(60)) + "]\n") == "data"
    assert kind("a/b/x.json", "json", "{\n" + ",\n".join(f'  "optionName{i}": "some sentence about this option"' for i in range(30)) + "\n}") is None


def test_twins_edges_and_salted_join(spark):
    note = "/*! kit 1.2 - upstream copy, see https://kit.invalid/license */\n"
    files = spark.createDataFrame([(i, "go", "p", i) for i in range(1, 8)] + [(None, "go", "p", 0)], FILES)
    rows = [(1, "r/p/vendor/k/x.go", CODE, "a", "b"), (2, "r/p/src/y.go", CODE, "a", "b"), (3, "r/p/src/z.go", note + CODE.replace("\n", "\r\n"), "a", "b"), (4, "r/p/src/own.go", CODE + "var a = 1\n", None, None), (5, "r/p/src/e.go", "", None, None), (6, None, None, None, None), (2, "r/p/src/y.go", CODE, "a", "b"), (9, "r/q/src/nofile.go", CODE[:90], None, None)]
    contents = spark.createDataFrame(rows, CONTENTS)
    for limit in (100, 0):
        got = {r.file_id: r.origin for r in file_origins(files, contents, broadcast_rows=limit).collect()}
        assert got == {1: "vendored", 2: "vendored", 3: "vendored", 4: None, 5: None, 9: None}
    assert file_origins(files.limit(0), contents.limit(0)).count() == 0


def test_notes_behind_long_heads():
    licence = "".join(f"// clause {i}: as is, without any warranty of whatever kind for you\n" for i in range(100))
    imports = 'import { a } from "./a.js";\nimport {\n' + "".join(f"  name{i},\n" for i in range(80)) + '} from "./b.js";\nconst VERSION = "1.2";\n'
    code = "export function run(input) {\n  return input.map((x) => name1(x, VERSION));\n}\n" * 4
    for head in (licence, imports, licence + imports, "/*\n" + licence.replace("//", " *") + " */\n"):
        assert kind("a/b/src/x.js", "js", head + "// @generated by tool\n" + code) == "generated"
        assert kind("a/b/src/x.js", "js", head + "// upstream copy, see https://kit.invalid\n" + code) == "vendored"
        assert kind("a/b/src/x.js", "js", head + code + "// @generated by tool\n") is None
    assert kind("a/b/src/x.js", "js", "app.use(a);\n" * 40 + "// @generated by tool\n") is None


def test_long_lines_of_literals_are_data():
    words = [f'"{a}{b} sentence"' for a in ("first", "other", "third", "fourth", "fifth") for b in ("apple", "berry", "cherry", "lemon", "mango", "melon", "olive", "peach", "plum", "quince") for _ in range(4)]
    short, long = "NAMES = [\n  " + ",\n  ".join(words) + "\n]\n", "NAMES = [\n  " + ", ".join(words) + "\n]\n"
    assert max(map(len, long.split("\n"))) > 3000
    assert kind("a/b/x.py", "python", short) == kind("a/b/x.py", "python", long) == kind("a/b/x.ts", "typescript", long) == "data"
    code = 'def describe(value):\n    return "{}: {}".format(value.name, value)\n\n\n' * 60
    assert kind("a/b/x.py", "python", long + code) is None


def test_long_lines_in_linear_time():
    began = time.process_time()
    for line in ("1" * 500_000 + "x", '"' + "a" * 500_000, "1.5e7, " * 100_000 + "x", '"a" ' * 100_000 + "x"):
        assert statistics(line.encode())["literal_lines"] == 0
    assert time.process_time() - began < 10


def test_generated_by_layout_alone():
    fields = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta")
    ts = "".join(f'export interface {f.title()}Message {{\n  {f}Id: number;\n  {f}Name: string;\n}}\n\nexport function decode{f.title()}(reader: Reader): {f.title()}Message {{\n  return reader.read("{f}", {n});\n}}\n\n' for n, f in enumerate(fields))
    java = "".join(f"    public String get{f.title()}() {{\n        return this.{f};\n    }}\n    public void set{f.title()}(String {f}) {{\n        this.{f} = {f};\n    }}\n" for f in fields)
    assert kind("a/b/x.ts", "ts", ts) == "generated" and kind("a/b/x.java", "java", "class A {\n" + java + "}\n") == "generated"
    assert kind("a/b/x.ts", "ts", ts[:300]) is None and kind("a/b/x.go", "go", CODE * 10) is None


def test_evidence_is_reported_apart(spark):
    dense = "".join(f"function a{i}(x){{return x.b({i})}};" for i in range(60))
    rows = [(1, "r/p/src/x.js", dense, "", ""), (2, "r/p/src/x.pb.go", CODE, "", ""), (3, "r/p/dist/x.min.js", dense, "", ""), (4, "r/p/src/own.go", CODE + "var a = 1\n", "", "")]
    contents = spark.createDataFrame(rows, CONTENTS)
    files = spark.createDataFrame([(1, "js", "p", 0), (2, "go", "p", 0), (3, "js", "p", 0), (4, "go", "p", 0)], FILES)
    assert {r.file_id: (r.origin, r.layout, r.marked) for r in file_origins(files, contents).collect()} == {1: ("minified", "minified", None), 2: ("generated", None, "generated"), 3: ("minified", "minified", "minified"), 4: (None, None, None)}


def test_likely_folders_need_evidence(spark):
    body = CODE.replace("Do", "Own{0}").replace("input", "value{0}")
    own = [(i, f"r/p/external/f{i}.go", body.replace("{0}", str(i)), "", "") for i in range(9)]
    taken = [(20 + i, f"s/p/deps/k/f{i}.go", ("// upstream copy, see https://kit.invalid\n" if i % 4 else "") + body.replace("{0}", f"b{i}"), "", "") for i in range(9)]
    copy = [(40, "t/q/src/y.go", body.replace("{0}", "b0"), "", "")]
    contents = spark.createDataFrame(own + taken + copy, CONTENTS)
    files = spark.createDataFrame([], FILES)
    for limit in (100, 0):
        got = {r.file_id for r in file_origins(files, contents, broadcast_rows=limit).where("origin = 'vendored'").collect()}
        assert got == {20 + i for i in range(9)} | {40}
