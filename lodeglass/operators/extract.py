"""Symbols of source files, read without a grammar: declarations of a language by pattern, their ends by brackets or
indentation outside strings and comments."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.schema import SYMBOLS

_SKIP = {
    "c": re.compile(rb"""//[^\n]*|/\*[\s\S]*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`"""),
    "hash": re.compile(rb"""[rRbBuUfF]{0,2}(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})|\#[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""),
}
_N = rb"([A-Za-z_$\x80-\xff][\w$\x80-\xff]*)"
#: Per language: (kind, pattern whose first group is the name). Patterns match at the first character of a line's code.
_TOP = {
    "script": [
        ("function", re.compile(rb"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*" + _N)),
        ("class", re.compile(rb"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+" + _N)),
        ("type", re.compile(rb"(?:export\s+)?(?:declare\s+)?(?:interface|(?:const\s+)?enum|type)\s+" + _N + rb"\s*(?:<[^{=]*>)?\s*(?:extends\b|[{=])")),
        ("constant", re.compile(rb"(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+" + _N)),
    ],
    "python": [("function", re.compile(rb"(?:async\s+)?def\s+" + _N)), ("class", re.compile(rb"class\s+" + _N)), ("constant", re.compile(_N + rb"\s*(?::[^=\n]+)?=(?!=)"))],
    "go": [("method", re.compile(rb"func\s*\([^)]*\)\s*" + _N)), ("function", re.compile(rb"func\s+" + _N)), ("class", re.compile(rb"type\s+" + _N + rb"(?:\[[^\]]*\])?\s+struct\b")), ("type", re.compile(rb"type\s+" + _N)), ("constant", re.compile(rb"(?:const|var)\s+" + _N))],
    "java": [("class", re.compile(rb"(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed)\s+)*(?:class|record)\s+" + _N)), ("type", re.compile(rb"(?:(?:public|protected|private|static|sealed)\s+)*(?:interface|enum|@interface)\s+" + _N))],
    "bash": [("function", re.compile(rb"(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\s*\)\s*\{")), ("function", re.compile(rb"function\s+([A-Za-z_][\w-]*)\s*\{")), ("constant", re.compile(rb"(?:export\s+|readonly\s+)?([A-Za-z_]\w*)="))],
    "css": [("constant", re.compile(rb"([^\s{}@;/][^{};]*?)\s*\{"))],
}
_MEMBER = {
    "script": re.compile(rb"(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*#?" + _N + rb"\s*(?:<[^>(]*>)?\("),
    "java": re.compile(rb"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?(?:[\w$.<>\[\],?]+(?:\s*<[^>]*>)?\s+)?" + _N + rb"\s*\("),
    "python": re.compile(rb"(?:async\s+)?def\s+" + _N),
}
_NOT_MEMBERS = frozenset(b"if for while switch catch return new function else do try throw super await".split())
_FAMILY = {"ts": "script", "tsx": "script", "js": "script", "jsx": "script", "python": "python", "go": "go", "java": "java", "bash": "bash", "css": "css", "json": "json", "csharp": "java", "scala": "java"}


def _blank(data: bytes, family: str) -> bytes:
    """The source with comments blanked and strings blanked but for an underscore, so that brackets and patterns are code."""
    def blank(m: re.Match) -> bytes:
        rest = re.sub(rb"[^\n]", b" ", m.group())
        return rest if m.group()[:1] in (b"#", b"/") else b"_" + rest[1:]

    return _SKIP["hash" if family in ("python", "bash") else "c"].sub(blank, data)


def _close(code: bytes, at: int) -> int:
    """The place behind the bracket that closes the one at a place."""
    depth = 0
    for m in re.compile(rb"[()\[\]{}]").finditer(code, at):
        depth += 1 if m.group() in b"([{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def _end(code: bytes, at: int, family: str) -> int:
    """End of a declaration that begins at a place: its block, or its statement."""
    if family == "python":
        line = code.rfind(b"\n", 0, at) + 1
        indent = at - line
        k, depth = at, 0
        for m in re.compile(rb"[()\[\]{}]|\n").finditer(code, at):
            if m.group() == b"\n":
                if depth <= 0:
                    rest = re.compile(rb"(?:[ \t]*\r?\n)*([ \t]*)(\S)?").match(code, m.end())
                    if rest.group(2) is None or len(rest.group(1)) <= indent and rest.group(2) not in b")]}":
                        k = m.start()
                        break
            else:
                depth += 1 if m.group() in b"([{" else -1
        else:
            k = len(code)
        return len(code[:k].rstrip())
    if family == "bash" and b"{" not in code[at : (code.find(b"\n", at) + 1 or len(code))]:
        e = code.find(b"\n", at)
        return len(code) if e < 0 else e
    k, n = at, len(code)
    pattern = re.compile(rb"[({\[;\n]")
    while m := pattern.search(code, k):
        c = m.group()
        if c == b";":
            return m.end()
        if c == b"\n":
            follows = re.compile(rb"\s*(\S)").match(code, m.end())
            if code[:m.start()].rstrip()[-1:] not in b"=,+-*/&|?:.(" and not (follows and follows.group(1) in b".?:&|+{=") and family in ("script", "go", "bash"):
                return m.start()
            k = m.end()
            continue
        k = _close(code, m.start())
        if c == b"{":
            tail = re.compile(rb"[ \t]*;").match(code, k) if family == "script" else None
            arrow = code[at : m.start()].rstrip()[-2:] in (b"=>",) or re.search(rb"=\s*$", code[at : m.start()])
            return tail.end() if tail and arrow else k
    return n


def _comment_before(data: bytes, at: int) -> str | None:
    """The first line that says something of the comment right before a place."""
    head = data[:at].rstrip()
    if head.endswith(b"*/"):
        text = head[head.rfind(b"/*") :].decode("utf-8", "replace")
        lines = [re.sub(r"^\s*\*\s?", "", x).strip() for x in re.sub(r"\*/$", "", re.sub(r"^/\*+\s?", "", text)).split("\n")]
    else:
        lines = []
        for x in reversed(head.split(b"\n")[-50:]):
            s = x.strip()
            if not s.startswith((b"//", b"#")) or s.startswith(b"#!"):
                break
            lines.insert(0, re.sub(r"^(?://+|#+)\s?", "", s.decode("utf-8", "replace")).strip())
    said = [x for x in lines if x]
    return re.sub(r"\s+", " ", said[0]) if said else None


def extract_symbols(path: str, language: str, text: str, strategy: str = "doc-comments-first") -> list[dict]:
    """Symbols of one file: top-level declarations, members of classes as Class.member, and the top-level keys of JSON."""
    family = _FAMILY.get(language)
    if family is None:
        return []
    data = text.encode("utf-8", "surrogatepass")
    out: list[dict] = []

    def add(kind: str, name: str, qualified: str, start: int, end: int, exported: bool, declared: int | None = None) -> None:
        """declared: where the declaration begins behind export, if it does."""
        signature = re.sub(r"\s+", " ", data[start:end].decode("utf-8", "replace")).strip()
        doc = _comment_before(data, start) if strategy == "doc-comments-first" else None
        key = f"{path}:{kind}:{qualified}:{start if declared is None else declared}"
        out.append({
            "id": hashlib.sha256(key.encode("utf-8", "surrogatepass")).hexdigest()[:16], "file_path": path, "name": name, "qualified_name": qualified, "kind": kind, "signature": signature, "summary": doc or signature,
            "summary_source": "doc-comment" if doc else "signature", "start_line": data.count(b"\n", 0, start) + 1, "end_line": data.count(b"\n", 0, max(start, end - 1)) + 1, "start_byte": start, "end_byte": end, "exported": exported,
        })

    if family == "json":
        try:
            keys = list(json.loads(text)) if text.lstrip()[:1] == "{" else []
        except ValueError:
            return []
        at = 0
        for k in keys:
            place = data.find(json.dumps(k, ensure_ascii=False).encode(), at)
            if place < 0:
                continue
            blanked = re.sub(rb'"(?:\\.|[^"\\\n])*"', lambda m: b" " * len(m.group()), data[place:])
            depth, end = 0, len(blanked)
            for m in re.finditer(rb"[{}\[\],]", blanked):
                if m.group() in b"{[":
                    depth += 1
                elif m.group() in b"}]":
                    depth -= 1
                    if depth < 0:
                        end = m.start()
                        break
                elif depth == 0:
                    end = m.start()
                    break
            stop = place + len(data[place : place + end].rstrip())
            add("constant", k, k, place, stop, False)
            at = stop
        return out
    code = _blank(data, family)
    at, n = 0, len(code)
    first = re.compile(rb"(?m)^[ \t]*(?=\S)" if family in ("java",) else rb"(?m)^(?=\S)")
    while m := first.search(code, at):
        start = m.end()
        for kind, pattern in _TOP[family]:
            if d := pattern.match(code, start):
                name = d.group(1).decode("utf-8", "replace").strip()
                end = min(n, _end(code, start, family))
                exported = family == "script" and d.group().startswith(b"export")
                declared = start + re.match(rb"export\s+(?:default\s+)?", d.group()).end() if exported else start
                qualified = name
                if family == "go" and kind == "method" and (r := re.match(rb"func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)", d.group())):
                    qualified = f"{r.group(1).decode()}.{name}"
                add(kind, name, qualified, start, end, exported, declared)
                if kind == "class" and (member := _MEMBER.get(family)):
                    _members(code, start, end, family, member, name, add)
                at = max(end, start + 1)
                break
        else:
            e = code.find(b"\n", start)
            at = n if e < 0 else e + 1
            if family == "script" and code[start : start + 1] in b"{(":
                at = max(at, _close(code, start))
    return out


def _members(code: bytes, start: int, end: int, family: str, member: re.Pattern, owner: str, add) -> None:
    """Methods of a class body."""
    if family == "python":
        body = code.find(b":", start) + 1
        line = re.compile(rb"(?m)^([ \t]+)(?=\S)").search(code, body, end)
        if not line:
            return
        indent = line.group(1)
        for m in re.compile(rb"(?m)^" + re.escape(indent) + rb"(?=\S)").finditer(code, body, end):
            if d := member.match(code, m.end(), end):
                add("method", d.group(1).decode("utf-8", "replace"), f"{owner}.{d.group(1).decode('utf-8', 'replace')}", m.end(), _end(code, m.end(), family), False)
        return
    at = code.find(b"{", start, end) + 1
    word = re.compile(rb"\S")
    while 0 < at < end and (m := word.search(code, at, end)):
        at = m.start()
        d = member.match(code, at, end)
        stop = min(end, _end(code, at, "java"))
        if d and d.group(1) not in _NOT_MEMBERS:
            name = d.group(1).decode("utf-8", "replace")
            add("method", name, f"{owner}.{name}", at, stop, False)
        at = max(stop, at + 1)


def parse_symbols(files: DataFrame, contents: DataFrame, strategy: str = "doc-comments-first") -> DataFrame:
    """The symbols of all files, read from their contents; null contents and unknown languages have none."""
    languages = files.where("file_id is not null").select("file_id", "path", "language").distinct()
    rows = contents.where("content is not null").select("file_id", "content").join(languages, "file_id")
    names = [c.split()[0] for c in SYMBOLS.split(", ")]
    ints = {"start_line", "end_line", "start_byte", "end_byte"}
    types = {n: pa.int64() if n == "file_id" else pa.int32() if n in ints else pa.bool_() if n == "exported" else pa.string() for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s | {"file_id": r["file_id"]} for r in batch.to_pylist() for s in extract_symbols(r["path"] or "", r["language"] or "", r["content"], strategy)]
            yield pa.RecordBatch.from_arrays([pa.array([s[n] for s in found], types[n]) for n in names], names)

    return rows.mapInArrow(run, SYMBOLS).distinct()


def fingerprints(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """file_id, symbol_signature_hash and import_hash: digests of a file's ids and signatures, and of its imports."""
    s = symbols.groupBy("file_id").agg(F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("start_byte", "id", "signature")))), 256)).alias("symbol_signature_hash"))
    i = imports.select("file_id", "source", F.array_sort(F.transform("specifiers", lambda x: F.to_json(x))).alias("s")).groupBy("file_id").agg(F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("source", "s")))), 256)).alias("import_hash"))
    return s.join(i, "file_id", "full_outer")
