"""Functions paired with their documentation: comment spans and function spans are found apart and joined by place.

One scan of every file yields its comments with the place of the code that follows, and Python's docstrings with the
place of the header they stand under. An as-of join gives every function the nearest comment before it; the pair is
kept if nothing but white space lies between, and the text is judged against the name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_C_LIKE = re.compile(rb"""(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`""")
_PYTHON = re.compile(rb"""(?P<d>[rRuUbBfF]{0,2}(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}))|(?P<c>\#[^\n]*)|(?P<s>[rRuUbBfF]{0,2}(?:"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*'))""")
_SHELL = re.compile(rb"""(?P<c>(?:(?<=[\s;])|(?<![\s\S]))\#[^\n]*)|\$?'[^']*'|"(?:\\[\s\S]|[^"\\])*"|\\[\s\S]""")
_CSS = re.compile(rb"""(?P<c>/\*[\s\S]*?(?:\*/|\Z))|"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*'""")
_CODE = re.compile(rb"\S")
_DEF = re.compile(rb"^[ \t]*((?:async[ \t]+)?def[ \t]+\w+|class[ \t]+\w+)", re.M)
_BRACED = re.compile(rb"^\s*(?:(?:export|public|private|protected|static|async|default|final|abstract)\s+)*(?:function\b|func\b|class\b[^:]*\{|interface\b|[\w<>\[\], ]+\([^)]*\)[^:\n]*\{)", re.M)
_SHELL_FUNCTION = re.compile(rb"^(?:function\s+)?[\w-]+\s*\(\)\s*\{", re.M)


def _windows(content: bytes) -> Iterator[bytes]:
    """The whole content in parts of 20,000 bytes, each from the start of a line if there is one."""
    at = 0
    while at < len(content):
        yield content[at : at + 20_000]
        line = content.rfind(b"\n", at, at + 20_000) + 1
        at = line if line > at else at + 20_000


def syntax(content: bytes, path: str) -> re.Pattern:
    """The comment syntax of a file: what its first declarations look like, wherever they are, counts before its extension."""
    end = path.rsplit(".", 1)[-1].lower()
    head = next((w for w in _windows(content) if _DEF.search(w) or _BRACED.search(w) or _SHELL_FUNCTION.search(w)), content[:20_000])
    if content.startswith(b"#!") and b"python" not in content[:80] or _SHELL_FUNCTION.search(head) and not re.search(rb"^\s*(?:export\s+)?(?:function|class|const|let|import)\b.*[{;]", head, re.M):
        return _SHELL
    if _DEF.search(head) and re.search(rb"^[ \t]*(?:async[ \t]+)?(?:def|class)\b[^\n]*:[ \t]*(?:#[^\n]*)?\r?$", head, re.M) and not re.search(rb"\{[ \t]*\r?$", head, re.M):
        return _PYTHON
    if end in ("py", "pyi") and not _BRACED.search(head):
        return _PYTHON
    if end in ("sh", "bash") and not _BRACED.search(head):
        return _SHELL
    return _CSS if end == "css" else _C_LIKE


def comment_spans(content: bytes, path: str) -> list[tuple[str, int, int, int, str]]:
    """(kind, start, end, anchor, text) in bytes. A comment's anchor is the code that follows it, a docstring's the header
    it stands under. Comments on lines of their own with no blank line between them are one."""
    pattern = syntax(content, path)
    out: list[list] = []
    strings: list[tuple[int, int, bool]] = []
    for m in pattern.finditer(content):
        if m.lastgroup != "c":
            if pattern is _PYTHON:
                strings.append((m.start(), m.end(), m.lastgroup == "d"))
            continue
        start, end = m.span()
        line = content.rfind(b"\n", 0, start) + 1
        if content[line:start].strip() or content.startswith(b"#!", start) and start == 0:
            continue  # behind code
        if out and not content[out[-1][2] : start].strip() and content.count(b"\n", out[-1][2], start) <= 1:
            out[-1][2] = end
        else:
            out.append(["comment", start, end])
    spans = []
    for kind, start, end in out:
        code = _CODE.search(content, end)
        spans.append((kind, start, end, code.start() if code else -1, content[start:end].decode("utf-8", "replace")))
    if strings:
        starts = {s: e for s, e, _ in strings}
        inside = sorted(strings)
        at = 0
        for d in _DEF.finditer(content):
            while at < len(inside) and inside[at][1] <= d.start(1):
                at += 1
            if at < len(inside) and inside[at][0] <= d.start(1) < inside[at][1]:
                continue  # in a string
            colon = _header_end(content, d.end(1), starts)
            if colon < 0:
                continue
            first = re.compile(rb"(?:[ \t]|\r?\n|#[^\n]*)*").match(content, colon).end()
            if first in starts and content[first : first + 1].lower() not in (b"b", b"f"):
                spans.append(("docstring", first, starts[first], d.start(1), content[first : starts[first]].decode("utf-8", "replace")))
    return spans


def _header_end(content: bytes, at: int, strings: dict[int, int]) -> int:
    """The place behind the colon that ends a def or class header, or -1."""
    depth, n = 0, len(content)
    while at < n:
        if at in strings:
            at = strings[at]
            continue
        c = content[at : at + 1]
        if c in b"([{":
            depth += 1
        elif c in b")]}":
            depth -= 1
        elif c == b":" and depth == 0:
            return at + 1
        elif c == b"\n" and (depth == 0 or _DEF.match(content, at + 1)):
            return -1  # a header that isn't closed ends where the next one begins
        elif c == b"#":
            at = content.find(b"\n", at)
            if at < 0:
                return -1
            continue
        at += 1
    return -1


# Tags whose text isn't documentation of its own, and words that add nothing to a name.
_DROP_TAGS = frozenset("param params arg args argument return returns throws throw raises exception type typedef template see link author since version todo example license copyright module file package category group default readonly override yields yield property prop".split())
_FILLER = frozenset("a an the this that of for to in on with and or is are be it its function method class helper func def routine procedure does do value values object name called named implementation implements impl simple simply just main default new see above below note".split())
_TAG_SPLIT = re.compile(r"(?:(?<=\s)|^)[@:\\](\w+):?")
_MARK = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|wip|tbc|n/?a|none|placeholder|undocumented|no description|missing|document(?:ation)? (?:me|this|here|missing|pending)|add (?:docs?|documentation|description)|description here)\b", re.I)
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint|tslint|jshint|jslint|prettier-ignore|istanbul|c8 |v8 |ts-(?:ignore|nocheck|expect-error|check)|@ts-|noqa|type:\s*ignore|pylint|flake8|mypy|pragma|pyright|isort|fmt:|yapf|nosec|nolint|go:\w+|\+build|lint:|shellcheck|noinspection|checkstyle|spotless|sonar|nosonar|region|endregion|coverage|webpack|vite|biome|deno-lint|cspell|codespell|suppress|formatter:|clang-format|spdx-|copyright|\(c\) |part of \S+\.$|belongs to \S+\.$|-\*-)",
    re.I,
)
_CODE_LINE = re.compile(
    r"""^\s*(?:
        (?:return|if|for|while|switch|else|elif|try|import|from|const|let|var|await|throw|raise|yield|del|assert|print|echo|export|local|def|func|function|class|public|private|int|string|defer|go|fi|done|end)\b.*(?:[;{}:]|\)|=.*)\s*$
      | [\w.$\[\]'"]+\s*(?:=|:=|\+=|-=|\|\|=)\s*\S.*$ | [\w.$]+\([^)]*\)\s*[;,{]?\s*$ | .*[;{}]\s*$ | [\])}]+[;,]?\s*$ | .*=>\s*\{?\s*$
    )""",
    re.X,
)
_WORDS = re.compile(r"[^\W\d_]+")
#: Scripts that set no blanks between words; two letters count as a word.
_UNSPACED = re.compile(r"([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{1,2})")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-zà-ÿ]+|[A-Z]+")


def plain_comment(text: str) -> str:
    """The text of a comment or docstring, without its markers, line by line."""
    t = text.strip()
    if m := re.match(r"(?i)[rub]{0,2}(\"{3}|'{3}|\"|')([\s\S]*?)\1\Z", t):
        return "\n".join(x.strip() for x in m.group(2).splitlines()).strip()
    lines = []
    for x in t.splitlines():
        x = x.strip()
        x = re.sub(r"^(?:/\*+!?|//+[/!]?|#+!?|\*+(?!/)|<!--)[ \t]?", "", x)
        lines.append(re.sub(r"\s*\*+/$|-->$", "", x).strip())
    return "\n".join(lines).strip()


def _words(text: str) -> list[str]:
    """The words of a text in lower case."""
    if text.isascii():
        return [w.lower() for w in _WORDS.findall(text)]
    return [w.lower() for w in _WORDS.findall(_UNSPACED.sub(r" \1 ", text))]


def documentation(text: str, name: str) -> str | None:
    """The documentation in a comment, or None if it says no more than the name."""
    kept = []
    plain = plain_comment(text)
    for line in plain.split("\n"):
        s = line.strip()
        if not s or _MARK.match(s) or _DIRECTIVE.match(s) or re.fullmatch(r"[\W_]*", s) or re.search(r"\{@\w+\}?", s) and len(_words(s)) <= 3:
            continue
        kept.append(s)
    code = sum(bool(_CODE_LINE.match(x)) for x in kept)
    if kept and code >= max(1, 0.6 * len(kept)):
        return None
    # tags take their text with them, up to the next tag; such as @internal or @deprecated only mark what follows
    said, dropping = [], False
    for s in kept:
        parts = _TAG_SPLIT.split(s)
        if parts[0].strip():
            if not dropping or not s.startswith((" ", "\t")) and len(parts) == 1 and not dropping:
                said.append(parts[0])
        for tag, rest in zip(parts[1::2], parts[2::2]):
            dropping = tag.lower() in _DROP_TAGS
            if not dropping and rest.strip():
                said.append(rest)
    own = {w.lower() for w in _CAMEL.findall(name)}
    joined = re.sub(r"[\W_]+", "", name).lower()
    words = [w for x in said for w in _words(re.sub(rf"\b{re.escape(name)}\b", " ", x))]
    new = [w for w in words if w not in _FILLER and w != joined and len(w) > 1 and not any(w == o or len(o) > 2 and (w.startswith(o) and len(w) - len(o) <= 3 or o.startswith(w) and len(w) > 3) for o in own)]
    return plain if len(set(new)) >= 2 and len(words) >= 3 else None


def documented_functions(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """symbol_id, file_id, name, code (the signature), documentation, doc_kind (comment or docstring) of every function
    and method with real documentation.

    Input: symbols (id, file_id, name, kind, signature, start_byte) and contents (file_id, path, content); further
    columns are ignored. Rows with a null id, file or start, and files with null content, have no pair; repeated rows
    yield one pair. Files are grouped by file_id: what is gathered in one place is one file's comments and symbols.
    """
    schema = "file_id long, doc_kind string, pos int, anchor int, text string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, (path, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                for kind, start, end, anchor, text in comment_spans(t.as_py().encode("utf-8", "surrogatepass"), path or ""):
                    if anchor >= 0:
                        rows.append((n, kind, end if kind == "comment" else anchor, anchor, text))
            if rows:
                at, kind, pos, anchor, text = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(kind), pa.array(pos, pa.int32()), pa.array(anchor, pa.int32()), pa.array(text)], ["file_id", "doc_kind", "pos", "anchor", "text"])

    comments = contents.where("file_id is not null and content is not null").select("file_id", "path", "content").mapInArrow(scan, schema)
    found = F.struct("anchor", "text")
    marks = comments.select("file_id", "pos", F.lit(0).alias("order"), F.when(F.col("doc_kind") == "comment", found).alias("comment"), F.when(F.col("doc_kind") == "docstring", found).alias("docstring"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"))
    functions = symbols.where("kind in ('function', 'method') and id is not null and file_id is not null and start_byte is not null")
    spans = functions.select("file_id", F.col("start_byte").alias("pos"), F.lit(1).alias("order"), F.lit(None).cast("struct<anchor:int,text:string>").alias("comment"), F.lit(None).cast("struct<anchor:int,text:string>").alias("docstring"), "id", F.coalesce("name", F.lit("")).alias("name"))
    near = Window.partitionBy("file_id").orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        marks.unionByName(spans)
        .select("file_id", "pos", "id", "name", F.last("comment", True).over(near).alias("comment"), F.last("docstring", True).over(near).alias("docstring"))
        .where("id is not null")
        .select("id", "file_id", "name", F.when(F.col("comment.anchor") == F.col("pos"), F.col("comment.text")).alias("before"), F.when(F.col("docstring.anchor") == F.col("pos"), F.col("docstring.text")).alias("inside"))
        .where("before is not null or inside is not null")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, kinds, keep = [], [], []
            for n, (name, before, inside) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))):
                inside_doc = documentation(inside, name) if inside else None
                doc = inside_doc or (documentation(before, name) if before else None)
                if doc:
                    keep.append(n)
                    docs.append(doc)
                    kinds.append("docstring" if inside_doc else "comment")
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(docs, pa.string()), pa.array(kinds, pa.string())], ["symbol_id", "file_id", "name", "documentation", "doc_kind"])

    return joined.mapInArrow(judge, "symbol_id string, file_id long, name string, documentation string, doc_kind string").distinct()


def with_code(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The pairs with the code of their symbols, its signature with white space folded."""
    code = symbols.where("id is not null").select(F.col("id").alias("symbol_id"), F.col("signature").alias("code")).groupBy("symbol_id").agg(F.max("code").alias("code"))
    return pairs.join(code, "symbol_id", "left")
