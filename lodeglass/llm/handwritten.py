"""Generated, minified, vendored and data files among source files, by thresholds on layout statistics per language.

One pass over every file, where it lies, measures its lines and characters and reads the tool's or project's note at
its head, if there is one. The thresholds of its language then tell generated, minified and data files by their layout;
what has the layout of hand-written code but isn't, above all vendored files, is known by notes, names and folders, and
copies of vendored files that bear no note by the digest of their body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.session import BROADCAST_ROWS, cut, join_small


@dataclass(frozen=True)
class Limits:
    """Thresholds of one language. Shares are of all characters."""

    dense_share: float = 0.7  # minified: this much of the file lies in dense lines, of DENSE bytes or more
    dense_space: float = 0.1  # minified: at most this much white space
    marks: float = 0.05  # minified: share of ; { } ( ) = : in dense lines, which a long list of names lacks
    digits: float = 0.22  # data: share of digits
    numbers: float = 0.45  # data: number literals among all words and numbers
    encoded: float = 0.6  # data: share of long encoded runs
    row_share: float = 0.85  # data: lines that only list literals
    rows: int = 20  # data: at least so many lines, or so many bytes / 40, or some of both
    shapes: float = 0.0  # generated: at most so many shapes of lines, by the root of the number of different lines
    brackets: float = 0.0  # generated: at least this share of lines that hold brackets or literals alone
    shape_space: float = 1.0  # generated: at most this much white space
    shape_lines: int = 16  # generated: at least so many different lines


#: Bytes from which a line is dense, and from which a body that equals another one counts as its copy.
DENSE, TWIN = 180, 200
#: JSON lists literals and repeats its shapes by nature; a style sheet is full of numbers, and its rules are of few shapes like those of a shell
#: script; Python has no lines of brackets.
LIMITS = {
    "ts": Limits(shapes=1.5, brackets=0.27),
    "js": Limits(shapes=1.6, brackets=0.28),
    "python": Limits(shapes=1.4, shape_space=0.19),
    "go": Limits(shapes=1.7, brackets=0.32),
    "java": Limits(shapes=1.3, brackets=0.28),
    "json": Limits(digits=0.2, row_share=2.0),
    "css": Limits(dense_space=0.06, digits=0.4, numbers=0.8, row_share=2.0),
    "bash": Limits(digits=0.3),
}
_DEFAULT = Limits()

# Folders that hold other projects' files, file names that tools give, and what tools and projects
# write at the head of their files.
VENDOR_FOLDERS = frozenset("vendor vendors node_modules third_party third-party thirdparty 3rdparty bower_components site-packages".split())
#: Folders of these names may hold a project's own code for something outside.
LIKELY_FOLDERS = frozenset("extern external externals deps".split())
_SURE_FOLDERS = frozenset("__generated__ generated-sources generated-src autogen".split())
_TOOL_NAME = re.compile(r"(?:\.(?:gen|g|generated|pb|pb\.gw|designer)\.[a-z]+|_(?:pb2|pb2_grpc|generated|gen)\.[a-z]+|_string\.go)$|^zz_generated\.|^(?:package-lock\.json|npm-shrinkwrap\.json|composer\.lock|pnpm-lock\.yaml|yarn\.lock)$")
_MINIFIED_NAME = re.compile(r"[.-](?:min|bundle|packed)\.(?:js|css|mjs)$")
_HEAD_NOTE = re.compile(
    r"""^\s*(?://+|\#+|/?\*+!?|<!--|--|;|%)\s*(?:
        code\ generated\ (?:by|from)\b | (?:auto-?|machine-?)generated\b | automatically\ (?:generated|created|produced)\b |
        @generated\b | <auto-?generated | generated\ (?:by|from|with|automatically|file|code)\b | (?:this|the\ following)\ (?:file|code|module|class)\ (?:is|was|has\ been)\ (?:auto-?|automatically\ )?(?:generated|produced|created|emitted)\b |
        (?:built|created|produced|emitted)\ (?:with|by)\ [^.\n]{1,60}\.\ .*?(?:overwritten|lost|edit|modify) | do\ not\ (?:edit|modify)\b.{0,40}(?:generated|overwritten)
    )""",
    re.I | re.M | re.X,
)
_VENDOR_NOTE = re.compile(
    r"""(?:
        taken\ (?:unchanged|verbatim|over)?\ ?from\b | \bupstream\ copy\b | \bvendored\ (?:from|copy)\b | ^\W*@license\b | \bcopied\ (?:unchanged|verbatim|as\ is)?\ ?from\b |
        \(c\)\ (?:\d{4}\ )?the\ \S+\ (?:authors|contributors|project|developers|team)\b | copyright\ \(c\)\ [\d,\ -]+(?:by\ )?the\ \S+\ (?:project|authors|contributors|developers|team)\b |
        \bredistribution\ and\ use\ in\ source\b | \bthis\ file\ is\ part\ of\ the\ \S+\ (?:project|library|package)\b
    )""",
    re.I | re.M | re.X,
)
_SPACE = b" \t\r\n\f\v"
_DIGITS = b"0123456789"
_ALNUM = _DIGITS + bytes(range(65, 91)) + bytes(range(97, 123))
_RUN = re.compile(rb"[A-Za-z0-9+/=]{48,}|(?:\\x[0-9a-fA-F]{2}){12,}")
_NUMBER = re.compile(rb"(?<![\w.])-?\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?(?!\w)")
_WORD = re.compile(rb"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*")
_LITERAL_LINE = re.compile(rb"""^[\s\[\](){},;:]*+(?:(?:"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|-?[\d.]++(?:[eE][+-]?\d++)?+|true|false|null|None|nil)[\s\[\](){},;:]*+)*+$""")
_COMMENT_LINE = re.compile(rb"^\s*(?://|#|/?\*|<!--)")
_OPENING = re.compile(rb"\A(?:\xef\xbb\xbf)?(?:#![^\n]*\n)?(?:\s|//[^\n]*\n|#(?!!)[^\n]*\n|/\*[\s\S]*?\*/)*")


_DECLARATION = re.compile(r"(?:export |public |async |static |final |abstract )*(?:def|function|class|func|interface|struct)\b|[\w-]+\s*\(\)\s*\{")
#: Code that may stand before a head's end: imports and the like, and constants of one line.
_PREAMBLE = re.compile(
    r"""(?:@?import|@charset|from|package|require|include|use|using|source|\.|set|shopt|export\s+\*|export\s*\{)(?![\w$]) | ['"]use\ \w+['"] |
        (?:(?:export|public|private|protected|static|final|declare|readonly|const|let|var|local)\s+)*[\w$.<>\[\]{},\ ]++(?::[\w$.<>\[\]|\ ]++)?:?=(?![=>]).*(?<![{(\[,=\\])$""",
    re.X,
)


def _lines(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        yield at, text[at:end]
        at = end + 1


def _comments_at_head(text: str) -> str:
    """The comments before the first code other than imports and single constants. In the first lines only a declaration
    is such code; further on any line is that's neither comment nor preamble, as the comments behind it aren't the head."""
    out, block, open_import = [], False, ""
    for n, (at, line) in enumerate(_lines(text)):
        s = line.strip()
        if block or s.startswith(("//", "#", "/*", "*", "<!--", "--")):
            out.append(line)
            if s.startswith("/*") and "*/" not in s:
                block = True
            elif "*/" in s:
                block = False
        elif _DECLARATION.match(s):
            break
        elif open_import:
            open_import = "" if open_import in s else open_import
        elif (start := _PREAMBLE.match(s)) or not s:
            code = re.split(r"\s(?://|\#)", s)[0]
            if start and re.match(r"import|from|export|use", s):
                open_import = next((b for a, b in ("()", "{}") if a in code and b not in code), "")
        elif n >= 30 or at >= 4000:
            break
    return "\n".join(out)


def _rows(line: bytes) -> int:
    """Rows a line counts for among literal lines: a long one holds as many as fill it, so that the breaks of a list don't matter."""
    return 1 if len(line) < 500 else len(line) // 40


_SHAPED = re.compile(rb"""[A-Za-z_\x80-\xff][\w\x80-\xff]*|\d+|"[^"\n]*"|'[^'\n]*'""")
_SHAPE_OF = {**dict.fromkeys(b"0123456789", b"0"), **dict.fromkeys(b"\"'", b"s")}


def _shape(line: bytes) -> bytes:
    """A line with every word, number and string as one sign."""
    return _SHAPED.sub(lambda m: _SHAPE_OF.get(m.group()[0], b"x"), line)


def statistics(content: bytes) -> dict[str, float]:
    """max_line, mean_line (bytes), space, alnum, digits, numbers (literals among words and literals), encoded (share of
    long encoded runs), literal_lines (share, long lines by their rows), size, lines (neither blank nor comments), dense (share in dense lines), marks (share of
    ; { } ( ) = : in dense lines), distinct (different lines
    among them) and shapes (their shapes, by the root of their number)."""
    n = max(1, len(content))
    lines = content.split(b"\n")
    sizes = [len(x) for x in lines]
    full = [x for x in map(bytes.strip, lines) if x]
    code = [x for x in full if not _COMMENT_LINE.match(x)]
    distinct = set(code)
    numbers = len(_NUMBER.findall(content))
    thick = b"".join(x for x in lines if len(x) >= DENSE)
    return {
        "max_line": float(max(sizes)), "mean_line": n / max(1, sum(1 for x in sizes if x)), "space": 1 - len(content.translate(None, _SPACE)) / n,
        "alnum": 1 - len(content.translate(None, _ALNUM)) / n, "digits": 1 - len(content.translate(None, _DIGITS)) / n,
        "numbers": numbers / max(1, numbers + len(_WORD.findall(content))), "encoded": sum(map(len, _RUN.findall(content))) / n,
        "literal_lines": sum(_rows(x) for x in code if _LITERAL_LINE.match(x)) / max(1, sum(map(_rows, code))),
        "size": float(len(content)), "lines": float(len(code)), "dense": len(thick) / n, "marks": 1 - len(thick.translate(None, b";{}()=:")) / max(1, len(thick)),
        "distinct": float(len(distinct)), "shapes": len(set(map(_shape, distinct))) / max(1, len(distinct)) ** 0.5,
    }


def layout(stats: dict[str, float], language: str | None) -> str | None:
    """What a file is by its layout alone: generated, minified, data or None."""
    limits = LIMITS.get(language or "", _DEFAULT)
    s = stats
    if s["space"] <= limits.dense_space and s["marks"] >= limits.marks and s["encoded"] < limits.encoded and (s["dense"] >= limits.dense_share or s["mean_line"] >= DENSE):
        return "minified"
    if s["lines"] * 40 + s["size"] >= limits.rows * 40 and (s["digits"] >= limits.digits or s["numbers"] >= limits.numbers or s["encoded"] >= limits.encoded or s["literal_lines"] >= limits.row_share):
        return "data"
    if s["distinct"] >= limits.shape_lines and s["shapes"] <= limits.shapes and s["literal_lines"] >= limits.brackets and s["space"] <= limits.shape_space:
        return "generated"
    return None


def marks(path: str, content: str) -> tuple[str | None, str | None, int | None]:
    """What notes, folders and the name say a file is, the folder that only makes it likely to be vendored, and the digest of its body."""
    raw = content.encode("utf-8", "surrogatepass")
    folders, name = path.split("/")[:-1], path.rsplit("/", 1)[-1]
    head = _comments_at_head(content)
    body = raw.replace(b"\r", b"")
    body = body[_OPENING.match(body).end() :].strip()
    digest = xxhash.xxh3_64_intdigest(body) - (1 << 63) if len(body) >= TWIN else None
    kind = None
    if VENDOR_FOLDERS.intersection(folders) or _VENDOR_NOTE.search(head):
        kind = "vendored"
    elif _TOOL_NAME.search(name) or _SURE_FOLDERS.intersection(folders) or _HEAD_NOTE.search(head):
        kind = "generated"
    elif _MINIFIED_NAME.search(name):
        kind = "minified"
    return kind, next((f for f in folders if f in LIKELY_FOLDERS), None), digest


def origin(path: str, language: str | None, content: str) -> tuple[str | None, dict[str, float], int | None]:
    """What a file is without its corpus (generated, minified, vendored, data or None), its statistics, and the digest of its body."""
    stats = statistics(content.encode("utf-8", "surrogatepass"))
    marked, _, digest = marks(path, content)
    return marked or layout(stats, language), stats, digest


_FIELDS = ("max_line", "mean_line", "space", "alnum", "digits", "numbers", "encoded", "literal_lines", "size", "lines", "dense", "marks", "distinct", "shapes")


def file_origins(files: DataFrame, contents: DataFrame, *, likely_share: float = 0.5, likely_weight: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """file_id, path, language, origin (generated, minified, vendored, data or null for hand-written), layout (what the
    statistics alone say), marked (what note, name or folder say) and the statistics of every distinct row of `contents` with content.

    Input: files (file_id, path, language) and contents (file_id, path, content); further columns are ignored. A file
    without a row in `files` has a null language and the general limits; null contents and null ids yield no row, empty
    contents are hand-written. A copy of a vendored file, equal to it apart from comments at the head and line ends, is
    vendored; copies hot enough to hold a third of all rows are spread over salted tasks. Files in a folder of
    LIKELY_FOLDERS are vendored if of the files in folders of that name in their repository a share of likely_share bears a
    note or is such a copy; the share of all repositories counts like likely_weight files more. Contents are not shuffled.
    """
    rows = contents.select("file_id", "path", "content").where("file_id is not null and content is not null")
    schema = "file_id long, path string, marked string, likely string, body long, " + ", ".join(f"{c} double" for c in _FIELDS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, stats = [], []
            for p, c in zip(batch.column(1).to_pylist(), batch.column(2)):
                text = c.as_py()
                found.append(marks(p or "", text))
                stats.append(statistics(text.encode("utf-8", "surrogatepass")))
            kinds, likely, bodies = zip(*found) if found else ((), (), ())
            cols = [pa.array([s[f] for s in stats], pa.float64()) for f in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string()), pa.array(likely, pa.string()), pa.array(bodies, pa.int64()), *cols], ["file_id", "path", "marked", "likely", "body", *_FIELDS])

    @F.pandas_udf("string")
    def by_layout(language, stats):
        import pandas as pd

        return pd.Series([layout(s, g) for g, s in zip(language, stats.to_dict("records"))], dtype=object)

    known = files.select("file_id", "language").where("file_id is not null").groupBy("file_id").agg(F.max("language").alias("language"))
    measured = rows.mapInArrow(measure, schema).join(known, "file_id", "left")
    measured = cut(measured.withColumn("layout", by_layout("language", F.struct(*_FIELDS))))
    copied = F.lit(True).alias("copied")
    known_bodies = measured.where("marked = 'vendored' and body is not null").select("body").distinct()
    likely = join_small(measured.where("likely is not null").select("path", "likely", "marked", "body"), known_bodies.select("body", copied), ["body"], "left", max_rows=broadcast_rows)
    repository = F.substring_index("path", "/", 1).alias("repository")
    each = likely.groupBy(repository, "likely").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("copied"), F.col("marked") == "vendored", F.lit(False))).alias("k"))
    total = each.groupBy("likely").agg((F.sum("k") / F.sum("n")).alias("share"))  # four names at most
    share = (F.col("k") + likely_weight * F.col("share")) / (F.col("n") + likely_weight)
    trusted = cut(each.join(F.broadcast(total), "likely").where(share >= likely_share).select("repository", "likely", F.lit(True).alias("trusted")))
    joined = join_small(measured.select("*", repository), trusted, ["repository", "likely"], "left", max_rows=broadcast_rows)
    sure = F.coalesce(F.col("trusted"), F.col("marked") == "vendored", F.lit(False))
    bodies = cut(joined.where(sure & F.col("body").isNotNull()).select("body").distinct())
    joined = join_small(joined, bodies.select("body", copied), ["body"], "left", max_rows=broadcast_rows)
    origin = F.when(sure | F.col("copied"), "vendored").otherwise(F.coalesce("marked", "layout"))
    return joined.select("file_id", "path", "language", origin.alias("origin"), "layout", "marked", *_FIELDS).distinct()
