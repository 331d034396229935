"""Oversized contents and symbols cut into pieces at natural boundaries, by packing a structure tree.

The lines of an item form a tree: headings over what follows them, elements of markup over their content,
declarations, list items and brackets over what is indented below. Bottom-up, sibling subtrees are merged to the limit;
only subtrees that exceed it are opened, down to single lines, which are cut between statements, words or characters if
they must be. No piece holds the end of one opened subtree and the beginning of the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(rb"(#{1,6})[ \t]+\S")
_UNDERLINE = re.compile(rb"(=|-|~|\^)\1{2,}[ \t]*\r?\n?\Z")
_ELEMENT = re.compile(rb"<(/?)([A-Za-z][\w:.-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?(/?)>")
#: Elements of HTML that have no end.
_EMPTY = frozenset(b"area base br col embed hr img input link meta source track wbr".split())
#: Endings of paths: texts divided by headings, and files divided by elements. Other endings that aren't those of
#: texts are code, where # begins a comment.
MARKUP = ("html", "htm", "xhtml", "xml", "svg", "vue", "svelte")
_CLOSING = re.compile(rb"[\s)\]}]*(?:[)\]};,]|</|end\b|fi\b|done\b|esac\b|else\b|elif\b|except\b|finally\b|catch\b)")
_LEADING = re.compile(rb"\s*(?://|/\*|\*|\#(?!!)|@|<!--|--)")
_MARKS = (b";\n", b"}", b";", b"\n", b">", b",", b" ", b")")


class _Node:
    """Lines [first, last) with the lines nested below the first ones as children."""

    __slots__ = ("first", "depth", "children")

    def __init__(self, first: int, depth: int):
        self.first, self.depth, self.children = first, depth, []


def _line_starts(data: bytes) -> list[int]:
    out, at = [0], data.find(b"\n") + 1
    while 0 < at < len(data):
        out.append(at)
        at = data.find(b"\n", at) + 1
    return out


def _element_depths(data: bytes, starts: list[int]) -> list[int | None]:
    """As _depths, by the elements that are open where a line begins; a line that only closes goes with the one before."""
    out: list[int | None] = []
    level, k = 0, 0
    ends = starts[1:] + [len(data)]
    found = _ELEMENT.finditer(data)
    m = next(found, None)
    for k, end in enumerate(ends):
        line = data[starts[k] : end].strip()
        out.append(None if not line or line.startswith(b"</") else min(level, 60))
        while m and m.start() < end:
            if m.group(1):
                level = max(0, level - 1)
            elif not m.group(3) and m.group(2).lower() not in _EMPTY:
                level += 1
            m = next(found, None)
    return out


def _depths(data: bytes, starts: list[int], headings: bool) -> list[int | None]:
    """Depth of the node a line begins; None for lines that go with the line before."""
    out: list[int | None] = []
    base, lead, fresh = 0, -1, True
    for k, s in enumerate(starts):
        e = starts[k + 1] if k + 1 < len(starts) else len(data)
        line = data[s:e]
        body = line.lstrip(b" \t")
        if not body.strip():
            out.append(None)
            lead, fresh = -1, True
            continue
        if headings and (m := _HEADING.match(line)):
            base = len(m.group(1))
            out.append(base - 1)
            lead = -1
            continue
        if headings and k and out[k - 1] is not None and (m := _UNDERLINE.match(line)) and len(line.strip()) >= 3:  # of the line before
            base = 1 + b"=-~^".index(m.group(1))
            out[k - 1] = base - 1
            out.append(None)
            lead = -1
            continue
        depth = base + min(60, sum(4 if c == 9 else 1 for c in line[: len(line) - len(body)]))
        if _CLOSING.match(line):
            out.append(None)
        elif not headings and _LEADING.match(line):  # comments and annotations go with what follows
            out.append(depth if lead != depth or fresh else None)
            lead = depth
        else:
            out.append(None if lead == depth else depth)
            lead = -1
        fresh = False
    return out


def structure(data: bytes, starts: list[int], headings: bool, markup: bool = False) -> _Node:
    root = _Node(0, -1)
    stack = [root]
    for k, depth in enumerate(_element_depths(data, starts) if markup else _depths(data, starts, headings)):
        if depth is None:
            continue
        while stack[-1].depth >= depth:
            stack.pop()
        node = _Node(k, depth)
        stack[-1].children.append(node)
        stack.append(node)
    return root


def _within(data: bytes, start: int, end: int, limit: int) -> list[int]:
    """Cuts of one long run of bytes: behind the best mark in the last third of a piece, else between characters."""
    cuts = []
    while end - start > limit:
        low, high = start + 2 * limit // 3, start + limit
        cut = next((p + len(m) for m in _MARKS if (p := data.rfind(m, low, high)) >= 0), high)
        while cut > start + 1 and cut < len(data) and 0x80 <= data[cut] < 0xC0:
            cut -= 1
        cuts.append(cut)
        start = cut
    return cuts


def own_ranges(data: bytes, limit: int, headings: bool = False, markup: bool = False) -> list[tuple[int, int]]:
    """Consecutive ranges of at most `limit` bytes that cover the data, cut at the boundaries of the structure tree."""
    if not data:
        return []
    starts = _line_starts(data)
    begin = lambda k: starts[k] if k < len(starts) else len(data)

    def lines(first: int, last: int) -> list[tuple[int, int]]:
        """Lines that nothing divides, as many as fit together."""
        out, at = [], begin(first)
        for k in range(first, last):
            end = begin(k + 1)
            if end - at > limit:
                if at < begin(k):
                    out.append((at, begin(k)))
                at = begin(k)
                for c in _within(data, at, end, limit):
                    out.append((at, c))
                    at = c
        return [*out, (at, begin(last))] if at < begin(last) else out

    def packed(node: _Node, first: int, last: int) -> list[tuple[int, int]]:
        """The pieces of a subtree, which is one if it fits: its head and its children, merged with their siblings."""
        if begin(last) - begin(first) <= limit:
            return [(begin(first), begin(last))]
        if not node.children:
            return lines(first, last)
        out: list[tuple[int, int]] = []
        whole = False  # whether the last piece holds whole siblings only, and so may take in the next one
        if first < node.children[0].first:
            out, whole = lines(first, node.children[0].first), True
        ends = [c.first for c in node.children[1:]] + [last]
        for n, (child, end) in enumerate(zip(node.children, ends)):
            parts = packed(child, child.first, end)
            if out and whole and (len(parts) == 1 or n == 0) and parts[0][1] - out[-1][0] <= limit:  # a head goes with what it heads
                out[-1] = (out[-1][0], parts[0][1])
                out += parts[1:]
            else:
                out += parts
            whole = len(parts) == 1
        return out

    return packed(structure(data, starts, headings, markup), 0, len(starts))


def cut_pieces(data: bytes, limit: int, overlap: int, headings: bool = False, markup: bool = False) -> list[tuple[int, int, int]]:
    """(start, own_start, end) of the pieces: at most `limit` bytes each, of which start to own_start, at most `overlap`
    bytes, are the end of the piece before, from the start of a line where there is one."""
    own = own_ranges(data, limit - overlap, headings, markup)
    out = []
    for k, (a, b) in enumerate(own):
        start = a
        if k and overlap:
            low = max(a - overlap, own[k - 1][0])
            line = data.find(b"\n", max(0, low - 1), a - 1) + 1
            start = line if line > 0 and low <= line < a else low
            while start < a and 0x80 <= data[start] < 0xC0:
                start += 1
        out.append((start, a, b))
    return out


def blind_pieces(size: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """The pieces of `size` bytes that nobody can read."""
    step = limit - overlap
    return [(max(0, a - (overlap if a else 0)), a, min(size, a + step)) for a in range(0, size, step)]


def split_oversized(contents: DataFrame, symbols: DataFrame, *, limit: int = 24_000, overlap: int = 8_000, texts: tuple[str, ...] = ("md", "markdown", "mdx", "rst", "txt", "adoc", "text"), markup: tuple[str, ...] = MARKUP) -> DataFrame:
    """item_kind (file or symbol), item_key, piece_no, start_byte, own_start_byte, end_byte and text of all pieces of
    contents and symbols of more than `limit` bytes; places are bytes of the file's content.

    Every byte of an item is in a piece, no piece exceeds `limit`, consecutive pieces share up to `overlap` bytes. Files
    whose extension is in `texts`, or that have none, are divided by headings, those in `markup` by elements. Null contents and ids yield no file; empty ones are never
    too large. A symbol that reaches beyond its file, or whose file can't be read, is cut by size, with null text for
    what isn't there. Of several contents of a file the greatest counts; repeated rows count once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    big = F.octet_length("content") > limit
    spans = (
        symbols.where(F.col("id").isNotNull() & (F.col("end_byte") - F.col("start_byte") > limit))
        .groupBy("file_id")
        .agg(F.collect_set(F.struct("id", "start_byte", "end_byte")).alias("spans"))
    )
    large = contents.where(big & F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max(F.struct("content", "path")).alias("c")).select("file_id", F.col("c.path").alias("path"), F.col("c.content").alias("content"))
    rows = large.join(spans, "file_id", "full_outer").select("file_id", "path", "content", "spans")
    schema = "item_kind string, item_key string, piece_no int, start_byte int, own_start_byte int, end_byte int, text string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (dict(zip(batch.schema.names, (c[n].as_py() for c in batch.columns))) for n in range(batch.num_rows)):
                data = (r["content"] or "").encode("utf-8", "surrogatepass")
                ending = (r["path"] or ".").rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in (r["path"] or ".").rsplit("/", 1)[-1] else ""
                headings, elements = r["path"] is not None and ending in ("", *texts), ending in markup
                items = [("file", str(r["file_id"]), 0, len(data))] if len(data) > limit else []
                items += [("symbol", s["id"], s["start_byte"], s["end_byte"]) for s in r["spans"] or ()]
                rows = []
                for kind, key, start, end in items:
                    part = data[max(0, start) : end]
                    pieces = cut_pieces(part, limit, overlap, headings, elements) if len(part) == end - start else blind_pieces(end - start, limit, overlap)
                    for n, (a, own, b) in enumerate(pieces):
                        text = part[a:b].decode("utf-8", "ignore") if len(part) == end - start else None
                        rows.append((kind, key, n, start + a, start + own, start + b, text))
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["item_kind", "item_key", "piece_no", "start_byte", "own_start_byte", "end_byte", "text"])

    return rows.mapInArrow(scan, schema)
