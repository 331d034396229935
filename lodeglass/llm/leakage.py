"""Evaluation texts leaking into training text: one Aho-Corasick automaton over normalised word runs of the items.

A passage of `passage` words with at most `replaced` of them exchanged holds a run of
(passage - replaced) / (replaced + 1) whole words. All such runs of all items go into an automaton; every document is
scanned once, as the stream of its letters and digits alone, so that what stands between words makes no difference.
From each hit item and document are followed word by word to both sides; places are those of the original text.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodeglass.session import cut

#: Letters of other scripts that look like Latin ones, and what they look like.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһԛԝкмтвнѵαεοικνρτυχօոսցɡıɩ",
    "aeopcyxijsdhqwkmtbhvaeoikvptuxonuggii",
)
#: What isn't read letter by letter: a tag, a coded line end or character, an entity.
_SPECIAL = re.compile(r"(</?[A-Za-z!][^<>]*>|\\[nrt])|(\\u[0-9a-fA-F]{4}|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")
_SENTENCE_END = re.compile(r"[.?!:]")


class _Fold(dict):
    """What a character counts as: letters and digits without case, marks and disguise; None for all others."""

    def __missing__(self, code: int) -> str | None:
        s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).casefold()).translate(LOOKALIKES)
        self[code] = "".join(c for c in s if c.isalnum()) or None
        return self[code]


_FOLD = _Fold()


def _decoded(special: re.Match) -> str:
    if special.group(1):
        return " "
    s = special.group(2)
    return chr(int(s[2:], 16)) if s[0] == "\\" else html.unescape(s)


def stream(text: str) -> str:
    """The letters and digits of a text, folded, with nothing between them; equal to the joined tokens of tokens_at."""
    if "<" in text or "\\" in text or "&" in text:
        text = _SPECIAL.sub(_decoded, text)
    return text.translate(_FOLD)


class _Shape(dict):
    """Every character as one: what it counts as, or one of the signs below."""

    def __missing__(self, code: int) -> str:
        f = _FOLD[code]
        self[code] = (" " if chr(code).isspace() else "-") if not f else f if len(f) == 1 else _LONG
        return self[code]


_SHAPE = _Shape()
#: A character that counts as several; a coded character and what its code is made of. No letters, so no shape of any.
_LONG, _CODED = "\x01", "\x02"
_GAPS = re.compile(r"([ \-]+)")


def tokens_at(text: str) -> tuple[list[str], list[int], list[int], list[bool]]:
    """The runs of letters and digits: folded text, starts, ends, and whether a blank, tag or line end stands before."""
    shape, parts, at = text.translate(_SHAPE), [" "], 0
    coded: dict[int, str] = {}
    for m in _SPECIAL.finditer(text):
        plain = _decoded(m)
        f = plain.translate(_FOLD)
        if f:
            coded[m.start()] = f
        parts += [shape[at : m.start()], (_CODED if f else " " if any(map(str.isspace, plain)) else "-") * (m.end() - m.start())]
        at = m.end()
    split = _GAPS.split("".join([*parts, shape[at:], " "]))  # nothing, gap, token, gap, ..., token, gap, nothing
    places = [x - 1 for x in accumulate(map(len, split))]
    tokens, starts, ends = split[2:-1:2], places[1:-2:2], places[2:-1:2]
    if coded or _LONG in shape:
        for n, token in enumerate(tokens):
            if _LONG in token or _CODED in token:
                tokens[n] = "".join(coded.get(starts[n] + i, "") if c == _CODED else _FOLD[ord(text[starts[n] + i])] if c == _LONG else c for i, c in enumerate(token))
    return tokens, starts, ends, [" " in gap for gap in split[1:-2:2]]


def words_at(text: str) -> list[tuple[str, int, int]]:
    """Normalised words, as blanks divide them, with their places in the text."""
    out: list[tuple[str, int, int]] = []
    for token, start, end, blank in zip(*tokens_at(text)):
        if blank or not out:
            out.append((token, start, end))
        else:
            out[-1] = (out[-1][0] + token, out[-1][1], end)
    return out


def folded(text: str) -> str:
    """The words of words_at between single spaces."""
    return f" {' '.join(w for w, _, _ in words_at(text))} "


def _words_and_heads(text: str) -> tuple[list[str], int, list[tuple[int, int]]]:
    """The words of an item, their digest, and for each sentence that isn't the last how many words it ends behind, with the digest of the words up to there."""
    at = words_at(text)
    words = [w for w, _, _ in at]
    digest = lambda n: xxhash.xxh3_64_intdigest(" ".join(words[:n])) - (1 << 63)
    heads = [(n, digest(n)) for n in range(3, len(at)) if _SENTENCE_END.search(text, at[n - 1][2], at[n][1])]
    return words, digest(len(words)), heads


def without_openings(items: list[tuple]) -> list[tuple]:
    """(id, words, first) of (id, text): first is the number of leading words that belong to an opening shared with another item.

    Whole leading sentences, of three words or more and followed by another one, with which a different text also
    begins are an opening; equal items stay whole. leaked_passages does the same by groups.
    """
    read = [_words_and_heads(t) for _, t in items]
    texts: dict[int, set[int]] = {}
    for _, whole, heads in read:
        for _, head in heads:
            texts.setdefault(head, set()).add(whole)
    return [(i, words, max((n for n, head in heads if len(texts[head]) > 1), default=0)) for (i, _), (words, _, heads) in zip(items, read)]


def run_length(passage: int, replaced: int) -> int:
    """Whole words in a row that any passage holds, however its exchanged words lie."""
    return max(1, -(-(passage - replaced) // (replaced + 1)))


@lru_cache(maxsize=2)
def _automaton(items: tuple, run: int) -> ahocorasick.Automaton:
    found: dict[str, list[tuple[int, int]]] = {}
    for k, (_, words, first) in enumerate(items):
        for j in range(first, len(words) - run + 1):
            found.setdefault("".join(words[j : j + run]), []).append((k, j))
    a = ahocorasick.Automaton()
    for phrase, places in found.items():
        a.add_word(phrase, (len(phrase), places))
    if found:
        a.make_automaton()
    return a


def _taken(word: str, tokens: list, t: int, step: int) -> int:
    """How many tokens from t on make up the word; 0 if none do."""
    n, at = 0, 0 if step > 0 else len(word)
    while 0 <= t < len(tokens):
        token = tokens[t]
        if not (word.startswith(token, at) if step > 0 else word.endswith(token, 0, at)):
            return 0
        n, at, t = n + 1, at + step * len(token), t + step
        if at == (len(word) if step > 0 else 0):
            return n
    return 0


def _in_a_row(words: tuple, j: int, stop: int, tokens: list, t: int, step: int) -> int:
    n = 0
    while n < 4 and j != stop and (k := _taken(words[j], tokens, t, step)):
        n, j, t = n + 1, j + step, t + step * k
    return n


def _followed(words: tuple, j: int, stop: int, tokens: list[str], blank: list[bool], t: int, step: int, passage: int, replaced: int) -> tuple[list, bool]:
    """From word j and token t on, for each word (word, first token, last token), None for both if it is exchanged; and
    whether it went on to the end of item or document. An exchanged word stands for one word of the document; where
    that has marks in it, what follows tells whether the part up to the mark is meant. It ends where too many in `passage` words are exchanged."""
    out: list[tuple[int, int | None, int | None]] = []
    wrong: list[int] = []
    while j != stop and 0 <= t < len(tokens):
        n = _taken(words[j], tokens, t, step)
        if n:
            out.append((j, *sorted((t, t + step * (n - 1)))))
            t += step * n
        else:
            wrong.append(len(out))
            if len(wrong) > replaced and wrong[-1] - wrong[-1 - replaced] < passage:
                return out, False
            out.append((j, None, None))
            part = whole = t + step
            while 0 <= whole < len(tokens) and not blank[whole if step > 0 else whole + 1]:
                whole += step
            if part != whole and _in_a_row(words, j + step, stop, tokens, part, step) > _in_a_row(words, j + step, stop, tokens, whole, step):
                whole = part
            t = whole
        j += step
    return out, True


def passages(text: str, items: tuple, passage: int, replaced: int) -> list[tuple[int, int, int, int]]:
    """(item, words, start, end) of the longest leaked passage of each item; start and end are places in the text."""
    run = run_length(passage, replaced)
    a = _automaton(items, run)
    if len(a) == 0:
        return []
    hits = list(a.iter(stream(text)))
    if not hits:
        return []
    tokens, starts, ends, blank = tokens_at(text)
    begins = dict(zip(accumulate(map(len, tokens), initial=0), range(len(tokens))))
    seen: set[tuple[int, int, int]] = set()
    best: dict[int, tuple[int, int, int]] = {}
    for last, (size, places) in hits:
        t = begins.get(last + 1 - size)
        if t is None:
            continue  # within a word
        for k, j in places:
            if (k, j, t) in seen:
                continue
            _, own, first = items[k]
            right, whole_right = _followed(own, j, len(own), tokens, blank, t, 1, passage, replaced)
            if any(x[1] is None for x in right[:run]):
                continue  # ends within a word
            left, whole_left = _followed(own, j - 1, first - 1, tokens, blank, t - 1, -1, passage, replaced)
            chain = left[::-1] + right
            # near an end that isn't the last one a later hit is followed anew
            low, high = 0 if whole_left else passage, len(chain) if whole_right else len(chain) - passage
            seen.update((k, w, s) for w, s, _ in chain[low:high] if s is not None)
            if len(chain) < passage:
                continue
            same = [s is not None for _, s, _ in chain]
            wrong, begin = passage - sum(same[:passage]), None
            for s in range(len(same) - passage + 2):  # the beginnings of good windows, and one place more
                good = s <= len(same) - passage and wrong <= replaced
                if good and begin is None:
                    begin = s
                elif not good and begin is not None:
                    one = next(x for x in range(begin, len(same)) if same[x])
                    other = next(x for x in range(s + passage - 2, -1, -1) if same[x])
                    found = other + 1 - one, starts[chain[one][1]], ends[chain[other][2]]
                    if k not in best or (found[0], -found[1]) > (best[k][0], -best[k][1]):
                        best[k] = found
                    begin = None
                if s < len(same) - passage:
                    wrong += same[s] - same[s + passage]
    return [(k, *found) for k, found in sorted(best.items())]


def _read_items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """item_id, words and first (words of a shared opening) of every distinct item with text, in the shared folder."""
    schema = T.StructType([T.StructField("id", items.schema[item_id].dataType), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("whole", T.LongType()), T.StructField("heads", T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("head", T.LongType())])))])
    heads_type = pa.list_(pa.struct([("n", pa.int32()), ("head", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_words_and_heads(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w for w, _, _ in found], pa.list_(pa.string())), pa.array([d for _, d, _ in found], pa.int64()), pa.array([[{"n": n, "head": d} for n, d in h] for _, _, h in found], heads_type)],
                ["id", "words", "whole", "heads"],
            )

    rows = cut(items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null").distinct().mapInArrow(read, schema))
    heads = rows.select("id", "whole", F.explode("heads").alias("h")).select("id", "whole", "h.n", "h.head")
    shared = heads.groupBy("head").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("head")
    # of one head there is one row in `shared`; items that share it are spread over tasks by their id
    first = heads.join(shared, "head", "left_semi").groupBy("id", "whole").agg(F.max("n").alias("first"))
    return cut(rows.join(first, ["id", "whole"], "left").select("id", "words", F.coalesce("first", F.lit(0)).alias("first")).orderBy("id", "words"))


def leaked_passages(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", passage: int = 20, replaced: int = 3, block: int = 5_000) -> DataFrame:
    """One row for each document and item of which the document holds `passage` or more successive words, in order, at
    most `replaced` in any `passage` exchanged: ids, item_words, start_char and end_char of the longest such passage, which begins and ends with a word of the item.

    Words are what blanks divide in the item. Case, accents, punctuation, look-alike characters, markup, entities,
    quoting, line breaks and the hyphens before them make no difference; leading sentences that different items share
    don't count. Null and empty texts hold nothing; items shorter than `passage` words never leak. Repeated rows yield
    repeated rows. The documents are never shuffled. Items are the query set: the driver takes them in blocks of
    `block`, one at a time, whose automaton is what a worker holds; the documents are scanned once a block, and where
    there are several blocks what one has found is stored before the next begins.
    """
    doc_type, item_type = documents.schema[doc_id].dataType, items.schema[item_id].dataType
    schema = T.StructType([T.StructField(doc_id, doc_type), T.StructField(item_id, item_type), T.StructField("item_words", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])
    item_arrow = to_arrow_type(item_type)
    spark = documents.sparkSession
    source = documents.select(doc_id, text)

    def scanned(part: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(tuple(part))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids, rows = batch.column(0), []
                for n, t in enumerate(batch.column(1)):
                    if t := t.as_py():
                        rows += [(n, *x) for x in passages(t, own, passage, replaced)]
                if rows:
                    at, k, words, start, end = zip(*rows)
                    item = pa.array([own[x][0] for x in k], item_arrow)
                    ints = [pa.array(x, pa.int32()) for x in (words, start, end)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), item, *ints], [doc_id, item_id, "item_words", "start_char", "end_char"])

        return source.mapInArrow(scan, schema)

    out, part = None, []
    for r in _read_items(items, item_id, item_text).toLocalIterator():
        if len(part) == block:
            found = cut(scanned(part))
            out, part = found if out is None else out.unionByName(found), []
        part.append((r[0], tuple(r[1]), r[2]))
    found = scanned(part)
    return found if out is None else out.unionByName(found)


def leaks_by_item(found: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """How many documents each leaked item is in, and the longest passage."""
    return found.groupBy(item_id).agg(F.count_distinct(doc_id).cast("long").alias("documents"), F.max("item_words").cast("long").alias("longest"))
