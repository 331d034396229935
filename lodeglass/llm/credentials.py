"""Credentials in source code, comments, configuration and paths: found, confirmed corpus-wide, re-scanned and masked.

Every file is scanned once for candidate literals: values of a known form, values given to names that mean a secret,
URLs, headers and private keys. The candidates of all files are indexed by value; values that many owners share are
placeholders, unless they are private keys or of a known form. What is left is confirmed, and every file is scanned
again for the confirmed values, so that a confirmed secret is found wherever it stands, also where nothing around it
tells what it is: the ends of all values are looked up at every byte at once, and an automaton over the values whose end
was met reads the files that have one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.session import BROADCAST_ROWS, cut, join_small

# Public formats of keys and tokens.
_FORMS = [
    re.compile(p)
    for p in (
        r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9+/=])",
        r"gh[pousr]_[A-Za-z0-9]{36,}+",
        r"github_pat_[A-Za-z0-9_]{22,}+",
        r"glpat-[A-Za-z0-9_\-]{20,}+",
        r"npm_[A-Za-z0-9]{36}",
        r"pypi-[A-Za-z0-9_\-]{32,}+",
        r"xox[abeoprs]-[A-Za-z0-9\-]{16,}",
        r"AIza[A-Za-z0-9_\-]{35}(?![A-Za-z0-9])",
        r"(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}",
        r"sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_]{20,}(?:[\-_][A-Za-z0-9_]{8,})*",
        r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
        r"hf_[A-Za-z0-9]{30,}",
        r"dop_v1_[a-f0-9]{40,}",
        r"whsec_[A-Za-z0-9+/=]{24,}",
        r"eyJ[A-Za-z0-9_\-]{12,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+",
    )
]
_PREFIXES = ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "pypi-", "xoxa-", "xoxb-", "xoxe-", "xoxo-", "xoxp-", "xoxr-", "xoxs-", "aiza", "sk_live_", "rk_live_", "pk_live_", "sk-", "sg.", "hf_", "dop_v1_", "whsec_", "eyj")
# Words that end the name of a secret, words that make "key" one, and words after which a name means
# something about a secret rather than the secret.
_SECRET_WORDS = frozenset("secret secrets password passwd pwd pw pass passphrase passcode token credential credentials apikey auth authorization authtoken pat".split())
_KEY_WORDS = frozenset("api access secret private hmac encryption encrypt signing sign model maps client deploy service account master session shared storage server auth crypto cipher aes jwt app application license webhook admin root ssh pem subscription write admin ingest".split())
_NOT_SECRET = frozenset("public kind field type name id count limit budget size length index url uri path file hint label format policy expiry ttl header prefix column env var digest hash checksum integrity commit sha".split())
_CUES = ("secret", "passw", "passphrase", "passcode", "pass", "pwd", "pw", "token", "credential", "apikey", "key", "auth", "bearer ", "basic ")
_NAME = re.compile(r"[A-Za-z0-9_.\-]*$")
_NAME_END = re.compile(r"[A-Za-z0-9_\-]*")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
#: What may stand between a name and its value: closing quotes and brackets, then a sign of giving.
_GIVEN = re.compile(r"""["'`\])]{0,3}\s{0,4}(?::\s*[A-Za-z<>\[\]]{2,20}\s+=|:=|=>|==?|:|,|\?\?|\|\||\bis\b|->)\s{0,24}(?:b|r|u|f)?(?=["'`]|[^\s"'`])|["'`\])]{0,3}\s{1,2}(?=["'`])""")
#: Values in the elements and attributes of markup: <password>..., key="password" value="..."
_ELEMENT = re.compile(r">\s{0,24}([^<>\s]{8,}+)\s*</")
_ATTRIBUTE = re.compile(r"""["']\s+value\s{0,4}=\s{0,4}(?=["'])""", re.I)
_LOOSE = re.compile(r"\s{1,2}(?:is\s|was\s|=\s?)?")
_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\\]*)`')
_JOIN = re.compile(r"\s{0,8}(?:\+|\.|\\)?\s{0,40}(?:b|r|u|f)?(?=[\"'`])")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]{8,}+")
_PLACEHOLDER = re.compile(
    r"""(?ix) ^(?:<.*>|\{\{.*|\$[\({]?.*|%[({]?\w+[)}]?s?|\[.*\]|\#\{.*)$ | example | your[_\- ]?\w | change[_\-]?me | placeholder | dummy | redacted | masked | insert[_\- ] | replace[_\- ]?(?:me|with) | fixme | todo
        | set\ in | ^(?:test|sample|fake|mock|foo|bar|none|null|nil|true|false|undefined|secret|password|token|admin|root|default|changeit|letmein)\w{0,4}$ | \*{3,} | x{6,} | \.{3} | ^-----BEGIN\ PUBLIC | process\.env | os\.environ | getenv | vault | keychain | secretsmanager """
)
_DIGEST = re.compile(r"^(?:sha\d{1,3}|md5|xxh\d+)[-:]", re.I)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_URL = re.compile(r"://([^\s:/@'\"`<>{}$]++):([^\s/@'\"`<>]{3,}+)@[A-Za-z0-9\[\"'`]")
_URL_KEY = re.compile(r"[?&](?:api_?key|key|token|access_token|auth|secret|sig|signature|password|pwd)=([^\s&'\"`<>#]{8,}+)", re.I)
_USER = re.compile(r"(?:-u|--user)[ =](?:(['\"])([^\s:'\"]++):([^'\"\n]{4,}+)\1|([^\s:'\"$]++):(['\"]?)([^\s'\"]{4,}+)\5)")
_SCHEME = re.compile(r"(?:bearer|basic)\s+([A-Za-z0-9+/=._~\-]{12,}+)", re.I)
_SCHEME_WORD = re.compile(r"(?:Bearer|Basic|Token)\s+", re.I)
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]{2,10} )?(?:ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:\\[nr]|[\s\"'`+,\\.]|Proc-Type:[^\n]*|DEK-Info:[^\n]*)*([A-Za-z0-9+/=]{16,})")
_PEM_HEAD = re.compile(r"PRIVATE KEY(?: BLOCK)?-----(?:\\[nr]|[\s\"'`+,\\.])*$")
_PEM_REST = re.compile(r"(?:(?:\\[nr]|[\s\"'`+,\\.])*(?!-----)[A-Za-z0-9+/=]{4,})*")

# Characters of a value by which the automaton knows it, and of all values of one block; bytes at the end
# of a value that are looked up, and the size of the table that says which may be one.
_HEAD_CHARS, _BLOCK_CHARS = 256, 64_000_000
_TAIL, _TAIL_BITS, _SPREAD = 8, 24, np.uint64(0x9E3779B97F4A7C15)

Find = tuple[int, int, str, tuple]  # start, end, value, pieces to mask


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def secret_name(name: str) -> bool:
    """Whether a variable, key, header or option of this name holds a secret."""
    words = [w.lower() for w in _CAMEL.findall(name)]
    while words and (words[-1].isdigit() or words[-1] in ("value", "str", "string", "text", "raw", "b", "default")):
        words.pop()
    if not words or words[-1] in _NOT_SECRET or "public" in words:
        return False
    joined = "".join(words)
    if words[-1] in _SECRET_WORDS or joined.endswith(("password", "passwd", "passphrase", "apikey", "secretkey")):
        return True
    return words[-1] == "key" and len(words) > 1 and any(w in _KEY_WORDS for w in words[:-1])


def _alike(v: str) -> bool:
    return len(set(v)) <= 3 or max(Counter(v).values()) > 0.6 * len(v)


def plausible(value: str, named: bool = True) -> bool:
    """Whether a value can be a secret at all: long and irregular, no placeholder, look-up, digest or plain word."""
    v = value.strip()
    if len(v) < 8 or any(c in v for c in "\n\r\t") or " " in v or _PLACEHOLDER.search(v) or _DIGEST.match(v) or _alike(v):
        return False
    letters, digits, signs = sum(map(str.isalpha, v)), sum(map(str.isdigit, v)), sum(not c.isalnum() for c in v)
    if re.fullmatch(r"[\w\-]+(?:[./][\w\-]+)*\.(?:ts|js|py|go|java|json|sh|css|md|ya?ml|txt|html|pem|key|crt)", v) or re.match(r"(?:https?|ftp|file)://|\.{0,2}/[\w./-]*$", v):
        return False
    if re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+(?:\(.*)?", v) and not re.search(r"\d{2}", v) or re.search(r"\w\(", v):
        return False
    if re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)*(?:[-_.]?\d{1,4})?|[A-Z_]+|(?:[A-Z]?[a-z]{3,}+)++\d{0,2}", v) and (named is False or len(v) < 24):
        return False  # words
    if letters == 0 or digits == 0 and (signs == 0 or signs == len(re.findall(r"[-_.]", v))):
        return False
    if _UUID.match(v):
        return named
    return entropy(v) >= (2.6 if named else 2.9)


def _formed(text: str, at: int = 0) -> re.Match | None:
    for form in _FORMS:
        if m := form.match(text, at):
            return m
    return None


def _good_form(v: str) -> bool:
    core = re.sub(r"^(?:AKIA|ASIA|[a-z]{2,6}[-_](?:live_)?|github_pat_|AIza|eyJ)", "", v)
    return not _PLACEHOLDER.search(v) and not _alike(core) and entropy(core) >= 2.8 and bool(re.search(r"\d", core)) and bool(re.search(r"[A-Za-z]", core))


def structured(value: str) -> bool:
    """Whether a value is of a known form, and so a credential however many owners have it."""
    return (m := _formed(value)) is not None and _good_form(m.group())


def _literal(text: str, at: int, known: dict[int, tuple]) -> tuple[str, list[tuple[int, int]], int] | None:
    """The string literal at a place with all literals joined to it: value, places of its pieces, end. `known` keeps
    the chains read so far, each literal with the start of the next, so that every literal is read once."""
    values, pieces, end = [], [], at
    while at is not None:
        if at not in known:
            m = _QUOTED.match(text, at)
            if not m:
                break
            j = _JOIN.match(text, m.end())
            k, joined = m.lastindex or 1, j and ("+" in j.group() or "\\" in j.group() or "." in j.group())
            known[at] = m.group(k), m.span(k), m.end(), j.end() if joined else None
        value, piece, end, at = known[at]
        values.append(value)
        pieces.append(piece)
    return ("".join(values), pieces, end) if pieces else None


def _within(pieces: list[tuple[int, int]], start: int, end: int) -> tuple[tuple[int, int], ...]:
    """The places in the text of a part of a joined value."""
    spans, seen = [], 0
    for i, j in pieces:
        a, b = max(start, seen), min(end, seen + j - i)
        if a < b:
            spans.append((i + a - seen, i + b - seen))
        seen += j - i
    return tuple(spans)


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("form", _PREFIXES), ("cue", _CUES), ("url", ("://",)), ("query", ("?", "&")), ("user", ("-u ", "-u=", "--user ", "--user=")), ("pem", ("-----begin ",))):
        for w in words:
            a.add_word(w, (len(w), kind))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _named(text: str, at: int, end: int, known: dict[int, tuple]) -> Find | None:
    head = _NAME.search(text, max(0, at - 256), at).group()
    stop = _NAME_END.match(text, end).end()
    name = head + text[at:stop]
    loose = False
    if "key" == text[at:end].lower() and stop == end and not head.strip("-_."):  # words with blanks between, in comments
        before = re.search(r"([A-Za-z]+)[ ]$", text[max(0, at - 24) : at])
        name = f"{before.group(1)}_{name}" if before else name
    if not secret_name(name):
        return None
    if text[stop : stop + 1] == ">" and text[max(0, at - len(head) - 1) : at - len(head)] in ("<", ":"):
        m = _ELEMENT.match(text, stop)
        return (m.start(1), m.end(1), m.group(1), (m.span(1),)) if m and plausible(m.group(1)) else None
    g = _ATTRIBUTE.match(text, stop) or _GIVEN.match(text, stop)
    if not g:
        g = _LOOSE.match(text, stop)
        loose = True
        if not g or text[stop : stop + 1] not in (" ", "\t"):
            return None
    lit = _literal(text, g.end(), known)
    if lit:
        value, pieces, _ = lit
        # a look-up with a value in reserve
        if w := _SCHEME_WORD.match(value):
            value, pieces = value[w.end() :], [(pieces[0][0] + w.end(), pieces[0][1]), *pieces[1:]]
        if loose and len(value) < 8:
            return None
    else:
        b = _BARE.match(text, g.end())
        if not b:
            return None
        value = b.group().rstrip(".:")
        pieces = [(b.start(), b.start() + len(value))]
        if w := re.match(r"(?:Bearer|Basic)$", value, re.I):
            return None
        # bare words are code, unless they look like nothing else
        listed = text[b.start() - 1] == "=" and text[b.end() : b.end() + 1] in (";", '"', "'")  # one of the settings in a string
        if not plausible(value, False) or not listed and re.search(r"[a-z]{3,}[A-Z][a-z]{3,}", value) and not re.search(r"\d[A-Za-z]+\d|[+/=%#!]", value) or loose and entropy(value) < 3:
            return None
    if not plausible(value):
        return None
    return pieces[0][0], pieces[-1][1], value, tuple(pieces)


def candidates(text: str) -> list[Find]:
    """All places that look like a credential, without overlaps."""
    out: list[Find] = []
    done = -1
    low = _lower(text)
    known: dict[int, tuple] = {}
    for last, (n, kind) in _anchors().iter(low):
        at, end = last + 1 - n, last + 1
        find: Find | None = None
        if kind == "form":
            if at and (text[at - 1].isalnum() or text[at - 1] in "_+/" and low[at:end] in ("akia", "asia", "eyj")):
                continue
            m = _formed(text, at)
            if m and _good_form(m.group()):
                find = at, m.end(), m.group(), (m.span(),)
                if at and text[at - 1] in "\"'`" and text[m.end() : m.end() + 1] == text[at - 1]:  # it may go on in the parts joined to it
                    lit = _literal(text, at - 1, known)
                    if lit and (m := _formed(lit[0])) and m.end() > len(find[2]):
                        spans = _within(lit[1], 0, m.end())
                        find = at, spans[-1][1], m.group(), spans
            elif at and text[at - 1] in "\"'`":  # its form shows only when the parts are joined
                lit = _literal(text, at - 1, known)
                if lit and len(lit[1]) > 1 and (m := _formed(lit[0])) and _good_form(m.group()):
                    find = at, lit[1][-1][1], lit[0], tuple(lit[1])
        elif kind == "cue":
            if low[at:end] in ("bearer ", "basic "):
                if at and text[at - 1].isalnum():
                    continue
                if at and text[at - 1] in "\"'`" and (lit := _literal(text, at - 1, known)) and (w := _SCHEME_WORD.match(lit[0])):
                    value = lit[0][w.end() :]
                    if plausible(value, False) and len(value) >= 12:
                        find = lit[1][0][0] + w.end(), lit[1][-1][1], value, ((lit[1][0][0] + w.end(), lit[1][0][1]), *lit[1][1:])
                elif (m := _SCHEME.match(text, at)) and plausible(m.group(1).rstrip("."), False):
                    find = m.start(1), m.end(1), m.group(1), (m.span(1),)
            else:
                find = _named(text, at, end, known)
        elif kind == "url":
            if (m := _URL.match(text, at)) and not _PLACEHOLDER.search(m.group(2)) and not _alike(m.group(2)) and not m.group(2).startswith(("$", "{", "<", "%(")) and m.group(2).lower() not in ("password", "pass", "pwd", "pw", "secret", "token"):
                find = m.start(2), m.end(2), m.group(2), (m.span(2),)
            elif not m and (q := re.search(r"[\"'`][^\"'`\n]{0,40}$", text[max(0, at - 41) : at])):  # the literal may go on behind a plus
                lit = _literal(text, at - len(q.group()), known)
                if lit and len(lit[1]) > 1 and (m := _URL.match(lit[0], len(q.group()) - 1)) and not _PLACEHOLDER.search(m.group(2)) and not _alike(m.group(2)):
                    spans = _within(lit[1], *m.span(2))
                    find = spans[0][0], spans[-1][1], m.group(2), spans
        elif kind == "query":
            if (m := _URL_KEY.match(text, at)) and plausible(m.group(1), False):
                find = m.start(1), m.end(1), m.group(1), (m.span(1),)
        elif kind == "user":
            if (at == 0 or not text[at - 1].isalnum()) and (m := _USER.match(text, at)):
                k = 3 if m.group(3) else 6
                v = m.group(k)
                if v and plausible(v, len(v) < 14) and not re.fullmatch(r"[a-z]+(?:/[a-z]+)*", v):
                    find = m.start(k), m.end(k), v, (m.span(k),)
        elif kind == "pem":
            if (m := _PRIVATE.match(text, at)) and (b := _PEM_BODY.match(text, m.end())) and not _alike(b.group(1)) and entropy(b.group(1)) > 3:
                stop = _PEM_REST.match(text, b.end()).end()
                body = re.sub(r"[^A-Za-z0-9+/=]", "", text[b.start(1) : stop].replace("\\n", ""))
                find = at, stop, body, tuple(x.span() for x in re.finditer(r"(?:(?<!\\)|(?<=\\n))[A-Za-z0-9+/=]{4,}", text[b.start(1) : stop]))
                find = (find[0], find[1], find[2], tuple((b.start(1) + i, b.start(1) + j) for i, j in find[3]))
        if find and find[0] >= done:
            out.append(find)
            done = find[1]
    return out


def in_path(path: str) -> bool:
    """Whether a path holds a credential."""
    return bool(candidates(path)) or any(candidates(p.rsplit(".", 1)[0]) for p in path.split("/"))


def masked(text: str, pieces: list[tuple[int, int]]) -> str:
    """The text with the pieces starred out; lengths, line ends and everything else stay, so that offsets stay true."""
    out, at = [], 0
    for i, j in sorted(set(pieces)):
        i = max(i, at)
        if i < j:
            out += [text[at:i], re.sub(r"[^\r\n]", "*", text[i:j])]
            at = j
    return "".join([*out, text[at:]])


def lines_of(text: str, starts: list[int]) -> Iterator[int]:
    """The lines (split at \\n, from 1) of ascending places, in one walk."""
    line, at = 1, 0
    for start in starts:
        line, at = line + text.count("\n", at, start), start
        yield line


def candidate_literals(contents: DataFrame, owner: Column) -> DataFrame:
    """file_id, owner, content_key (md5 of the content), line_no, start_char, end_char, value, pieces (flat list of
    places), structured (whether the value is a private key or of a known form) of every candidate."""
    schema = "file_id long, owner string, content_key string, line_no int, start_char int, end_char int, value string, pieces array<int>, structured boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, t in enumerate(batch.column(3)):
                t = t.as_py()
                found = candidates(t)
                for line, (start, end, value, pieces) in zip(lines_of(t, [f[0] for f in found]), found):
                    rows.append((n, line, start, end, value, [x for p in pieces for x in p], bool(_PRIVATE.match(t, start)) or structured(value)))
            if rows:
                at, line, start, end, value, pieces, known = zip(*rows)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(3)), *(pa.array(x, pa.int32()) for x in (line, start, end)), pa.array(value), pa.array(pieces, pa.list_(pa.int32())), pa.array(known)],
                    ["file_id", "owner", "content_key", "line_no", "start_char", "end_char", "value", "pieces", "structured"],
                )

    rows = contents.where("content is not null").select("file_id", owner.alias("owner"), F.md5("content").alias("content_key"), "content")
    return rows.mapInArrow(scan, schema)


def confirmed_values(found: DataFrame, max_owners: int, limit: int) -> DataFrame:
    """Values of candidates that are structured or that at most `limit` owners have, max_owners at least: value, owners."""
    kept = F.col("structured") | (F.col("owners") <= max(max_owners, limit))
    return found.select("value", "owner", "structured").distinct().groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.max("structured").alias("structured")).where(kept).select("value", "owners")


def _value_automaton(values: list[str]) -> ahocorasick.Automaton:
    """Finds the heads of the values, each with all values that begin so."""
    heads: dict[str, list[str]] = {}
    for v in values:
        heads.setdefault(v[:_HEAD_CHARS], []).append(v)
    a = ahocorasick.Automaton()
    for head, whole in heads.items():
        a.add_word(head, (len(head), whole))
    a.make_automaton()
    return a


class Values:
    """A block of confirmed values as workers hold it: their bytes, and when first used an index of their last bytes."""

    def __init__(self, values: tuple[str, ...]):
        raw = [v.encode("utf-8", "surrogatepass") for v in values]
        self.bytes, self.ends, self.tails = b"".join(raw), np.cumsum([len(v) for v in raw], dtype=np.int64), None

    def __getstate__(self):
        return self.bytes, self.ends

    def __setstate__(self, state):
        (self.bytes, self.ends), self.tails = state, None

    def _index(self) -> None:
        tails = np.array([int.from_bytes(self.bytes[e - _TAIL : e], "little") for e in self.ends], np.uint64)
        self.order = np.argsort(tails, kind="stable")
        self.tails = tails[self.order]
        self.maybe = np.zeros(1 << _TAIL_BITS, np.bool_)
        self.maybe[self._slot(tails)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * _SPREAD) >> np.uint64(64 - _TAIL_BITS)

    def met(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The indices of the texts in which the last bytes of a value occur, and the values that have them."""
        if self.tails is None:
            self._index()
        _, starts, data = texts.buffers()
        starts = np.frombuffer(starts, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if data is None or starts[-1] - starts[0] < _TAIL:
            return np.empty(0, np.int64), []
        data = np.frombuffer(data, np.uint8, int(starts[-1] - starts[0]), int(starts[0]))
        codes = np.ndarray((len(data) - _TAIL + 1,), "<u8", data, strides=(1,))
        hits, which = [], []
        for low in range(0, len(codes), 1 << 18):
            part = codes[low : low + (1 << 18)]
            some = np.flatnonzero(self.maybe[self._slot(part)])
            tails = part[some]
            at = np.searchsorted(self.tails, tails)
            same = self.tails[np.minimum(at, len(self.tails) - 1)] == tails
            hits.append(some[same] + low)
            which.append(np.unique(tails[same]))
        rows = np.unique(np.searchsorted(starts - starts[0], np.concatenate(hits), "right") - 1)
        values = []
        for tail in np.unique(np.concatenate(which)):
            for k in self.order[np.searchsorted(self.tails, tail) : np.searchsorted(self.tails, tail, "right")]:
                values.append(self.bytes[self.ends[k - 1] if k else 0 : self.ends[k]].decode("utf-8", "surrogatepass"))
        return rows, values


def _blocks(values: Iterator[str], block: int) -> Iterator[tuple[str, ...]]:
    part, chars = [], 0
    for v in values:
        if part and (len(part) == block or chars + len(v) > _BLOCK_CHARS):
            yield tuple(sorted(part))
            part, chars = [], 0
        part.append(v)
        chars += len(v)
    if part:
        yield tuple(sorted(part))


def _stands_alone(text: str, i: int, j: int, exact: bool) -> bool:
    """Whether a value at a place is whole: no word goes on before or behind it; exact: quotes or blanks enclose it."""
    if exact:
        return all(not c or c.isspace() or c in "\"'`" for c in (text[i - 1 : i] if i else "", text[j : j + 1]))
    if i and text_like(text[i - 1]) and text_like(text[i]) or j < len(text) and text_like(text[j]) and text_like(text[j - 1]):
        return False
    return not _PEM_HEAD.search(text, max(0, i - 80), i)  # the body of a private key begins at its header


def occurrences(contents: DataFrame, values: DataFrame, *, block: int = 1_000_000, exact_below: int = 12) -> DataFrame:
    """file_id, content_key, line_no, start_char, end_char, value of all whole occurrences of the values (column `value`)
    in the contents. Values of fewer than exact_below characters must be irregular and stand between quotes or blanks,
    else they would be found by chance. The driver takes the values in blocks of `block`, or of 64 million characters,
    one at a time; each is one pass over the files, and where there are several, what one has found is stored before the
    next begins."""
    spark = contents.sparkSession
    schema = "file_id long, content_key string, line_no int, start_char int, end_char int, value string"
    rows = contents.where("content is not null").select("file_id", F.md5("content").alias("content_key"), "content")

    def scanned(part: tuple[str, ...]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Values(part))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, found = batch.column(2), []
                which, values = shared.value.met(texts)
                a = _value_automaton(values) if values else None
                for n in which:
                    t = texts[int(n)].as_py()
                    places = []
                    for last, (size, whole) in a.iter(t):
                        i = last + 1 - size
                        for v in whole:
                            j = i + len(v)
                            if (j == last + 1 or t.startswith(v, i)) and _stands_alone(t, i, j, len(v) < exact_below):
                                places.append((i, j, v))
                    places.sort()
                    found += [(n, line, *p) for line, p in zip(lines_of(t, [p[0] for p in places]), places)]
                if found:
                    at, line, start, end, value = zip(*found)
                    at = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int32()) for x in (line, start, end)), pa.array(value)], [f.split()[0] for f in schema.split(", ")])

        return rows.mapInArrow(scan, schema)

    out = waiting = None
    stream = (r[0] for r in values.toLocalIterator())
    for part in _blocks((v for v in stream if len(v) >= exact_below or plausible(v)), block):
        if waiting is not None:
            found = cut(waiting)
            out = found if out is None else out.unionByName(found)
        waiting = scanned(part)
    if waiting is None:
        return spark.createDataFrame([], schema)
    return waiting if out is None else out.unionByName(waiting)


def text_like(c: str) -> bool:
    return c.isalnum()


def repository_and_package(path: Column) -> Column:
    """The owner of a literal: the first three folders of its file's path, or the fewer there are."""
    return F.substring_index(F.regexp_replace(path, "[^/]*$", ""), "/", 3)


def credentials(files: DataFrame, contents: DataFrame, *, max_owners: int = 5, owner_share: float = 0.01, block: int = 1_000_000, rescan_length: int = 12, broadcast_rows: int = BROADCAST_ROWS, unnamed: bool = False) -> DataFrame:
    """file_id, content_key (md5 of the content), line_no, start_char, end_char and pieces of every credential; line_no 0
    and a null content_key where the path contains one.

    Input: files (file_id, path), contents (file_id, path, content); further columns are ignored. Null contents have no
    rows, null ids only if `unnamed` is set, repeated deliveries yield one row. Values that more than max_owners packages
    share, and more than owner_share of all packages, are placeholders, private keys and known forms excepted. Confirmed
    values are looked for in all files again, those of fewer than rescan_length characters as exact tokens. Not taken for
    credentials: values of fewer than 8 characters, with blanks in them, of letters only or of digits only (those in
    addresses, behind user names, excepted).
    """
    owner = repository_and_package(F.col("path"))
    found = cut(candidate_literals(contents, owner))
    owners = contents.where("content is not null").agg(F.count_distinct(owner)).first()[0]
    good = cut(confirmed_values(found, max_owners, int(owner_share * owners)))
    own = join_small(found, good.select("value"), ["value"], "left_semi", max_rows=broadcast_rows).select("file_id", "content_key", "line_no", "start_char", "end_char", "pieces")
    again = occurrences(contents, good.select("value"), block=block, exact_below=rescan_length)
    again = again.select("file_id", "content_key", "line_no", "start_char", "end_char", F.array("start_char", "end_char").alias("pieces"))

    @F.pandas_udf("boolean")
    def bad_path(paths):
        return paths.map(lambda p: p is not None and in_path(p)).astype(bool)

    paths = files.select("file_id", "path").unionByName(contents.select("file_id", "path")).where("path is not null").distinct()
    none = F.lit(0)
    named = paths.where(bad_path("path")).select("file_id", F.lit(None).cast("string").alias("content_key"), none.alias("line_no"), none.alias("start_char"), none.alias("end_char"), F.array().cast("array<int>").alias("pieces"))
    rows = own.unionByName(again).unionByName(named)
    return (rows if unnamed else rows.where("file_id is not null")).distinct()


def mask_credentials(contents: DataFrame, found: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The contents with all credentials of `found` starred out, and their number in column `masked`, which
    replaces one of that name; null contents stay null. Lengths don't change, so byte offsets of symbols stay true.

    Places belong to a content, whatever row it stands in: other contents of the same file keep theirs, copies and rows
    without id get the same masks. They are gathered per content and broadcast if they are few; beyond broadcast_rows
    contents with credentials both sides are shuffled with a salt.
    """
    key, pieces, number = "__content_key__", "__pieces__", "__n__"
    places = found.where("line_no > 0").select(F.col("content_key").alias(key), "start_char", "pieces").distinct().groupBy(key).agg(F.flatten(F.collect_set("pieces")).alias(pieces), F.count_distinct("start_char").cast("int").alias(number))

    @F.pandas_udf("string")
    def star(texts, pieces):
        import pandas as pd

        return pd.Series([t if t is None or p is None or not len(p) else masked(t, list(zip(p[0::2], p[1::2]))) for t, p in zip(texts, pieces)], dtype=object)

    keyed = contents.drop(key, pieces, number, "masked").withColumn(key, F.md5("content"))
    joined = join_small(keyed, cut(places), [key], "left", max_rows=broadcast_rows)
    starred = F.when(F.col(number).isNull(), F.col("content")).otherwise(star("content", pieces))
    return joined.withColumn("content", starred).withColumn("masked", F.coalesce(number, F.lit(0))).drop(key, pieces, number)
