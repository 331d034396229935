"""Personal information in free text: an automaton finds anchors, local parsers expand them to what they belong to.

Anchors are at-signs (also spelled out), plus signs, and words that introduce a number, an address or a name. Each
kind of anchor has a parser that reads the characters around it, checks the form and sets the bounds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Of overlapping finds the one of the earlier kind stays.
RANK = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}

# Anchors by parser, in lower case.
AT_SIGNS = ("@", " at ", "(at)", "[at]", "{at}", "<at>", " (at) ", " [at] ", " {at} ", "&#64;")
PHONE_CUES = ("+", "tel", "phone", "call", "text", "fax", "mobile", "cell", "number", "message at", "reach", "unter", "ruf", "handy", "appel", "télé", "llam", "whatsapp", "(")
ID_CUES = (
    "social security", "ssn", "national insurance", "ni number", "ni no", "nino", "steuer-id", "steueridentifikationsnummer", "tax id", "tax number", "tin", "passport", "reisepass", "passeport", "pasaporte", "personalausweis", "ausweisnummer",
    "dni", "nie", "nif", "national id", "national identity", "documento nacional", "carte d'identité", "numéro de sécurité sociale", "sécurité sociale", "nir", "seguridad social", "id card", "identity card", "identity number", "id number", "driver's license", "driving licence", "sozialversicherungsnummer",
)
STREET_WORDS = (
    "street", "avenue", "lane", "road", "close", "drive", "boulevard", "court", "square", "terrace", "crescent", "highway", " st ", " st.", " st,", " ave", " rd", " blvd", " ln ", " dr ", "straße", "strasse", "str.", "gasse", "allee", "weg ", "platz ",
    "am ", "an der ", "auf dem ", "rue ", "chemin ", "place ", "allée", "impasse", "calle", "avenida", "plaza", "paseo", "camino", "p.o. box", "po box", "postfach",
)
NAME_BEFORE = (
    "thanks to", "thank you,", "talked to", "spoke to", "spoke with", "talked with", "met with", "colleague", "reported by", "reported-by:", "reviewed by", "reviewed-by:", "signed-off-by:", "acked-by:", "tested-by:", "co-authored-by:", "assignee:", "assigned to",
    "author:", "reporter:", "reviewer:", "approved by", "written by", "suggested by", "found by", "regards,", "cheers,", "sincerely,", "best wishes,", "grüße,", "grüßen,", "gruß,", "saludos,", "atentamente,", "cordialement,", "salutations,", "amitiés,",
    "danke an", "dank an", "gesprochen mit", "kollege", "kollegin", "gemeldet von", "merci à", "collègue", "signalé par", "gracias a", "compañero", "compañera", "informado por", "dear ", "hello ", "hi ", "mr. ", "mrs. ", "ms. ", "dr. ", "prof. ", "herr ", "frau ", "monsieur ", "madame ", "señor ", "señora ", "name:", "contact:", "cc ", "from:", "contact ", "my name is", "ask ", "this is", "i am ", "i'm ", "mi nombre es", "me llamo", "ich heiße", "mein name ist", "je m'appelle",
)
NAME_AFTER = (" wrote", " said on", " schrieb", " a écrit", " escribió", " asked on", " replied", " commented", " pointed out", " mentioned", " explained", " suggested", " confirmed", " noticed", " told me", " hat geschrieben", " fragte", " a signalé", " preguntó")
#: Endings that a host part has in file names, not in mail domains.
_FILE_ENDS = frozenset("png jpg jpeg gif svg webp css js ts tsx jsx py go java json md txt html xml yml yaml sh lock map".split())

_LOCAL = re.compile(r"[A-Za-z0-9À-ÿ._%+\-]{1,64}$")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ\-]{0,62})\.)+([A-Za-z]{2,24})(?![A-Za-z0-9\-])")
_SEP = r"(?:\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\sdot\s|\.)"
_SPELLED = re.compile(rf"([A-Za-z0-9\-]{{1,63}}(?:{_SEP}[A-Za-z0-9\-]{{1,63}})+)")
_DOT = re.compile(_SEP)
_INTERNATIONAL = re.compile(r"\+[1-9]\d{0,2}(?:[ .\-/]?\(?\d{1,4}\)?){1,7}(?![\w])")
_EXTENSION = re.compile(r"\s?(?:ext\.?|x|extension|durchwahl)\s?\d{1,6}\b", re.I)
_NATIONAL = re.compile(r"(?<![\w.+\-])(?:1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}|\(\d{3,5}\)[ \-]?\d{3}[-. ]?\d{3,5}|\d{3}[-. ]\d{3}[-. ]\d{4}|0\d(?:[ .\-]?\d{2}){4}|0\d{2,5}[ /\-]\d{3,8}(?:[ \-]\d{1,6})?|0\d{9,11}|1?[2-9]\d\d[2-9]\d{6}|\d{3}-\d{4})(?![\w\-]|\.\d)")
_GAP = re.compile(r"(?:\s|[:.=#()'\"\-]|\b(?:no|nr|n[°º]|num|number|numbers?|is|was|me|us|him|her|them|at|on|under|unter|bitte|please|again|us|to|und|oder|or|im|back|ist|lautet|es|est|el|le|al|au)\b\.?)*", re.I)
_ID_VALUES = re.compile(
    r"(?<![\w\-])(?:\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?|[A-Z]\d{8}|[A-Z]{1,2}\d{6,9}|[CFGHJKLMNPRTVWXYZ][0-9A-Z]{8}|\d{9}|\d{11})(?![\w\-])"
)
_ID_GAP = re.compile(r"(?:[\s:=#\"'.()]|\b(?:no|nr|num|number|nummer|numéro|número|n[°º]|is|was|ist|es|est|card|on|file|of)\b)*", re.I)
_ID_BEFORE = re.compile(r"\s(?:in the|as|im|in der|dans la|en la|is the|is my|,)\s(?:the\s|my\s|his\s|her\s)?$", re.I)

_NUM = r"\d{1,5}(?:[ ]?[a-zA-Z](?![\w]))?(?:[-/]\d{1,4})?"
_CAP = r"[A-ZÀ-Þ][\w'’\-]*"
_POSTCODE = r"[A-Z]{1,2}\d[\dA-Z]?[ ]\d[A-Z]{2}"
_TOWN = rf"{_CAP}(?:[ ](?:(?:am|an der|de|del|de la|sur|upon|of)[ ])?(?!{_POSTCODE}){_CAP})?"
_ADDRESSES = [
    re.compile(p)
    for p in (
        rf"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite)[ ]\w{{1,4}},[ ])?{_NUM}[ ]{_CAP}(?:[ ]{_CAP}){{0,3}}?[ ](?:Street|Avenue|Lane|Road|Close|Drive|Boulevard|Court|Square|Terrace|Crescent|Highway|Way|Place|St\.?|Ave\.?|Rd\.?|Blvd\.?|Ln\.?|Dr\.?)(?:[ ,]+(?:Apt\.?|Unit|Suite|Flat|#)[ ]?\w{{1,5}})?,\s{_TOWN}(?:,?\s(?:[A-Z]{{2}}\s)?\d{{4,6}}(?:-\d{{4}})?|,?\s{_POSTCODE})?",
        rf"{_NUM},?[ ](?:bis |ter )?(?:rue|avenue|boulevard|chemin|place|allée|impasse|quai|cours)(?:[ ](?:de la|de l'|de|du|des|d'|{_CAP}))*(?:[ ]?{_CAP})?,\s\d{{4,6}}\s{_TOWN}",
        rf"(?:{_CAP}(?:straße|strasse|str\.|gasse|allee|weg|platz)|(?:{_CAP}[ ])(?:Straße|Strasse|Allee|Weg|Platz|Gasse)|(?:Am|An der|Auf dem|Im|Zum|Zur)[ ]{_CAP}(?:[ ]{_CAP})?)[ ]{_NUM},\s(?:[A-Z]{{1,2}}-)?\d{{4,6}}\s{_TOWN}",
        rf"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino)(?:[ ](?:del|de la|de los|de las|de|la|el|{_CAP}))*[ ]{_NUM},\s\d{{4,6}}\s{_TOWN}",
        rf"(?:P\.?O\.? Box|Postfach|Apartado)[ ]\d[\d ]{{0,8}},\s(?:\d{{4,6}}\s)?{_TOWN}(?:\s\d{{4,6}})?",
    )
]
_STREET_REACH = 90

_PART = r"(?:[A-ZÀ-Þ][a-zà-ÿ'’]+|[A-ZÀ-Þ]{2,}|[A-ZÀ-Þ][a-zà-ÿ]+[A-ZÀ-Þ][a-zà-ÿ]+|[OD]['’][A-ZÀ-Þ][a-zà-ÿ]+)"
_WHOLE = rf"{_PART}(?:-{_PART})*"
_NAME = re.compile(rf"(?:(?:{_WHOLE}|[A-ZÀ-Þ]\.)(?:[ ](?:von|van|de|del|da|di|der|den|la|le))*(?:[ ](?:{_WHOLE}|[A-ZÀ-Þ]\.)){{1,3}}|{_WHOLE},[ ]{_WHOLE}(?:[ ][A-ZÀ-Þ]\.)?)(?![\w@])")
_NAME_GAP = re.compile(r"(?:[ \t:<\"'*_]|\b(?:my|our|colleagues?|mr\.?|mrs\.?|ms\.?|dr\.?|prof\.?)\b)*", re.I)
_SENTENCE = re.compile(r"(?<!\b[A-ZÀ-Þ])[.!?:;]\s|[\n•*|>]|\A")
#: Capitalised words that begin sentences or name things, never persons.
_NO_NAME = frozenset("Neither Cloned Verified Moved Mail Ship Contact Reported Reviewed Signed Assignee Regards Offset Lane Note Also Then There Here He She They Nous On Desde Depuis Seit Wenn Nach Mit Hat Kann Peut Conviene Después Hemos Mantenemos Merci Gracias Danke Für Fehler Are Was Were Is Be By To Of As How Why What Which Who Where The A An This That These Those It If In On At For From With Without After Before When While Please See Call Use Only Raising Version Release Expected Actual Does Do We I You Neither Nobody Moved Fixed Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Windows Linux README API JSON HTML HTTP URL CI PR SDK CLI TODO FIXME Der Die Das Ein Eine Bitte Wir Im Am Le La Les Un Une Il Nous El Los Las Se Si No Set Build Row Text Phone Address Return Our Your Their My Its Not And Or But So".split())


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    of: dict[str, set[str]] = {}
    for kind, words in (("email", AT_SIGNS), ("phone", PHONE_CUES), ("id_number", ID_CUES), ("address", STREET_WORDS), ("name", NAME_BEFORE), ("name_after", NAME_AFTER)):
        for w in words:
            of.setdefault(w, set()).add(kind)
    for w, kinds in of.items():
        a.add_word(w, (len(w), tuple(sorted(kinds))))
    a.make_automaton()
    return a


def _email(text: str, at: int, end: int) -> tuple[int, int] | None:
    sign = text[at:end]
    left = _LOCAL.search(text, max(0, at - 64), at)
    if not left:
        return None
    start = left.start()
    while start < at and text[start] in ".-+%":
        start += 1
    if start >= at or text[at - 1] == ".":
        return None
    before = text[max(0, start - 60) : start]
    if sign in ("@", "&#64;"):
        m = _DOMAIN.match(text, end)
        if not m or m.group(1).lower() in _FILE_ENDS:
            return None
        token = before[max(before.rfind(" "), before.rfind("\n")) + 1 :]
        if "://" in token or before[-1:] in ("/", ":") and "mailto:" not in token:
            return None
        after = text[m.end() : m.end() + 1]
        if after in (":", "/") and re.match(r"[:/][\w~]", text[m.end() : m.end() + 2]):  # host:path of a repository
            return None
        if text[start:at].lower() in ("git", "hg", "svn") and after == ":":
            return None
        return start, m.end()
    m = _SPELLED.match(text, end)
    if not m:
        return None
    labels = [x for x in _DOT.split(m.group(1)) if x]
    if len(labels) < 2 or not re.fullmatch(r"[A-Za-z]{2,24}", labels[-1]):
        return None
    if sign == " at " and not re.search(r"\sdot\s|\[dot\]|\(dot\)", m.group(1)):
        return None
    return start, m.end()


def _differs(value: str) -> bool:
    """Whether the digits of a number aren't all the same."""
    return len(set(filter(str.isdigit, value))) > 1


def _plausible(digits: str) -> bool:
    return len(set(digits)) > 2


def _phone(text: str, at: int, end: int) -> tuple[int, int] | None:
    sign = text[at:end]
    if sign == "+":
        if at and (text[at - 1].isalnum() or text[at - 1] == "+"):
            return None
        m = _INTERNATIONAL.match(text, at)
        if not m:
            return None
        digits = re.sub(r"\D", "", m.group())
        if not 8 <= len(digits) <= 15:
            return None
    else:
        if sign == "(":
            m = re.compile(r"\(\d{3}\) ?\d{3}-\d{4}(?![\w\-])").match(text, at)
        else:
            if at and text[at - 1].isalpha() and sign not in ("ruf", "phone", "unter"):
                return None
            while end < len(text) and text[end].isalpha():
                end += 1
            m = _NATIONAL.match(text, _GAP.match(text, end).end())
            if sign == "number" and m and re.search(r"(?i)(ticket|run|build|order|issue|version|port|line|invoice|case|job|serial|part)[ \-]$", text[max(0, at - 10) : at]):
                return None
        if not m or not _plausible(re.sub(r"\D", "", m.group())):
            return None
    stop = m.end()
    if x := _EXTENSION.match(text, stop):
        stop = x.end()
    return m.start(), stop


def _identity(text: str, at: int, end: int) -> tuple[int, int] | None:
    if at and text[at - 1].isalnum() or end < len(text) and text[end].isalnum() and not text[at:end].lower().endswith(("no", "number", "id")):
        return None
    m = _ID_VALUES.match(text, _ID_GAP.match(text, end).end())
    if m:
        return m.span() if _differs(m.group()) else None
    head = text[max(0, at - 60) : at]
    if link := _ID_BEFORE.search(head):
        values = [v for v in _ID_VALUES.finditer(head, 0, link.start()) if v.end() == link.start()]
        if values and _differs(values[-1].group()):
            base = max(0, at - 60)
            return base + values[-1].start(), base + values[-1].end()
    return None


def _address(text: str, at: int, end: int) -> tuple[int, int] | None:
    lo = max(0, at - _STREET_REACH)
    best = None
    for pattern in _ADDRESSES:
        for m in pattern.finditer(text, lo, min(len(text), end + 2 * _STREET_REACH)):
            if m.start() <= at + 1 and m.end() >= end - 1 and (lo == 0 or m.start() > lo) and not (m.start() and text[m.start() - 1].isalnum()):
                stop = m.end()
                last = re.search(r"\s([^\W\d]+)$", m.group())
                if last and last.group(1) in _NO_NAME:  # the next sentence, without a full stop before it
                    stop = m.start() + last.start()
                if best is None or stop - m.start() > best[1] - best[0]:
                    best = m.start(), stop
    return best


def _name_length(s: str) -> int:
    """Characters of s that are a name of two parts or more; what follows from a word that is no name isn't part of it."""
    stop, parts = 0, 0
    capitals = s[1:2].isupper()
    for m in re.finditer(r"[^ ,]+", s):
        w = m.group()
        if w in _NO_NAME or capitals and len(w) > 2 and not w.isupper():
            break
        stop, parts = m.end(), parts + 1
    return stop if parts >= 2 and any(len(p) > 2 for p in re.split("[ ,]+", s[:stop])) else 0


def _name(text: str, at: int, end: int) -> tuple[int, int] | None:
    if at and text[at - 1].isalnum():
        return None
    m = _NAME.match(text, _NAME_GAP.match(text, end).end())
    if not m or m.group().isupper() and len(m.group()) < 6 or not (n := _name_length(m.group())):
        return None
    stop = m.start() + n
    return None if text[stop : stop + 1] in ("@", "/", "\\", "_") else (m.start(), stop)


def _name_before(text: str, at: int, end: int) -> tuple[int, int] | None:
    lo = max(0, at - 60)
    cut = max((m.end() for m in _SENTENCE.finditer(text, lo, at) if m.end() <= at), default=lo)
    for start in (m.start() for m in re.finditer(r"[A-ZÀ-Þ]", text[cut:at])):
        if start and text[cut + start - 1].isalnum():
            continue
        m = _NAME.match(text, cut + start, at)
        if m and m.end() == at and _name_length(m.group()) == len(m.group()):
            return m.span()
    return None


_PARSERS = {"email": _email, "phone": _phone, "id_number": _identity, "address": _address, "name": _name, "name_after": _name_before}


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal information, in order, without overlaps."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = set()
    for last, (n, kinds) in _anchors().iter(lower):
        for kind in kinds:
            if span := _PARSERS[kind](text, last + 1 - n, last + 1):
                found.add((*span, "name" if kind == "name_after" else kind))
    out: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda x: (RANK[x[2]], x[0] - x[1], x[0])):
        n = bisect_left(out, s)
        if (n == 0 or out[n - 1][1] <= s[0]) and (n == len(out) or s[1] <= out[n][0]):
            out.insert(n, s)
    return out


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], PLACEHOLDER[kind]]
        at = end
    return "".join([*parts, text[at:]])


def personal_spans(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of personal information: the id, pii_kind, line_no (split at \\n, from 1), start_char,
    end_char and the value. Null and empty texts have none; repeated rows yield repeated rows. No shuffle."""
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField("pii_kind", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("line_no", "start_char", "end_char")), T.StructField("value", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, t in enumerate(batch.column(1).to_pylist()):
                line, at = 1, 0
                for start, end, kind in spans(t) if t else ():
                    line, at = line + t.count("\n", at, start), start
                    rows.append((n, kind, line, start, end, t[start:end]))
            if rows:
                at, kind, line, start, end, value = zip(*rows)
                ints = [pa.array(x, pa.int32()) for x in (line, start, end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(kind), *ints, pa.array(value)], [f.name for f in schema])

    return documents.select(doc_id, text).mapInArrow(scan, schema)


def redact_personal(documents: DataFrame, *, text: str = "text", found: str = "pii_found") -> DataFrame:
    """The documents with every piece of personal information replaced by a typed placeholder, and the number of pieces
    in column `found`, which replaces one of that name. Null texts stay null with a null number; all other columns stay
    as they are."""

    @F.pandas_udf("struct<text string, n int>")
    def replace(texts):
        import pandas as pd

        rows = [(None, None) if t is None else (redacted(t, s := spans(t)), len(s)) for t in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], "n": pd.array([r[1] for r in rows], dtype="Int32")})

    own = "__redacted__"
    new = documents.drop(own, found).withColumn(own, replace(F.col(text)))
    return new.withColumn(text, F.col(own)["text"]).withColumn(found, F.col(own)["n"]).drop(own)
