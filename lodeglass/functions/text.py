"""Query terms, globs, comments, lines and token estimates."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words as the full-text index sees them: runs of letters and digits.
WORDS = r"[\p{L}\p{N}]+"


def normalize_query(query: str) -> str:
    return query.strip().lower()


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9_]+", normalize_query(query)) if t]


def query_terms(query: str) -> list[str]:
    """The whole query and its tokens, each once, in order."""
    return list(dict.fromkeys(t for t in [normalize_query(query), *query_tokens(query)] if t))


def phrases(query: str) -> list[list[str]]:
    """The phrase prefixes a query is searched as: terms of two characters or more, as words of the full-text index."""
    found = [re.findall(r"[^\W_]+", t.strip()) for t in query_terms(query) if len(t.strip()) >= 2]
    return [p for p in found if p]


def words(col: Column | str) -> Column:
    """Words of a column in order; null is as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORDS), F.lit(0))


def squeeze(col: Column | str) -> Column:
    """White space folded to single blanks, none outside."""
    return F.trim(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"\s+", " "))


def token_estimate(col: Column | str) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(col) / 4)).cast("int")


def contains_word(col: Column, phrase: str) -> Column:
    """Whether the phrase stands in the column with word boundaries around it, whatever the case."""
    return col.rlike(r"(?i)\b" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", phrase) + r"\b")


# -- globs


def _brace(pattern: str, at: int) -> int:
    depth = 0
    for k in range(at, len(pattern)):
        depth += (pattern[k] == "{") - (pattern[k] == "}")
        if depth == 0:
            return k
    return -1


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob over relative paths: ** any folders, * and ? within one, [..] and {a,b}; names that
    begin with a dot match like all others."""
    p = re.sub(r"^\./", "", pattern.strip().replace("\\", "/"))

    def body(p: str) -> str:
        out, k = "", 0
        while k < len(p):
            c = p[k]
            if p.startswith("**/", k) and (k == 0 or p[k - 1] == "/"):
                out += "(?:[^/]+/)*"
                k += 3
            elif p.startswith("/**", k) and k + 3 == len(p):
                out += "(?:/.*)?"
                k += 3
            elif p.startswith("**", k):
                out += ".*"
                k += 2
            elif c == "*":
                out += "[^/]*"
                k += 1
            elif c == "?":
                out += "[^/]"
                k += 1
            elif c == "[" and (e := p.find("]", k + 2)) > 0:
                inner = p[k + 1 : e]
                out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
                k = e + 1
            elif c == "{" and (e := _brace(p, k)) > 0:
                parts, depth, last = [], 0, k + 1
                for j in range(k + 1, e + 1):
                    if j == e or p[j] == "," and depth == 0:
                        parts.append(p[last:j])
                        last = j + 1
                    elif p[j] in "{}":
                        depth += 1 if p[j] == "{" else -1
                out += "(?:" + "|".join(map(body, parts)) + ")"
                k = e + 1
            else:
                out += re.escape(c)
                k += 1
        return out

    return "^" + body(p) + "$"


def normal_match_path(col: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"\\", "/"), r"^\./", "")


def path_matches(col: Column | str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a path matches a glob of include, or any if there is none, and no glob of exclude."""
    path = normal_match_path(col)
    wanted, unwanted = ([glob_regex(g) for g in globs if g and g.strip()] for globs in (include, exclude))
    good = path.rlike("|".join(f"(?:{r})" for r in wanted)) if wanted else F.lit(True)
    return good & ~path.rlike("|".join(f"(?:{r})" for r in unwanted)) if unwanted else good


def matches_allowed(col: Column, allowed: Sequence[str]) -> Column:
    """A path is allowed if it equals an entry, or begins with one that ends in /**."""
    tests = [col.startswith(a[:-2]) if a.endswith("/**") else col == a for a in allowed]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def inside_root(path: str) -> str:
    """The normalised relative path; a ValueError if it is empty, absolute or leads out of the root."""
    if not path or not path.strip():
        raise ValueError("a file path is needed")
    normal = posixpath.normpath(path.replace("\\", "/"))
    if posixpath.isabs(normal) or re.match(r"[A-Za-z]:", normal) or normal == ".." or normal.startswith("../"):
        raise ValueError(f"the path leads out of the root: {path}")
    return normal


def dirname(col: Column | str) -> Column:
    """Folder of a path, . for none."""
    return F.when(F.instr(col, "/") == 0, ".").otherwise(F.regexp_replace(col, r"/[^/]*$", ""))


def basename(col: Column | str) -> Column:
    return F.regexp_replace(col, r"^.*/", "")


def extension(col: Column | str) -> Column:
    """Lower-case extension with its dot, or an empty string; a leading dot begins a name."""
    return F.lower(F.regexp_extract(basename(col), r"^.+(\.[^.]*)$", 1))


# -- comments and lines


def comment_summary(col: Column | str) -> Column:
    """First line of a comment that says something, without markers; null if none does."""
    c = F.col(col) if isinstance(col, str) else col
    block = F.regexp_replace(F.regexp_replace(c, r"^/\*+\s?", ""), r"\*/$", "")
    clean = lambda lines, marker: F.filter(F.transform(lines, lambda x: squeeze(F.regexp_replace(x, marker, ""))), lambda x: x != "")
    lines = F.when(c.startswith("/*"), clean(F.split(block, "\n"), r"^\s*\*\s?")).otherwise(clean(F.split(c, "\n"), r"^\s*//+\s?"))
    return F.get(lines, 0)


def line_window(content: Column, start_line: Column, end_line: Column, context: int = 0) -> dict[str, Column]:
    """source, start_line, end_line, start_byte and end_byte of some lines and `context` lines around them."""
    lines = F.split(content, "\n")
    first = F.greatest(F.lit(1), start_line - context)
    last = F.least(F.size(lines), end_line + context)
    source = F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")
    before = F.when(first > 1, F.concat(F.array_join(F.slice(lines, F.lit(1), first - 1), "\n"), F.lit("\n"))).otherwise("")
    start = F.octet_length(before)
    return {"source": source, "start_line": first, "end_line": last, "start_byte": start, "end_byte": start + F.octet_length(source)}


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets of its UTF-8 form."""
    raw = F.encode(content, "UTF-8")
    return F.decode(F.substring(raw, start + 1, F.greatest(F.lit(0), end - start)), "UTF-8")
