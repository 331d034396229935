"""Parsers that say whether a text is syntactically valid: recursive descent for statements, precedence climbing for
expressions, and panic-mode recovery, so that one pass finds all errors."""

from __future__ import annotations

import json
import re
import warnings
from bisect import bisect_right

from lodeglass.llm.parsing import go_text, java_text, json_text, python_text, script
from lodeglass.llm.parsing.base import deep_calls
from lodeglass.llm.parsing.shell_text import Shell

_SYNTHETIC = frozenset(("nl", "indent", "dedent"))
#: Languages by the names that files.language has.
LANGUAGES = frozenset("ts tsx js jsx typescript javascript python go java json bash sh shell".split()) - {"tsx", "jsx"}


def _lines(text: str, k: list[str], found: list[tuple[int, str]], tokens: re.Pattern) -> list[tuple[int, str]]:
    """The errors with the lines of their tokens."""
    places = [m.start() for m in tokens.finditer(text) if m.lastindex and not (m.lastindex == 1 and ("\n" in m.group(1) or m.group(1)[:1] in ("/", "#", " ", " ")))]
    breaks = [m.start() for m in re.finditer("\n", text)]
    out, real, at = [], 0, 0
    for index, message in sorted(found):
        while at < min(index, len(k)):
            real += k[at] not in _SYNTHETIC
            at += 1
        place = places[min(real, len(places) - 1)] if places else 0
        out.append((bisect_right(breaks, place) + 1, message))
    return out


def _shell_lines(s: Shell) -> list[tuple[int, str]]:
    return [(s.t.count("\n", 0, at) + 1, message) for at, message in s.errors]


def syntax_errors(text: str, language: str) -> list[tuple[int, str]] | None:
    """(line, message) of all errors; None if nothing can be said: an unknown language, or nesting beyond
    measure with no error before it; the errors before it are kept, as they make the text invalid."""
    with deep_calls():
        return _errors(text, language)


def _errors(text: str, language: str) -> list[tuple[int, str]] | None:
    p = s = None
    try:
        if language == "json":
            k = json_text.kinds(text)
            p = json_text.Json(k)
            tokens = json_text.TOKENS
            p.parse()
        elif language == "python":
            k, ends, names = python_text.kinds(text)
            p = python_text.Python(k, ends, names)
            tokens = python_text.TOKENS
            p.parse()
        elif language in ("ts", "typescript", "js", "javascript"):
            ts = language[0] == "t"
            k, ends, broken = script.kinds(text, ts)
            p = script.Script(k, ends, broken, ts)
            tokens = script.TOKENS
            p.parse()
        elif language == "go":
            k, ends = go_text.kinds(text)
            p = go_text.Go(k, ends)
            tokens = go_text.TOKENS
            p.parse()
        elif language == "java":
            k, ends = java_text.kinds(text)
            p = java_text.Java(k, ends)
            tokens = java_text.TOKENS
            p.parse()
        elif language in ("bash", "sh", "shell"):
            s = Shell(text)
            s.parse()
            return _shell_lines(s)
        else:
            return None
    except RecursionError:
        if s and s.errors:
            return _shell_lines(s)
        if not p or not p.errors:
            return None
    if not p.errors and language in ("js", "javascript"):
        return script.redeclared(text)
    if not p.errors or _exactly_valid(text, language):
        return []
    return _lines(text, k, p.errors, tokens)


def _exactly_valid(text: str, language: str) -> bool:
    """The library's word on a text that the parser refused, where there is one."""
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "text", "exec", dont_inherit=True)  # nothing is run
            return True
        if language == "json":
            json.loads(text, parse_constant=lambda _: 1 / 0)
            return True
    except (SyntaxError, ValueError, ZeroDivisionError, RecursionError, MemoryError):
        pass
    return False
