"""Checks of options before a plan is built."""

from __future__ import annotations

from lodeglass.schema import SYMBOL_KINDS, TASK_INTENTS
from lodeglass.functions.languages import EXTENSIONS


def query_text(query: str | None) -> str:
    if query is None or not query.strip():
        raise ValueError("the query must not be blank")
    return query


def positive_limit(limit: int | None) -> int | None:
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        raise ValueError("limit must be a positive integer")
    return limit


def context_lines(lines: int) -> int:
    if lines < 0:
        raise ValueError("context lines must not be negative")
    return int(lines)


def kind_and_language(kind: str | None, language: str | None) -> None:
    if kind is not None and kind not in SYMBOL_KINDS:
        raise ValueError(f"unknown kind {kind}")
    if language is not None and language not in EXTENSIONS:
        raise ValueError(f"unknown language {language}")


def relation_depth(depth: int | None, strict: bool = False) -> int:
    """Clamped to 1..3; strict refuses what is outside."""
    if depth is None:
        return 1
    if strict and not 1 <= depth <= 3:
        raise ValueError("relation depth must be 1, 2 or 3")
    return min(3, max(1, int(depth)))


def seeds(query: str | None, symbol_ids) -> tuple[str | None, tuple[str, ...]]:
    """A query that says something, or ids that do; ids in order, each once."""
    ids = tuple(dict.fromkeys(i.strip() for i in symbol_ids or () if i and i.strip()))
    text = query.strip() if query and query.strip() else None
    if text is None and not ids:
        raise ValueError("a query or a symbol id is needed")
    return text, ids


def intent(value: str | None) -> str | None:
    if value is not None and value not in TASK_INTENTS:
        raise ValueError(f"unknown intent {value}")
    return value
