"""Compact rows: results as positional arrays, for readers that pay by the token, and back again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of a symbol in their order, and when the compact form pays.
SYMBOL_FIELDS = ("id", "name", "qualifiedName", "kind", "filePath", "signature", "summary", "summarySource", "startLine", "endLine", "startByte", "endByte", "exported")
TREE_FIELDS = ("path", "language", "symbolCount")
MIN_SAVED_TOKENS, MIN_SAVED_PERCENT = 20, 25.0


def compact_row(values: dict[str, Column], fields: tuple[str, ...]) -> Column:
    """JSON array of the fields in their order; what is missing is null."""
    quoted = [F.coalesce(F.regexp_extract(F.to_json(F.struct(values[f].alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("")) if f in values else F.lit("") for f in fields]
    return F.concat(F.lit("["), F.concat_ws(",", *(F.when(q == "", "null").otherwise(q) for q in quoted)), F.lit("]"))


def expand_row(col: Column, fields: tuple[str, ...]) -> Column:
    """Map of field to text of a compact row; null if it isn't one of this length."""
    values = F.from_json(col, "array<string>")
    return F.when(F.size(values) == len(fields), F.map_from_arrays(F.array(*map(F.lit, fields)), values))


def worth_compacting(json_tokens: Column, compact_tokens: Column) -> Column:
    """Whether the compact form saves enough tokens, in number and in share."""
    saved = json_tokens - compact_tokens
    return (saved >= MIN_SAVED_TOKENS) & (100.0 * saved / F.greatest(json_tokens, F.lit(1)) >= MIN_SAVED_PERCENT)


def savings(json_tokens: Column, compact_tokens: Column) -> dict[str, Column]:
    saved = json_tokens - compact_tokens
    return {"saved_tokens": saved, "saved_percent": F.when(json_tokens == 0, F.lit(0.0)).otherwise(F.round(100.0 * saved / json_tokens, 6)), "compact": worth_compacting(json_tokens, compact_tokens)}


# Codes of errors, by what their messages hold.
ERROR_CODES = {"tool_not_found": ("unknown tool",), "invalid_argument": ("invalid", "unsupported", "missing required argument", "must be", "requires", "expected")}


def error_code(message: Column | str) -> Column:
    """A stable code for an error message."""
    text = F.lower(F.col(message) if isinstance(message, str) else message)
    out = F.lit("internal_error")
    for code, signs in reversed(ERROR_CODES.items()):
        for sign in signs:
            out = F.when(text.contains(sign), code).otherwise(out)
    return out
