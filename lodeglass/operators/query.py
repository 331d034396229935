"""One way in for readers of code: discover symbols, lines and what they lead to, or fetch exact sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.functions import validation
from lodeglass.operators.graph import CodeIndex, discover
from lodeglass.operators.outline import file_content, missing_ids, symbol_sources
from lodeglass.operators.search import search_live, search_symbols, search_text
from lodeglass.schema import EngineConfig

#: What a query may be for.
INTENTS = ("discover", "source", "auto")


@dataclass(frozen=True)
class Discovery:
    """symbols: the best symbols with rank; text: lines, None unless asked for; related: the symbols within some hops,
    None where only text is answered."""

    symbols: DataFrame | None
    text: DataFrame | None
    related: DataFrame | None


@dataclass(frozen=True)
class Sources:
    """content: a file's; symbols: the sources of symbols; None for what wasn't asked for."""

    content: DataFrame | None
    symbols: DataFrame | None


def query_intent(intent: str | None, *, file_path: str | None = None, symbol_ids: Sequence[str] = ()) -> str:
    """source if a file or symbols are named, discover if not, unless the intent is said."""
    if intent not in (None, *INTENTS):
        raise ValueError(f"unknown intent {intent}")
    if intent in (None, "auto"):
        return "source" if file_path or symbol_ids else "discover"
    return intent


def search_text_or_live(contents: DataFrame, query: str, *, status: str | None, live: DataFrame | None = None, file_pattern: str | None = None, limit: int | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Lines that hold a query: of the index while its stored status is fresh, else of the files as they lie on disk
    (live: path, content). Columns are file_path, line, preview, source and reason, the last two null for the index."""
    from lodeglass.functions.text import path_matches

    if status == "fresh" or live is None:
        found = search_text(contents, query, file_pattern=file_pattern, limit=limit, config=config)
        return found.select("*", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("reason"))
    validation.query_text(query)
    validation.positive_limit(limit)
    n = min(limit or config.limits.live_results, config.limits.live_results, config.limits.text_results)
    lines = live.where(path_matches("path", [file_pattern])) if file_pattern else live
    return search_live(lines, query, limit=n, output_bytes=config.limits.live_output_bytes)


def required_sources(index: CodeIndex, ids: Sequence[str], *, context: int = 0, verify: bool = False) -> DataFrame:
    """The sources of some symbols; LookupError if an id has no symbol. The ids are the reader's, and few."""
    missing = [r.id for r in missing_ids(index.symbols, ids).orderBy("id").collect()]
    if missing:
        raise LookupError(f"no symbol has the id {', '.join(missing)}")
    return symbol_sources(index.symbols, index.files, index.contents, ids=ids, context=context, verify=verify)


def required_content(index: CodeIndex, path: str) -> DataFrame:
    """The content of one file; LookupError if there is none of that path."""
    found = file_content(index.contents, path)
    if found.isEmpty():
        raise LookupError(f"no file has the path {path}")
    return found


def query_code(
    index: CodeIndex, *, intent: str | None = None, query: str | None = None, symbol_ids: Sequence[str] = (), file_path: str | None = None, kind: str | None = None, language: str | None = None, file_pattern: str | None = None, limit: int | None = None,
    context: int = 0, verify: bool = False, text: bool = False, dependencies: bool = False, importers: bool = False, references: bool = False, depth: int | None = 1, status: str | None = "fresh", live: DataFrame | None = None, config: EngineConfig = EngineConfig(),
) -> Discovery | Sources:
    """Discover by a query or fetch by path and ids, as the intent says.

    An index that isn't fresh (status) doesn't answer queries that ask for text: they get lines of the files on disk
    (live) alone. Relations are followed from the symbols found, at most three hops.
    """
    what = query_intent(intent, file_path=file_path, symbol_ids=symbol_ids)
    if what == "source":
        if not file_path and not symbol_ids:
            raise ValueError("a path or a symbol is needed")
        content = required_content(index, file_path) if file_path else None
        return Sources(content, required_sources(index, tuple(dict.fromkeys(symbol_ids)), context=context, verify=verify) if symbol_ids else None)
    validation.query_text(query)
    depth = validation.relation_depth(depth, strict=True)
    if text and status != "fresh" and live is not None:
        return Discovery(None, search_text_or_live(index.contents, query, status=status, live=live, file_pattern=file_pattern, config=config), None)
    found = search_symbols(index.symbols, query, limit=limit, config=config, files=index.files, kind=kind, language=language, file_pattern=file_pattern)
    lines = search_text_or_live(index.contents, query, status="fresh", file_pattern=file_pattern, config=config) if text else None
    seeds = found.select("id", F.array(F.lit("0"), F.lpad(F.col("rank").cast("string"), 9, "0")).alias("order"), "reason")
    return Discovery(found, lines, discover(index, seeds, depth=depth, dependencies=dependencies, importers=importers, references=references))
