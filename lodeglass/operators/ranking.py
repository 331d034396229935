"""Weighted scores of symbols and files for a query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions.text import basename, contains_word, normalize_query, path_matches, query_terms, query_tokens
from lodeglass.schema import PathPresets, RankingWeights

# Words that mean an intent, evidence for it, and what it adds.
GENERATION_TERMS = ("generated", "generate", "generation")
PRESET_TERMS = {
    "generation_code": ("generated", "generate", "generation", "generator", "codegen", "scaffold", "template", "emit"),
    "app_code": ("app", "application", "ui", "page", "screen", "route"),
    "shared_runtime": ("runtime", "shared", "core", "platform", "infrastructure"),
}
GENERATOR_EVIDENCE = r"(?i)(?:generate|generator|codegen|scaffold|template|emit)"
GENERATOR_PATH = r"(?i)(?:^|/)(?:tools?|scripts?|cli|generators?|codegen)(?:/|$)"
TEST_PATH = r"(?i)(?:^|/)(?:tests?|__tests__|spec)(?:/|$)|\.(?:test|spec)\.[^/]+$"
GENERATOR_BONUS, GENERATOR_PATH_BONUS, TEST_PATH_MALUS, PRESET_BONUS = 360, 120, -80, 90
FILE_SCORES = {"exact_name": 500, "exact_path": 450, "in_name": 300, "in_path": 200, "pattern": 1}


def has_intent(query: str) -> bool:
    """Whether a query has a word that means an intent; the full-text index is then not asked."""
    tokens = set(query_tokens(query))
    return any(tokens & set(terms) for terms in (GENERATION_TERMS, *PRESET_TERMS.values()))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def row_text() -> Column:
    """What a symbol's tokens are looked for in."""
    return F.lower(F.concat_ws(" ", *(_text(c) for c in ("name", "qualified_name", "signature", "summary", "summary_source", "file_path", "kind"))))


def _points(condition: Column, n: int) -> Column:
    return F.when(condition, F.lit(n)).otherwise(F.lit(0))


def symbol_score(query: str, weights: RankingWeights = RankingWeights(), presets: PathPresets = PathPresets()) -> Column:
    """Sum of the weights of all kinds of match; 0 for a blank query."""
    q = normalize_query(query)
    if not q:
        return F.lit(0)
    name, qualified, signature, summary, path = (F.lower(_text(c)) for c in ("name", "qualified_name", "signature", "summary", "file_path"))
    text, tokens = row_text(), query_tokens(query)
    parts = [
        _points(name == q, weights.exact_name), _points(qualified == q, weights.exact_qualified_name),
        _points(name.startswith(q), weights.prefix_name), _points(qualified.startswith(q), weights.prefix_qualified_name),
        _points(name.contains(q), weights.contains_name), _points(qualified.contains(q), weights.contains_qualified_name),
        _points(signature.contains(q), weights.signature_contains), _points(summary.contains(q), weights.summary_contains), _points(path.contains(q), weights.file_path_contains),
        _points(contains_word(text, q), weights.exact_word), *(_points(text.contains(t), weights.token_match) for t in tokens),
    ]
    if set(tokens) & set(GENERATION_TERMS):
        evidence = F.concat_ws(" ", _text("name"), _text("qualified_name"), _text("file_path"))
        parts += [_points(evidence.rlike(GENERATOR_EVIDENCE), GENERATOR_BONUS), _points(_text("file_path").rlike(GENERATOR_PATH), GENERATOR_PATH_BONUS), _points(_text("file_path").rlike(TEST_PATH), TEST_PATH_MALUS)]
    liked = [path_matches("file_path", globs) for kind, terms in PRESET_TERMS.items() if (globs := getattr(presets, kind)) and set(tokens) & set(terms)]
    if liked:
        parts.append(_points(reduce(lambda a, b: a | b, liked), PRESET_BONUS))
    total = reduce(lambda a, b: a + b, parts)
    return F.when((total > 0) & F.coalesce(F.col("exported"), F.lit(False)), total + weights.exported_bonus).otherwise(total)


def matches_any_column(query: str) -> Column:
    """Whether any term stands in name, qualified name, signature, summary or path; % and _ in terms are wildcards."""
    tests = [F.lower(_text(c)).like(f"%{t}%") for t in query_terms(query) for c in ("name", "qualified_name", "signature", "summary", "file_path")]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def match_reason(query: str) -> Column:
    q = normalize_query(query)
    return F.when((F.trim(F.lower("name")) == q) | (F.trim(F.lower(_text("qualified_name"))) == q), "exact_symbol_match").otherwise("query_match")


def file_score(path: Column, query: str | None) -> Column:
    """struct(score, reason) of a file for a query; score 0: no match."""
    pick = lambda n, why: F.struct(F.lit(FILE_SCORES[n]).alias("score"), F.lit(why).alias("reason"))
    if not query:
        return pick("pattern", "pattern")
    q, full = query.lower(), F.lower(path)
    name = basename(full)
    return (
        F.when(name == q, pick("exact_name", "name")).when(full == q, pick("exact_path", "path")).when(name.contains(q), pick("in_name", "name")).when(full.contains(q), pick("in_path", "path"))
        .otherwise(F.struct(F.lit(0).alias("score"), F.lit("path").alias("reason")))
    )


def locale_order(col: str, collation: str | None) -> Column:
    """A column as the sort key of a collation; binary without one."""
    return F.collate(F.col(col), collation) if collation else F.col(col)


def symbol_order(collation: str | None = None) -> list[Column]:
    """BM25, then score, exported ones first, path, line, name, id."""
    return [F.col("bm25_score").asc_nulls_last(), F.col("score").desc(), F.col("exported").desc(), locale_order("file_path", collation).asc(), F.col("start_line").asc(), locale_order("name", collation).asc(), F.col("id").asc()]
