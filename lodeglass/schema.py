"""Tables of the index, enumerations, limits and ranking configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

FILES = "file_id bigint, path string, language string, content_hash string, integrity_hash string, size_bytes bigint, mtime_ms bigint, symbol_signature_hash string, import_hash string, parser_backend string, parser_fallback_used boolean, parser_fallback_reason string, symbol_count int, updated_at timestamp"
CONTENT = "file_id bigint, path string, content string"
SYMBOLS = "id string, file_id bigint, file_path string, name string, qualified_name string, kind string, signature string, summary string, summary_source string, start_line int, end_line int, start_byte int, end_byte int, exported boolean"
SPECIFIER = "struct<kind:string,importedName:string,localName:string>"
IMPORTS = f"file_id bigint, source string, specifiers array<{SPECIFIER}>"
DEPENDENCIES = "importer_file_id bigint, importer_path string, target_path string, source string"
EVENTS = "id string, ts timestamp, repoRoot string, source string, event string, level string, correlationId string, data map<string,string>"
CHECKOUTS = "checkout_id string, canonical_root string, git_mode string, repository_id string, head_oid string, branch_ref string, worktree_path string, git_diagnostic string, created_at timestamp, updated_at timestamp"
MAPPINGS = "checkout_id string, relative_path string, artifact_key string, observed_content_hash string, observed_size_bytes bigint, observed_mtime_ms bigint, observed_at timestamp"
CHECKOUT_DEPENDENCIES = "checkout_id string, importer_path string, target_path string, source string"

# Enumerations.
SYMBOL_KINDS = ("function", "class", "method", "constant", "type")
SUMMARY_SOURCES = ("doc-comment", "signature")
SPECIFIER_KINDS = ("named", "default", "namespace", "unknown")
TASK_INTENTS = ("explore", "debug", "refactor", "audit")
SUPPORT_TIERS = ("discovery", "structured", "graph")
STALE_STATUSES = ("fresh", "stale", "unknown")
OPERATIONS = ("discovery", "exact_source", "ranked_context", "dependency_graph")


@dataclass(frozen=True)
class Limits:
    """The default caps of an index and its queries."""

    files_discovered: int = 100_000
    file_bytes: int = 250_000
    symbols_per_file: int = 2_000
    symbol_results: int = 8
    text_results: int = 100
    live_results: int = 100
    live_output_bytes: int = 1_000_000
    symbol_candidates: int = 400
    text_candidates: int = 200
    relation_depth: int = 3
    token_budget: int = 1_200
    least_payload_budget: int = 128
    debounce_ms: int = 100
    retention_days: int = 3


@dataclass(frozen=True)
class RankingWeights:
    """What each kind of match adds to a symbol's score."""

    exact_name: int = 1000
    exact_qualified_name: int = 900
    prefix_name: int = 700
    prefix_qualified_name: int = 650
    contains_name: int = 500
    contains_qualified_name: int = 450
    signature_contains: int = 250
    summary_contains: int = 200
    file_path_contains: int = 120
    exact_word: int = 180
    token_match: int = 70
    exported_bonus: int = 20


@dataclass(frozen=True)
class PathPresets:
    """Globs per kind of code; a query with a term of a kind favours files its globs match."""

    generation_code: tuple[str, ...] = ()
    app_code: tuple[str, ...] = ()
    shared_runtime: tuple[str, ...] = ()


@dataclass(frozen=True)
class EngineConfig:
    limits: Limits = field(default_factory=Limits)
    weights: RankingWeights = field(default_factory=RankingWeights)
    presets: PathPresets = field(default_factory=PathPresets)
    collation: str | None = "UNICODE"
