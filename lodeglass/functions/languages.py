"""Languages by extension, what is supported for them, and summaries of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions.text import extension

# Extensions of the languages, and how files of no language are summarised.
EXTENSIONS = {
    "ts": (".ts",), "tsx": (".tsx",), "js": (".js", ".cjs", ".mjs"), "jsx": (".jsx",), "python": (".py", ".pyi"), "bash": (".sh", ".bash", ".zsh"), "powershell": (".ps1", ".psm1", ".psd1"),
    "csharp": (".cs",), "java": (".java",), "go": (".go",), "rust": (".rs",), "json": (".json",), "html": (".html", ".htm"), "css": (".css",), "c": (".c", ".h"),
    "cpp": (".cc", ".cpp", ".cxx", ".hh", ".hpp", ".hxx"), "php": (".php",), "ruby": (".rb", ".rake", ".gemspec"), "template": (".erb", ".ejs"), "scala": (".scala", ".sc"),
}
GRAPH_LANGUAGES = ("ts", "tsx", "js", "jsx")
FALLBACK_SUMMARIES = {".md": "markdown-headings", ".mdx": "markdown-headings", ".yaml": "yaml-top-level-keys", ".yml": "yaml-top-level-keys", ".sql": "sql-schema-objects", ".txt": "text-lines"}


def language_by_extension(registry: dict[str, tuple[str, ...]] = EXTENSIONS) -> dict[str, str]:
    """Language of each extension; a ValueError if two claim one."""
    out: dict[str, str] = {}
    for language, extensions in registry.items():
        for e in map(str.lower, extensions):
            if out.setdefault(e, language) != language:
                raise ValueError(f"{e} belongs to {out[e]} and {language}")
    return out


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def language_of(path: Column | str) -> Column:
    """Language of a path's extension, null for none."""
    return _lookup(language_by_extension(), extension(path))


def support_tier(path: Column | str) -> Column:
    """The highest tier that a path's language has."""
    language = language_of(path)
    return F.when(language.isin(*GRAPH_LANGUAGES), "graph").when(language.isNotNull(), "structured").otherwise("discovery")


def support_reason(path: Column | str) -> Column:
    return F.when(language_of(path).isNotNull(), "supported-language").when(extension(path).isin(*FALLBACK_SUMMARIES), "fallback-extension").otherwise("generic-discovery")


def _counted(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + one), F.when(n == 1, "").otherwise("s"))


def discovery_summary(path: Column, content: Column) -> dict[str, Column]:
    """summary_source, summary and hints of files that have no symbols, by their extension."""
    source = F.coalesce(_lookup(FALLBACK_SUMMARIES, extension(path)), F.lit("text-lines"))
    lines = F.split(content, "\r?\n")
    full = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    headings = F.transform(F.slice(F.filter(full, lambda x: x.rlike(r"^#{1,6}\s+")), 1, 3), lambda x: F.regexp_replace(x, r"^#{1,6}\s+", ""))
    keys = F.slice(F.transform(F.filter(lines, lambda x: x.rlike(r"^[A-Za-z0-9_-]+:\s*")), lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_-]+):", 1)), 1, 5)
    objects = F.slice(F.transform(F.regexp_extract_all(content, F.lit(r'(?i)\b(?:create|alter)\s+(?:table|view|function|index)\s+([A-Za-z0-9_."]+)'), F.lit(1)), lambda x: F.regexp_replace(x, '"', "")), 1, 5)
    first = F.slice(full, 1, 3)
    return {
        "summary_source": source,
        "summary": F.when(source == "markdown-headings", F.concat(F.lit("Markdown file with "), _counted(F.size(headings), "heading")))
        .when(source == "yaml-top-level-keys", F.concat(F.lit("YAML file with "), _counted(F.size(keys), "top-level key")))
        .when(source == "sql-schema-objects", F.concat(F.lit("SQL file with "), _counted(F.size(objects), "schema object reference")))
        .otherwise(F.concat(F.lit("Discovery-only file with "), _counted(F.size(full), "non-empty line"))),
        "hints": F.when(source == "markdown-headings", F.when(F.size(headings) > 0, headings).otherwise(first))
        .when(source == "yaml-top-level-keys", keys)
        .when(source == "sql-schema-objects", objects)
        .otherwise(F.transform(first, lambda x: F.substring(x, 1, 120))),
    }
