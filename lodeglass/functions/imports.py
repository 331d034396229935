"""Import statements and clauses as arrays of specifiers, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.schema import SPECIFIER

_FROM = r"""(?m)^[ \t]*(?:import|export)\s+(?:type\s+)?((?:[\w$*,\s]|\{[^}]*\})*?)\s*from\s*["']([^"'\n]+)["']"""
_BARE = r"""(?m)^[ \t]*import\s*["']([^"'\n]+)["']"""


def _specifier(kind: str, imported: Column, local: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), imported.cast("string").alias("importedName"), local.cast("string").alias("localName"))


def clause_specifiers(clause: Column | str) -> Column:
    """Specifiers of an import clause, as `a, {b as c, type d}` or `* as e`: the default first, then named ones, then a
    namespace. Null and empty clauses have none."""
    c = F.regexp_replace(F.trim(F.coalesce(F.col(clause) if isinstance(clause, str) else clause, F.lit(""))), r"^type\s+", "")
    none = F.array().cast(f"array<{SPECIFIER}>")
    inside = F.regexp_extract(c, r"(?s)\{(.*)\}", 1)
    entries = F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^type ", ""))), lambda x: x != "")
    named = F.transform(entries, lambda x: F.when(x.rlike(r"^.+? as .+$"), _specifier("named", F.regexp_extract(x, r"^(.+?) as (.+)$", 1), F.regexp_extract(x, r"^(.+?) as (.+)$", 2))).otherwise(_specifier("named", x, x)))
    space = F.regexp_extract(c, r"\*\s+as\s+([A-Za-z_$][\w$]*)", 1)
    first = F.trim(F.regexp_replace(F.trim(F.get(F.split(c, ","), 0)), r"^type\s+", ""))
    default = (first != "") & ~first.startswith("{") & ~first.startswith("*")
    return F.concat(
        F.when(default, F.array(_specifier("default", F.lit("default"), first))).otherwise(none),
        F.when(F.size(entries) > 0, named).otherwise(none),
        F.when(space != "", F.array(_specifier("namespace", F.lit("*"), space))).otherwise(none),
    )


def extract_imports(contents: DataFrame) -> DataFrame:
    """file_id, source and specifiers of the import and re-export statements of each content, one row a source and
    clause; read with patterns in the JVM, so statements inside strings or comments that begin a line count too."""
    found = F.transform(
        F.filter(F.regexp_extract_all("content", F.lit(_FROM), F.lit(0)), lambda x: x != ""),
        lambda x: F.struct(F.regexp_extract(x, _FROM, 2).alias("source"), F.regexp_replace(F.regexp_extract(x, _FROM, 1), r"^type\s+", "").alias("clause")),
    )
    bare = F.transform(F.regexp_extract_all("content", F.lit(_BARE), F.lit(1)), lambda x: F.struct(x.alias("source"), F.lit("").alias("clause")))
    rows = contents.where("file_id is not null and content is not null").select("file_id", F.explode(F.concat(found, bare)).alias("i"))
    return rows.select("file_id", F.col("i.source").alias("source"), clause_specifiers(F.col("i.clause")).alias("specifiers")).distinct()


def parse_specifiers(col: Column | str) -> Column:
    """Specifiers stored as JSON; plain strings are named ones, entries without an imported name are dropped, bad JSON
    has none."""
    c = F.col(col) if isinstance(col, str) else col
    none = F.array().cast(f"array<{SPECIFIER}>")
    objects = F.from_json(c, f"array<{SPECIFIER}>")
    strings = F.from_json(c, "array<string>")
    plain = F.transform(F.filter(strings, lambda x: x.isNotNull() & ~x.startswith("{")), lambda x: _specifier("unknown", x, x))
    good = F.filter(objects, lambda s: s.isNotNull() & s["importedName"].isNotNull())
    known = F.transform(good, lambda s: F.struct(F.when(s["kind"].isin("named", "default", "namespace", "unknown"), s["kind"]).otherwise("unknown").alias("kind"), s["importedName"].alias("importedName"), s["localName"].alias("localName")))
    return F.when(F.coalesce(F.size(good), F.lit(0)) > 0, known).when(F.coalesce(F.size(plain), F.lit(0)) > 0, plain).otherwise(none)
