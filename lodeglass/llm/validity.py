"""Source files that don't parse, with all their errors, and the rates of acceptance per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.parsing import syntax_errors
from lodeglass.session import BROADCAST_ROWS, cut, join_small

_ERRORS = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))


#: Languages that the endings of paths stand for, by the names of files.language.
ENDINGS = {"ts": "ts", "mts": "ts", "cts": "ts", "js": "js", "mjs": "js", "cjs": "js", "py": "python", "pyi": "python", "go": "go", "java": "java", "json": "json", "sh": "bash", "bash": "bash", "css": "css"}
_SCHEMA = "file_id long, path string, language string, valid boolean, error_count int, first_line int, first_error string, errors array<struct<line:int,message:string>>"


def by_ending(path: Column) -> Column:
    """The language that a path's ending stands for, null for others."""
    known = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [syntax_errors(t.as_py(), g) if g else None for g, t in zip(batch.column(2).to_pylist(), batch.column(3))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(2),
                pa.array([None if e is None else not e for e in found], pa.bool_()), pa.array([None if e is None else len(e) for e in found], pa.int32()),
                pa.array([e[0][0] if e else None for e in found], pa.int32()), pa.array([e[0][1] if e else None for e in found], pa.string()),
                pa.array([None if e is None else [{"line": n, "message": m} for n, m in e] for e in found], _ERRORS),
            ],
            ["file_id", "path", "language", "valid", "error_count", "first_line", "first_error", "errors"],
        )


def parsed_files(files: DataFrame, contents: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """file_id, path, language, valid, error_count, first_line, first_error and errors of every content that can be read.

    Input: files (file_id, language) and contents (file_id, path, content); further columns are ignored. valid is null
    for languages without a parser (css, null) and for nesting beyond a million calls. Null contents and ids have no
    row; empty contents are judged as their language does; repeated deliveries yield one row. Contents are parsed where
    they lie, in the language that the ending of their path stands for; only files for which `files` has another one are
    joined with it, by broadcast while there are few of them.
    """
    known = files.where("file_id is not null").groupBy("file_id").agg(F.max("language").alias("language"))
    named = contents.where("file_id is not null and content is not null").select("file_id", "path", by_ending(F.col("path")).alias("ending"))
    others = cut(named.drop("path").distinct().join(known, "file_id", "left").where("not (language <=> ending)"))
    rows = contents.where("file_id is not null and content is not null").select("file_id", "path", by_ending(F.col("path")).alias("language"), "content")
    usual = rows.mapInArrow(_parse, _SCHEMA)
    usual = join_small(usual.withColumn("ending", F.coalesce("language", F.lit(""))), others.select("file_id", F.coalesce("ending", F.lit("")).alias("ending")), ["file_id", "ending"], "left_anti", max_rows=broadcast_rows).drop("ending")
    own = join_small(rows.select("file_id", "path", F.coalesce("language", F.lit("")).alias("ending"), "content"), others.select("file_id", F.coalesce("ending", F.lit("")).alias("ending"), "language"), ["file_id", "ending"], max_rows=broadcast_rows)
    return usual.unionByName(own.select("file_id", "path", "language", "content").mapInArrow(_parse, _SCHEMA)).distinct()


def acceptance(parsed: DataFrame) -> DataFrame:
    """Files, invalid files, share of invalid ones and errors per repository (first folder of the path) and language."""
    judged = parsed.where("valid is not null").select(F.substring_index("path", "/", 1).alias("repository"), "language", "valid", "error_count")
    bad = F.count_if(~F.col("valid")).cast("long")
    return judged.groupBy("repository", "language").agg(F.count("*").cast("long").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("invalid_rate"), F.sum("error_count").cast("long").alias("errors"))


def parser_disagreement(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """How often the recorded fallback flag and the parser agree, per language: language, fallback, valid, files."""
    flags = files.where("file_id is not null").groupBy("file_id").agg(F.max("parser_fallback_used").alias("fallback"))
    return parsed.where("valid is not null").join(flags, "file_id", "left").groupBy("language", "fallback", "valid").agg(F.count("*").cast("long").alias("files"))
