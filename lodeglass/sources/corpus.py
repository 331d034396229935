"""Corpora of judged tasks: a manifest in JSON and one card a task, Markdown with front matter."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = "struct<kind:string,value:string,mode:string>"
MANIFEST = f"schemaVersion int, benchmark string, repo string, repoSha string, tokenizer string, tasks array<struct<id:string,path:string,slice:string,workflows:array<string>,allowedPaths:array<string>,targets:array<{TARGET}>>>"


def _scalar(text: str):
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t.startswith("[") and t.endswith("]"):
        return [_scalar(x) for x in t[1:-1].split(",") if x.strip()]
    return t


def front_matter(card: str) -> tuple[dict, str]:
    """Fields and body of a card. Values are text, lists in brackets or by dashes, and lists of key: value groups."""
    m = re.match(r"\A\ufeff?---\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\Z)", card)
    if not m:
        raise ValueError("a card begins with front matter between lines of three dashes")
    fields: dict = {}
    key, items = None, None
    for line in m.group(1).splitlines():
        if not line.strip():
            continue
        body = line.strip()
        if not line.startswith((" ", "\t", "-")):
            key, _, value = body.partition(":")
            items = None
            fields[key.strip()] = _scalar(value) if value.strip() else []
            key = key.strip()
        elif body.startswith("- "):
            items = fields[key]
            pair = re.match(r"([A-Za-z_]\w*):\s+(.*)$", body[2:])
            items.append({pair.group(1): _scalar(pair.group(2))} if pair else _scalar(body[2:]))
        elif items and isinstance(items[-1], dict):
            name, _, value = body.partition(":")
            items[-1][name.strip()] = _scalar(value)
    return fields, card[m.end() :]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a task: id, path of its card, slice, workflows, allowedPaths and targets."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select("repo", F.explode("tasks").alias("t")).select("repo", "t.*")


def read_cards(spark: SparkSession, folder: str) -> DataFrame:
    """path, id, slice, query, successCriteria and body of all cards below a folder; a card that can't be read has an
    error instead."""
    schema = "id string, slice string, query string, success_criteria array<string>, body string, error string"

    @F.udf(schema)
    def parse(text):
        try:
            fields, body = front_matter(text)
            missing = [k for k in ("id", "slice", "query") if not isinstance(fields.get(k), str) or not fields[k]]
            if missing:
                raise ValueError(f"missing {', '.join(missing)}")
            return fields["id"], fields["slice"], fields["query"], [str(x) for x in fields.get("successCriteria") or []], body.strip(), None
        except (ValueError, TypeError, AttributeError) as e:
            return None, None, None, None, None, str(e)

    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.regexp_replace(F.input_file_name(), r"^.*/", "").alias("file"), parse("value").alias("c")).select("file", "c.*")


def corpus_problems(manifest: DataFrame, cards: DataFrame) -> DataFrame:
    """id and problem of tasks without a card, cards without a task, and slices that differ; empty for a good corpus."""
    a = manifest.select("id", F.col("slice").alias("a"), F.lit(True).alias("task"))
    b = cards.where("error is null").select("id", F.col("slice").alias("b"), F.lit(True).alias("card"))
    joined = a.join(b, "id", "full_outer")
    problem = F.when(F.col("card").isNull(), "no card").when(F.col("task").isNull(), "no task").when(F.col("a") != F.col("b"), "another slice")
    bad = cards.where("error is not null").select(F.col("file").alias("id"), F.col("error").alias("problem"))
    return joined.select("id", problem.alias("problem")).where("problem is not null").unionByName(bad)
