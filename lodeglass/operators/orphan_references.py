"""References to records that don't exist, were deleted, or came later than the reference.

Parent keys, tombstones and child keys are united in long form and grouped by target and key, the children
pre-aggregated; only groups that lack a parent flag, or whose parent is younger than some child, are joined back to
their rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.session import normal_key


@dataclass(frozen=True)
class Reference:
    """A column of a child table that refers to keys of `target`. at is the time of a row, label what names it."""

    table: str
    field: str
    rows: DataFrame
    label: Column
    at: str
    target: str


@dataclass(frozen=True)
class Target:
    """Keys that exist (`rows`, with the time of creation) and keys known to be deleted (`gone`)."""

    name: str
    rows: DataFrame
    key: str
    created: str
    gone: DataFrame | None = None
    gone_key: str | None = None


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def orphan_references(references: Sequence[Reference], targets: Sequence[Target], *, salts: int = 8) -> DataFrame:
    """ref_table, ref_field, row_key, period, status of every reference that is missing, deleted or late; distinct.

    Null keys refer to nothing and are skipped; empty keys are keys. Keys compare without letter case and outer white
    space. A parent without a creation time is never late, nor is a child without a time; such a child's period is
    `unknown`. Of several parents the earliest counts. Repeated rows yield one row, empty tables none; further columns
    of the tables are not read.

    Hot keys: child rows are pre-aggregated before the shuffle on the key, and the join back is salted.
    """
    child = _union([
        r.rows.select(
            F.lit(r.table).alias("ref_table"), F.lit(r.field).alias("ref_field"), F.lit(r.target).alias("target"),
            normal_key(r.field).alias("key"), r.label.alias("row_key"), F.col(r.at).alias("at"),
        ).where(F.col("key").isNotNull())
        for r in references
    ])
    none = F.lit(None).cast("timestamp_ntz")
    tagged = [child.select("target", "key", F.lit(1).alias("child"), F.lit(0).alias("parent"), F.lit(0).alias("gone"), F.col("at").cast("timestamp_ntz").alias("at"), none.alias("created"))]
    for t in targets:
        tagged.append(t.rows.select(F.lit(t.name).alias("target"), normal_key(t.key).alias("key"), F.lit(0).alias("child"), F.lit(1).alias("parent"), F.lit(0).alias("gone"), none.alias("at"), F.col(t.created).cast("timestamp_ntz").alias("created")))
        if t.gone is not None:
            tagged.append(t.gone.select(F.lit(t.name).alias("target"), normal_key(t.gone_key).alias("key"), F.lit(0).alias("child"), F.lit(0).alias("parent"), F.lit(1).alias("gone"), none.alias("at"), none.alias("created")))
    keys = (
        _union(tagged)
        .where(F.col("key").isNotNull())
        .groupBy("target", "key")
        .agg(*(F.max(c).alias(c) for c in ("child", "parent", "gone")), F.min("at").alias("first_at"), F.min("created").alias("created"))
        .where("child = 1 and (parent = 0 or created > first_at)")
        .select("target", "key", "parent", "gone", "created", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    late = F.col("created") > F.col("at").cast("timestamp_ntz")
    return (
        child.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(salts)).cast("int"))
        .join(keys, ["target", "key", "salt"])
        .where((F.col("parent") == 0) | late)
        .select(
            "ref_table", "ref_field", "row_key",
            F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("period"),
            F.when(F.col("parent") == 1, "late").when(F.col("gone") == 1, "deleted").otherwise("missing").alias("status"),
        )
        .distinct()
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Number of distinct orphan references per table, field, period and status."""
    return orphans.groupBy("ref_table", "ref_field", "period", "status").agg(F.count("*").cast("long").alias("n"))
