"""Queries p3 and p6 over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.operators.orphan_references import Reference, Target, orphan_counts, orphan_references
from lodeglass.operators.snapshot_changes import change_counts, snapshot_changes
from lodeglass.session import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(table(spark, root, "snapshot_entries"))


def p3_counts(spark: SparkSession, root: str) -> DataFrame:
    return change_counts(p3_found(spark, root))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    mappings, files = table(spark, root, "checkout_path_mappings"), table(spark, root, "files")
    artifacts, evicted = table(spark, root, "analysis_artifacts"), table(spark, root, "evicted_artifacts")
    mapping_key = F.concat_ws("|", F.coalesce("checkout_id", F.lit("")), F.coalesce("relative_path", F.lit("")))
    return orphan_references(
        [
            Reference("checkout_path_mappings", "artifact_key", mappings, mapping_key, "observed_at", "artifact"),
            Reference("checkout_path_mappings", "checkout_id", mappings, mapping_key, "observed_at", "checkout"),
            Reference("files", "content_hash", files, F.col("file_id").cast("string"), "updated_at", "content"),
        ],
        [
            Target("artifact", artifacts, "artifact_key", "created_at", evicted, "artifact_key"),
            Target("checkout", table(spark, root, "checkouts"), "checkout_id", "created_at", table(spark, root, "removed_checkouts"), "checkout_id"),
            Target("content", artifacts, "content_hash", "created_at", evicted, "content_hash"),
        ],
    )


def p6_counts(spark: SparkSession, root: str) -> DataFrame:
    return orphan_counts(p6_found(spark, root))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_counts": p3_counts, "p6_found": p6_found, "p6_counts": p6_counts}


_P3 = r"""
WITH n AS (
  SELECT repository_id, snapshot_no, received_at, lower(regexp_replace(content_hash, '^\s+|\s+$', '', 'g')) AS h,
         regexp_replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '(/\.)+/', '/', 'g'), '^(\./|/)+', '') AS p
  FROM snapshot_entries),
u AS (SELECT repository_id, snapshot_no, p, h FROM n
      QUALIFY row_number() OVER (PARTITION BY repository_id, snapshot_no, p ORDER BY received_at DESC NULLS LAST, h DESC NULLS LAST) = 1),
o AS (SELECT repository_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repository_id ORDER BY snapshot_no) AS prev
      FROM (SELECT DISTINCT repository_id, snapshot_no FROM u)),
a AS (SELECT u.*, o.prev FROM u JOIN o USING (repository_id, snapshot_no)),
b AS (SELECT u.repository_id, o.snapshot_no, u.p, u.h FROM u JOIN o ON u.repository_id = o.repository_id AND u.snapshot_no = o.prev),
d AS (
  SELECT coalesce(a.repository_id, b.repository_id) AS repository_id, coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no,
         coalesce(a.p, b.p) AS path,
         CASE WHEN b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'removed' WHEN a.h IS DISTINCT FROM b.h THEN 'changed' END AS change
  FROM (SELECT * FROM a WHERE prev IS NOT NULL) a
  FULL JOIN b ON a.repository_id = b.repository_id AND a.snapshot_no = b.snapshot_no AND a.p = b.p)
"""
_P6 = r"""
WITH c AS (
  SELECT 'checkout_path_mappings' AS ref_table, 'artifact_key' AS ref_field, 'artifact' AS target, artifact_key AS k,
         coalesce(checkout_id, '') || '|' || coalesce(relative_path, '') AS row_key, observed_at AS t FROM checkout_path_mappings
  UNION ALL SELECT 'checkout_path_mappings', 'checkout_id', 'checkout', checkout_id,
         coalesce(checkout_id, '') || '|' || coalesce(relative_path, ''), observed_at FROM checkout_path_mappings
  UNION ALL SELECT 'files', 'content_hash', 'content', content_hash, CAST(file_id AS VARCHAR), updated_at FROM files),
p AS (
  SELECT 'artifact' AS target, artifact_key AS k, created_at FROM analysis_artifacts
  UNION ALL SELECT 'content', content_hash, created_at FROM analysis_artifacts
  UNION ALL SELECT 'checkout', checkout_id, created_at FROM checkouts),
g AS (
  SELECT 'artifact' AS target, artifact_key AS k FROM evicted_artifacts
  UNION ALL SELECT 'content', content_hash FROM evicted_artifacts
  UNION ALL SELECT 'checkout', checkout_id FROM removed_checkouts),
pk AS (SELECT target, lower(regexp_replace(k, '^\s+|\s+$', '', 'g')) AS k, min(created_at) AS created FROM p GROUP BY ALL),
gk AS (SELECT DISTINCT target, lower(regexp_replace(k, '^\s+|\s+$', '', 'g')) AS k, true AS gone FROM g),
s AS (
  SELECT DISTINCT ref_table, ref_field, row_key, coalesce(strftime(t, '%Y-%m'), 'unknown') AS period,
         CASE WHEN pk.k IS NOT NULL THEN CASE WHEN created > t THEN 'late' END WHEN gone THEN 'deleted' ELSE 'missing' END AS status
  FROM c LEFT JOIN pk ON c.target = pk.target AND lower(regexp_replace(c.k, '^\s+|\s+$', '', 'g')) = pk.k
         LEFT JOIN gk ON c.target = gk.target AND lower(regexp_replace(c.k, '^\s+|\s+$', '', 'g')) = gk.k
  WHERE c.k IS NOT NULL)
"""


def oracle_sql() -> dict:
    counts = ", ".join(f"CAST(count(*) FILTER (change = '{k}') AS BIGINT) AS {k}" for k in ("added", "removed", "changed"))
    return {
        "p3_found": _P3 + "SELECT * FROM d WHERE change IS NOT NULL",
        "p3_counts": _P3 + f"SELECT repository_id, snapshot_no, {counts} FROM d WHERE change IS NOT NULL GROUP BY 1, 2",
        "p6_found": _P6 + "SELECT * FROM s WHERE status IS NOT NULL",
        "p6_counts": _P6 + "SELECT ref_table, ref_field, period, status, count(*) AS n FROM s WHERE status IS NOT NULL GROUP BY 1, 2, 3, 4",
    }
