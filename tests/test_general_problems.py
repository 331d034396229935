import random
from datetime import datetime, timedelta

import pytest

from lodeglass.operators import snapshot_changes as S
from lodeglass.operators.orphan_references import Reference, Target, orphan_counts, orphan_references
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 1)
ENTRY = "repository_id string, snapshot_no int, taken_at timestamp_ntz, path string, content_hash string, received_at timestamp_ntz, change string"


def rows_of(seed, repos=3, paths=40, snaps=(1, 2, 4)):
    r = random.Random(seed)
    out = []
    for repo in range(repos):
        for no in snaps:
            for p in r.sample(range(paths), r.randint(0, paths)):
                for _ in range(r.choice([1, 1, 1, 2])):
                    path = r.choice([f"a/f{p}.ts", f"./a/f{p}.ts", f"a//f{p}.ts", f"a\\f{p}.ts"])
                    h = r.choice([None, f"h{r.randint(0, 2)}", f" H{r.randint(0, 2)} "])
                    out.append((f"r{repo}", no, T0, path, h, r.choice([None, T0 + timedelta(seconds=r.randint(0, 10**6))]), "x"))
    return out


def brute(rows):
    last = {}
    for repo, no, _, path, h, at, _ in rows:
        p = path.replace("\\", "/").replace("//", "/").removeprefix("./")
        key = (repo, no, p)
        value = (at is not None, at or T0, h is not None, (h or "").strip().lower())
        last[key] = max(last.get(key, value), value)
    out = set()
    for repo in {k[0] for k in last}:
        nos = sorted({k[1] for k in last if k[0] == repo})
        for a, b in zip(nos, nos[1:]):
            x, y = ({k[2]: v[2:] for k, v in last.items() if k[:2] == (repo, n)} for n in (a, b))
            out |= {(repo, b, p, "added") for p in y.keys() - x.keys()} | {(repo, b, p, "removed") for p in x.keys() - y.keys()} | {(repo, b, p, "changed") for p in x.keys() & y.keys() if x[p] != y[p]}
    return out


@pytest.mark.parametrize("kwargs", [{}, {"rows_per_bucket": 8, "cells": 4, "levels": 1}, {"rows_per_bucket": 64, "cells": 4, "levels": 3, "broadcast_rows": 0}])
def test_snapshot_changes_agree_with_brute_force(spark, kwargs):
    rows = rows_of(3)
    got = S.snapshot_changes(spark.createDataFrame(rows, ENTRY), **kwargs).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(rows)


def test_snapshot_edges(spark):
    one = [("r", 1, None, "a", "h", None, None), (None, 2, None, "a", "h", None, None), ("r", None, None, "a", "h", None, None), ("r", 2, None, None, "h", None, None)]
    assert S.snapshot_changes(spark.createDataFrame(one, ENTRY)).count() == 0
    assert S.snapshot_changes(spark.createDataFrame([], ENTRY)).count() == 0
    many = [("r", n, T0, f"p{i}", f"h{i * (n if i % 3 == 0 else 1)}", T0, None) for n in (1, 2) for i in range(3000)]
    changes = S.snapshot_changes(spark.createDataFrame(many, ENTRY), rows_per_bucket=256)
    assert changes.count() == 999 and S.change_counts(changes).first().asDict() == {"repository_id": "r", "snapshot_no": 2, "added": 0, "removed": 0, "changed": 999}


def test_peeling_needs_room():
    cells = [(0, 2, 1, 1, 1), (1, 2, 1, 1, 1)]
    assert S.peel(cells, 4, 3) is None and S.peel([], 4, 3) == []


def test_orphans(spark):
    t = lambda d: T0 + timedelta(days=d)
    child = spark.createDataFrame(
        [("A ", "1", t(5), 0), ("a", "2", t(40), 0), ("b", "3", t(5), 0), ("c", "4", None, 0), ("d", "5", t(1), 0), (None, "6", t(1), 0), ("", "7", t(1), 0), ("b", "3", t(5), 0), ("e", "8", None, 0), ("f", "9", t(3), 0)],
        "ref string, id string, at timestamp_ntz, key int",
    )
    parent = spark.createDataFrame([("A", t(10), 1), ("a", t(30), 1), ("e", t(50), 1), ("f", None, 1)], "id string, made timestamp_ntz, target int")
    gone = spark.createDataFrame([(" C",), ("a",)], "id string")
    refs = [Reference("t", "ref", child, F.col("id"), "at", "p")]
    got = orphan_references(refs, [Target("p", parent, "id", "made", gone, "id")])
    want = {("1", "2026-01", "late"), ("3", "2026-01", "missing"), ("4", "unknown", "deleted"), ("5", "2026-01", "missing"), ("7", "2026-01", "missing")}
    assert sorted((r.row_key, r.period, r.status) for r in got.collect()) == sorted(want)
    assert {(r.period, r.status, r.n) for r in orphan_counts(got).collect()} == {("2026-01", "late", 1), ("2026-01", "missing", 3), ("unknown", "deleted", 1)}
    empty = [Reference("t", "ref", child.limit(0), F.col("id"), "at", "p")]
    assert orphan_references(empty, [Target("p", parent.limit(0), "id", "made")]).count() == 0


def test_hot_key(spark):
    child = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("ref"), F.col("id").cast("string").alias("id"), F.lit(T0).cast("timestamp_ntz").alias("at"))
    parent = spark.createDataFrame([], "id string, made timestamp_ntz")
    assert orphan_references([Reference("t", "ref", child, F.col("id"), "at", "p")], [Target("p", parent, "id", "made")]).count() == 60_000
