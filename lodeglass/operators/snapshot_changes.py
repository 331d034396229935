"""What changed between consecutive full snapshots, by subtraction of invertible Bloom lookup tables.

Every snapshot of a repository is hashed into buckets. A bucket of a snapshot is summed into a small table of cells;
the tables of two consecutive snapshots subtract, rows in both cancel, and the few that differ are peeled out of the
cells. Buckets with more differences than their table holds are tried again with a table four times as large, and what
fails at the last level is compared row by row. A digest of each bucket proves that the peeled rows explain the whole
difference.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.session import cut, join_small, outer_trim

_M64 = (1 << 64) - 1
#: Seeds of the cell positions, of the cell check and of the bucket digest.
_CHECK, _DIGEST = 7_001, 7_002
_GROUP = ["repository_id", "bucket", "prev_no", "snapshot_no"]


def normal_path(col: str) -> F.Column:
    """Relative path with single / and without leading ./"""
    raw = F.col(col)
    p = F.regexp_replace(F.regexp_replace(raw, r"\\", "/"), r"/+", "/")
    clean = F.regexp_replace(F.regexp_replace(p, r"(?<=/)(\./)+", ""), r"^(\./|/)+", "")
    odd = raw.contains("\\") | raw.contains("//") | raw.contains("/./") | raw.startswith("./") | raw.startswith("/")
    return F.when(odd, clean).otherwise(raw)


def _deliveries(entries: DataFrame) -> DataFrame:
    """Deliveries with normalised paths; those without repository, number or path name no entry and are left out."""
    return entries.select(
        "repository_id",
        F.col("snapshot_no").cast("int").alias("snapshot_no"),
        normal_path("path").alias("path"),
        F.struct(F.col("received_at").alias("at"), F.lower(outer_trim("content_hash")).alias("hash")).alias("last"),
    ).where("repository_id is not null and snapshot_no is not null and path is not null")


def _u(x: int) -> bytes:
    return struct.pack("<Q", x & _M64)


def _hash2(key: int, value: int, third: int) -> int:
    """Spark's xxhash64 of three long columns (its seed is 42, each column's hash seeds the next)."""
    h = xxhash.xxh64_intdigest(_u(key), 42)
    return xxhash.xxh64_intdigest(_u(third), xxhash.xxh64_intdigest(_u(value), h))


def peel(cells: list[tuple[int, int, int, int, int]], m: int, hashes: int) -> list[tuple[int, int, int]] | None:
    """(key, value, sign) of all rows in a subtracted table, or None if it can't be resolved or the digest differs."""
    table: dict[int, list[int]] = {}
    total, digest = 0, 0
    for pos, n, k, v, c in cells:
        if pos < 0:
            total, digest = n, c & _M64
        else:
            table[pos] = [n, k & _M64, v & _M64, c & _M64]
    found: list[tuple[int, int, int]] = []
    todo = list(table)
    while todo:
        cell = table.get(todo.pop())
        if cell is None or cell[0] not in (1, -1):
            continue
        n, k, v, c = cell
        if _hash2(k, v, _CHECK) != c:
            continue
        found.append((k, v, n))
        for j in range(hashes):
            h = _hash2(k, v, j)
            pos = j * m + (h - (1 << 64) if h >> 63 else h) % m
            t = table.setdefault(pos, [0, 0, 0, 0])
            t[0] -= n
            t[1] ^= k
            t[2] ^= v
            t[3] ^= c
            todo.append(pos)
        if len(found) > 2 * hashes * m:
            return None
    if any(any(t) for t in table.values()):
        return None
    for k, v, n in found:
        total -= n
        digest ^= _hash2(k, v, _DIGEST)
    return found if total == 0 and digest == 0 else None


def _peel_batches(m: int, hashes: int):
    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for row in batch.to_pylist():
                found = peel([(c["pos"], c["n"], c["k"], c["v"], c["c"]) for c in row["cells"]], m, hashes)
                for k, v, n in [(0, 0, 0)] if found is None else found:
                    for col, x in zip(out, (*(row[g] for g in _GROUP), found is not None, signed(k), signed(v), n)):
                        col.append(x)
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [*_GROUP, "ok", "kh", "vh", "sign"])

    return run


def _peeled(signed_rows: DataFrame, m: int, hashes: int) -> DataFrame:
    """Tables of m cells a hash function for every bucket and pair of snapshots, subtracted and peeled."""
    n = lambda x: F.lit(x).cast("long")
    cell = lambda pos, third: F.struct(pos.cast("int").alias("pos"), F.xxhash64("kh", "vh", n(third)).alias("c"))
    cells = [F.struct((F.lit(j * m) + F.pmod(F.xxhash64("kh", "vh", n(j)), n(m))).cast("int").alias("pos"), F.xxhash64("kh", "vh", n(_CHECK)).alias("c")) for j in range(hashes)]
    summed = (
        signed_rows.select(*_GROUP, "kh", "vh", "sign", F.explode(F.array(*cells, cell(F.lit(-1), _DIGEST))).alias("cell"))
        .groupBy(*_GROUP, F.col("cell.pos").alias("pos"))
        .agg(F.sum("sign").cast("int").alias("n"), F.bit_xor("kh").alias("k"), F.bit_xor("vh").alias("v"), F.bit_xor("cell.c").alias("c"))
        .where("n != 0 or k != 0 or v != 0 or c != 0")
        .groupBy(*_GROUP)
        .agg(F.collect_list(F.struct("pos", "n", "k", "v", "c")).alias("cells"))
    )
    schema = "repository_id string, bucket long, prev_no int, snapshot_no int, ok boolean, kh long, vh long, sign int"
    return summed.mapInArrow(_peel_batches(m, hashes), schema)


def snapshot_changes(entries: DataFrame, *, rows_per_bucket: int = 2048, cells: int = 512, hashes: int = 3, levels: int = 4, broadcast_rows: int = 50_000) -> DataFrame:
    """Added, removed and changed paths of every snapshot against the one before it.

    Input: repository_id, snapshot_no, path, content_hash, received_at; further columns are ignored. Output:
    repository_id, snapshot_no (the later one), path (normalised), change. Null hashes equal null only. The first
    snapshot of a repository yields no rows, nor do empty tables. Repeated rows count once.

    Within a snapshot the row received last counts; a null received_at is earliest, ties go to the greater hash. Rows
    without repository, number or path name no entry and are left out.

    Rows are shuffled on (repository, bucket) once and kept there, in memory or on disk, until the changes are stored in
    the shared folder; what a lost executor held is read again. A repository of any size is spread over as many buckets as its largest snapshot
    needs. Groups gathered in one place are the non-zero cells of a bucket, (hashes * cells * 4^level) at most.
    """
    spark = entries.sparkSession
    raw = _deliveries(entries)
    counts = raw.groupBy("repository_id", "snapshot_no").agg(F.count("*").alias("n"))
    by_no = Window.partitionBy("repository_id").orderBy("snapshot_no")
    order = cut(
        counts.select(
            "repository_id", "snapshot_no",
            F.lag("snapshot_no").over(by_no).alias("prev_no"), F.lead("snapshot_no").over(by_no).alias("next_no"),
            F.greatest(F.lit(1), F.ceil(F.max("n").over(Window.partitionBy("repository_id")) / F.lit(rows_per_bucket))).cast("long").alias("buckets"),
        )
    )
    # the only shuffle of the rows: all that follows groups by repository and bucket first
    placed = join_small(raw, order, ["repository_id", "snapshot_no"], max_rows=broadcast_rows).withColumn("bucket", F.pmod(F.xxhash64("path", F.lit("bucket")), F.col("buckets"))).drop("buckets")
    near = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "repository_id", "bucket")
    latest = near.groupBy("repository_id", "bucket", "prev_no", "snapshot_no", "next_no", "path").agg(F.max("last").alias("last"))
    rows = latest.select("repository_id", "bucket", "prev_no", "snapshot_no", "next_no", "path", F.xxhash64("path").alias("kh"), F.xxhash64(F.coalesce(F.concat(F.lit("="), "last.hash"), F.lit("-"))).alias("vh"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    sides = F.array(
        F.struct(F.col("prev_no").alias("prev"), F.col("snapshot_no").alias("no"), F.lit(1).alias("sign")),
        F.struct(F.col("snapshot_no").alias("prev"), F.col("next_no").alias("no"), F.lit(-1).alias("sign")),
    )
    signed = (
        rows.select("repository_id", "bucket", "kh", "vh", F.explode(sides).alias("side"))
        .select("repository_id", "bucket", F.col("side.prev").alias("prev_no"), F.col("side.no").alias("snapshot_no"), F.col("side.sign").alias("sign"), "kh", "vh")
        .where("prev_no is not null and snapshot_no is not null")
    )
    found, rest, left, m = None, signed, None, cells
    for level in range(levels):
        peeled = cut(_peeled(rest, m, hashes))
        good = peeled.where("ok").drop("ok")
        found = good if found is None else found.unionByName(good)
        left = peeled.where("not ok").select(*_GROUP)
        if left.isEmpty():
            left = None
            break
        rest = join_small(signed, left, _GROUP, "left_semi", max_rows=broadcast_rows)
        m *= 4
    if left is not None:  # exact for the buckets that no table resolved
        exact = rest.groupBy(*_GROUP, "kh", "vh").agg(F.sum("sign").cast("int").alias("sign")).where("sign != 0")
        found = found.unionByName(exact.select(*_GROUP, "kh", "vh", "sign"))
    keys = (
        found.groupBy(*_GROUP, "kh")
        .agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"))
        .select(*_GROUP, "kh", F.col("hi").alias("sign"), F.when(F.col("lo") > 0, "added").when(F.col("hi") < 0, "removed").otherwise("changed").alias("change"))
    )
    # where a change's path stands: in the later snapshot, or, if it was removed, in the earlier one
    at = keys.select("repository_id", "bucket", "kh", F.when(F.col("sign") > 0, F.col("snapshot_no")).otherwise(F.col("prev_no")).alias("at_no"), F.col("snapshot_no").alias("later_no"), "change")
    few = at.limit(broadcast_rows + 1).count() <= broadcast_rows
    named = rows.select("repository_id", "bucket", F.col("snapshot_no").alias("at_no"), "path", "kh").join(F.broadcast(at) if few else at, ["repository_id", "bucket", "at_no", "kh"])
    changes = cut(named.select("repository_id", F.col("later_no").alias("snapshot_no"), "path", "change"))
    rows.unpersist()
    return changes


def change_counts(changes: DataFrame) -> DataFrame:
    """Number of changes of each kind per repository and snapshot."""
    return changes.groupBy("repository_id", "snapshot_no").agg(*(F.count_if(F.col("change") == k).cast("long").alias(k) for k in ("added", "removed", "changed")))
