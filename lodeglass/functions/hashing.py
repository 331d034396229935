"""Fingerprints: SHA-256 in the JVM, xxh64 with seed 0 in Arrow batches, identities made from them."""

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def integrity_hash(col: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


@F.pandas_udf(T.StringType())
def content_fingerprint(texts: pd.Series) -> pd.Series:
    """xxh64: and the 16 hexadecimal digits of the UTF-8 text, seed 0; null stays null."""
    return texts.map(lambda t: None if t is None else "xxh64:" + xxhash.xxh64_hexdigest(t.encode("utf-8", "surrogatepass")))


def symbol_id(path: Column, kind: Column, name: Column, start_byte: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, kind, name, start_byte.cast("string")), 256), 1, 16)


def verified(content: Column, integrity: Column, fingerprint: Column) -> Column:
    """Whether the stored hash of either form is the content's."""
    digest = F.sha2(content, 256)
    return F.coalesce((integrity == F.concat(F.lit("sha256:"), digest)) | (fingerprint == digest), F.lit(False))


def snapshot_hash(rows, path: str = "path", digest: str = "content_hash"):
    """One row: SHA-256 over the lines path:hash in order of path. The lines of one snapshot meet in one place; for
    snapshots of any size use chained_snapshot_hash."""
    line = F.concat_ws(":", path, F.coalesce(digest, F.lit("null")))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("snapshot_hash"))


def chained_snapshot_hash(rows, path: str = "path", digest: str = "content_hash", buckets: int = 4096):
    """One row: SHA-256 over the digests of hash buckets, each over its lines in order; no group grows with the total
    beyond rows / buckets."""
    line = F.concat_ws(":", path, F.coalesce(digest, F.lit("null")))
    per = rows.groupBy(F.pmod(F.xxhash64(path), F.lit(buckets)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("snapshot_hash"))


def content_id(*cols: str) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)
