"""Session helpers shared by all operators: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small side may be broadcast; beyond it the other way of the caller is taken.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; only the columns a plan uses are read."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset a temporary one, which only a local
    session can use: on a cluster it is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if current.isEmpty():
        if not configured and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lodeglass-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, stored in the shared folder, so that a lost executor doesn't lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def outer_trim(col: Column | str) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(" \t\n\x0b\f\r"))


def normal_key(col: Column | str) -> Column:
    """Keys compare without letter case and outer white space."""
    return F.lower(outer_trim(col))


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", *, rows: int | None = None, max_rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join a large side with one that is usually small, without moving the large side where possible.

    rows is the counted size of the small side (counted here if None). Up to max_rows it is broadcast. Beyond, both
    sides are shuffled on the keys and a salt, so that a key that holds a third of the large side is spread over
    `salts` tasks; the small side is repeated once a salt.
    """
    if rows is None:
        rows = small.limit(max_rows + 1).count()
    if rows <= max_rows:
        return big.join(F.broadcast(small), list(on), how)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    salted = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
