"""Reading of the synthetic tables and the shared folder that jobs write to."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Arrow data that a Python worker is handed at once.
ARROW_BYTES = "16m"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one table; Parquet prunes the others."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the session names no such folder, one is set on a single machine (tests); a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file:///tmp/cairn-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """A write in here removes its shuffle files when it ends; nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def bucketed(df: DataFrame, name: str, *keys: str, placed: bool = False) -> DataFrame:
    """Write df in buckets of the keys to the shared folder and read it back: joins on all of them then don't shuffle it.

    Rows are dealt out by the keys first, so each bucket is one file; placed: they already are. Only a table can have
    buckets; its name leaves the catalogue at once, its files stay.
    """
    spark, table_name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _tidy(spark):
        (df if placed else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", shared_dir(spark, name)).saveAsTable(table_name)
    out = spark.table(table_name)
    out.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {table_name}")
    return out


def least_hashed(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of least hash of the key, fewer if there are fewer.

    Only about a fifth more than these leave their tasks, however many tasks there are: hashes are even, so a cut follows
    from the number of rows. Where repeated keys leave too few below it, all rows are looked at.
    """
    n, h = df.count(), F.xxhash64(key)
    if n > most:
        cut = int(-(2**63) + min(1.0, 1.2 * most / n) * (2**64 - 1))
        few = df.where(h <= F.lit(min(cut, 2**63 - 1)))  # a double rounds the greatest up
        df = few if few.count() >= most else df
    return df.orderBy(h, key).limit(most)
