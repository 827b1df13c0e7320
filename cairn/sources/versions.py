"""Folders whose state is what their last committed version says.

A version is one small file, written whole by Spark's commit: it counts once its _SUCCESS mark is there. What a killed writer
leaves belongs to no version. Data folders never change after their commit; versions list those that count.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a single machine may go without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file:///tmp/cairn-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """A write in here removes its shuffle files when it ends; nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none where it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The last committed version and its state; (0, {}) where there is none."""
    for name in sorted(_listed(spark, f"{root}/versions"), reverse=True):
        if "_SUCCESS" in _listed(spark, f"{root}/versions/{name}"):
            return int(name), json.loads(spark.read.text(f"{root}/versions/{name}", wholetext=True).first()[0])
    return 0, {}


def commit(spark: SparkSession, root: str, state: dict, after: int) -> int:
    """Make state the next version; after: the version it was made from. Fails where another writer was first."""
    if current(spark, root)[0] != after:
        raise RuntimeError(f"another writer has committed to {root} since version {after}")
    version = max([after, *map(int, _listed(spark, f"{root}/versions"))]) + 1
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{root}/versions/{version:08d}")
    return version


def new_name() -> str:
    """A name for a data folder that no other writer takes."""
    return uuid.uuid4().hex


def removed_unlisted(spark: SparkSession, root: str, folder: str, listed: set[str]) -> list[str]:
    """Delete data folders that no wanted version lists; readers of older versions must have ended."""
    gone = [n for n in _listed(spark, f"{root}/{folder}") if n not in listed]
    for n in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}/{n}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone
