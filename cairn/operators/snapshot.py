"""A snapshot of documents and their chunks in generations: batches are added, readers merge, compaction folds.

A batch writes one generation: the documents it changes, tombstones of those it deletes, the chunks of what it changes. The
manifest commit makes documents and chunks visible together; before it readers see the state before. A row counts
until a later generation has its key, so an update deactivates all older chunks without touching them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.sources import versions

DOCS, CHUNKS = "docs", "chunks"


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def last_arrived(batch: DataFrame, key: str, arrived: str) -> DataFrame:
    """One row per key: the last to arrive, of several at once the one with the greatest hash."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(arrived), F.desc("content_hash"))
    return batch.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _rows(spark: SparkSession, root: str, state: dict, kind: str) -> DataFrame | None:
    found = [f"{root}/{kind}/{name}" for name in state.get("generations", [])]
    return spark.read.parquet(*found) if found else None


def _counting(spark: SparkSession, root: str, state: dict, kind: str, key: str) -> DataFrame | None:
    """Rows whose key no later generation has. Only keys of generations after the first are compared, a narrow and small side."""
    rows, names = _rows(spark, root, state, kind), state.get("generations", [])
    if rows is None or len(names) < 2:
        return rows
    later = spark.read.parquet(*[f"{root}/{DOCS}/{n}" for n in names[1:]]).groupBy(F.col(key).alias("_k")).agg(F.max("generation").alias("_g"))
    return rows.join(later, F.col(key).eqNullSafe(F.col("_k")) & (F.col("generation") < F.col("_g")), "left_anti")


def documents(spark: SparkSession, root: str, version: tuple[int, dict] | None = None) -> DataFrame | None:
    """The documents that are there, of the last version or a given one; None where nothing was applied."""
    state = (version or versions.current(spark, root))[1]
    rows = _counting(spark, root, state, DOCS, state.get("key", ""))
    return None if rows is None else rows.where("live").drop("live", "action")


def chunks(spark: SparkSession, root: str, version: tuple[int, dict] | None = None) -> DataFrame | None:
    """The active chunks."""
    state = (version or versions.current(spark, root))[1]
    return _counting(spark, root, state, CHUNKS, state.get("key", ""))


def apply(spark: SparkSession, root: str, batch: DataFrame, chunked: Callable[[DataFrame], DataFrame], key: str = "key", text: str = "text", fill: tuple[str, ...] = ()) -> int:
    """Apply a batch and give its generation.

    batch: key, text, arrived, deleted and any columns that every batch has. Equal texts are skipped; where a changed document
    has no value in a ``fill`` column, the old one stays. chunked: changed documents -> their chunks, with the key's column.
    """
    before = versions.current(spark, root)
    old, generation = documents(spark, root, before), before[1].get("last", 0) + 1
    new = last_arrived(batch.withColumn("content_hash", content_hash(F.col(text))), key, "arrived")
    if old is None:
        new = new.where("NOT deleted").withColumn("action", F.lit("insert"))
    else:
        kept = old.select(F.col(key).alias("_k"), F.col("content_hash").alias("_hash"), *[F.col(c).alias(f"_{c}") for c in fill], F.lit(True).alias("_there"))
        rows = new.join(kept, F.col(key).eqNullSafe(F.col("_k")), "left")
        there, same = F.col("_there").isNotNull(), F.col("content_hash") == F.col("_hash")
        action = F.when(F.col("deleted"), F.when(there, "delete")).when(~there, "insert").when(~same, "update")
        filled = {c: F.coalesce(c, f"_{c}") for c in fill}
        new = rows.withColumn("action", action).where("action IS NOT NULL").withColumns(filled).drop(*[c for c in rows.columns if c.startswith("_")])
    name = versions.new_name()
    new = new.withColumn("live", ~F.col("deleted")).withColumn("generation", F.lit(generation)).drop("deleted")
    new.write.parquet(f"{root}/{DOCS}/{name}")
    written = spark.read.parquet(f"{root}/{DOCS}/{name}")  # chunks of what was written, not of a second run of the plan
    chunked(written.where("live").drop("live", "action")).withColumn("generation", F.lit(generation)).write.parquet(f"{root}/{CHUNKS}/{name}")
    versions.commit(spark, root, {"key": key, "last": generation, "generations": [*before[1].get("generations", []), name]}, before[0])
    return generation


def compact(spark: SparkSession, root: str) -> None:
    """Fold all generations into one; rows keep the number of theirs, tombstones go."""
    before = versions.current(spark, root)
    if len(before[1].get("generations", [])) < 2:
        return
    name, key = versions.new_name(), before[1]["key"]
    _counting(spark, root, before[1], DOCS, key).where("live").write.parquet(f"{root}/{DOCS}/{name}")
    _counting(spark, root, before[1], CHUNKS, key).write.parquet(f"{root}/{CHUNKS}/{name}")
    versions.commit(spark, root, before[1] | {"generations": [name]}, before[0])


def vacuum(spark: SparkSession, root: str) -> None:
    """Delete what the current version doesn't list: folded generations and what killed writers left."""
    listed = set(versions.current(spark, root)[1].get("generations", []))
    for kind in (DOCS, CHUNKS):
        versions.removed_unlisted(spark, root, kind, listed)
