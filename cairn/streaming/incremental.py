"""Incremental ingest: files that arrive become micro-batches, each applied to the snapshot of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import upsert


#: Key ranges of a snapshot; a batch writes those anew that it touches.
BUCKETS = 64


def ingest(spark: SparkSession, source: str, schema: T.StructType, snapshots: str, checkpoint: str, keys: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Reads what is new below ``source`` and ends. A batch n writes the key buckets it touches to
    ``snapshots``/batch=n/bucket=b; a batch that is repeated after a failure writes the same folder again, so each counts once.
    """
    def one(batch: DataFrame, n: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets``
        old = snapshot(spark, snapshots, n, touched)
        rows = upsert.latest(batch, keys).withColumn("version", F.lit(1)) if old is None else upsert.apply(old, batch, keys)
        rows.withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{snapshots}/batch={n}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, snapshots: str, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The latest state of each bucket (of batches under ``before``, of the buckets in ``only``), or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(snapshots)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    last: dict[int, tuple[int, str]] = {}
    for batch in fs.listStatus(path):
        if (name := batch.getPath().getName()).startswith("batch=") and (before is None or int(name[6:]) < before):
            for part in fs.listStatus(batch.getPath()):
                if (leaf := part.getPath().getName()).startswith("bucket=") and (only is None or int(leaf[7:]) in only):
                    last[int(leaf[7:])] = max(last.get(int(leaf[7:]), (-1, "")), (int(name[6:]), part.getPath().toString()))
    return spark.read.parquet(*[p for _, p in last.values()]) if last else None


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Extension: counts in fixed windows, batch or stream; a stream drops what is later than ``late``."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
