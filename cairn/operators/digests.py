"""Comparison of two copies of a table by trees of digests: only key ranges whose digests differ are read row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Children of a node, and levels below the root.
FAN, LEVELS = 16, 3
_NODE, _ROW = "node int, x long, s long, n long", "key string, hash string, leaf int, top int"


def _leaf(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FAN**LEVELS)).cast("int")


def _together(rows: DataFrame, *node: str) -> DataFrame:
    """Digests of nodes from those below: order doesn't matter, and rows that come twice don't cancel out as they are counted and summed too."""
    return rows.groupBy(*node).agg(F.bit_xor("x").alias("x"), F.sum("s").alias("s"), F.sum("n").alias("n"))


def write(table: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Row hashes below path/rows in folders by leaf range, digests of all levels below path/tree."""
    own = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    rows = table.select(F.col(key).cast("string").alias("key"), own.alias("hash")).withColumn("leaf", _leaf(F.col("key"))).withColumn("top", F.floor(F.col("leaf") / FAN ** (LEVELS - 1)).cast("int"))
    rows.repartitionByRange("leaf", "key").sortWithinPartitions("leaf", "key").write.partitionBy("top").parquet(f"{path}/rows")
    h = F.xxhash64("key", "hash")
    leaves = _together(table.sparkSession.read.schema(_ROW).parquet(f"{path}/rows").select("leaf", h.alias("x"), F.shiftright(h, 40).alias("s"), F.lit(1).cast("long").alias("n")), "leaf")
    above = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("leaf") / FAN ** (LEVELS - k)).cast("int").alias("node")) for k in range(LEVELS + 1)]))
    nodes = _together(leaves.select("x", "s", "n", above.alias("at")).select("at.*", "x", "s", "n"), "level", "node")  # a bounded number
    nodes.coalesce(1).write.partitionBy("level").parquet(f"{path}/tree")


def differing(spark: SparkSession, a: str, b: str) -> list[int]:
    """Leaves whose digests differ, found from the root down; only children of nodes that differ are compared."""
    nodes: list[int] | None = None
    for k in range(LEVELS + 1):
        sides = [spark.read.schema(_NODE).parquet(f"{x}/tree/level={k}") for x in (a, b)]
        if nodes is not None:
            sides = [s.where(F.floor(F.col("node") / FAN).isin(nodes)) for s in sides]
        left, right = sides[0].select("node", F.struct("x", "s", "n").alias("l")), sides[1].select("node", F.struct("x", "s", "n").alias("r"))
        nodes = [r[0] for r in left.join(right, "node", "full").where(~F.col("l").eqNullSafe(F.col("r"))).select("node").collect()]
        if not nodes:
            return []
    return nodes


def rows_of(spark: SparkSession, path: str, leaves: list[int]) -> DataFrame:
    """The row hashes of some leaves: folders of others aren't listed, row groups of others are skipped."""
    return spark.read.schema(_ROW).parquet(f"{path}/rows").where(F.col("top").isin(sorted({x // FAN ** (LEVELS - 1) for x in leaves})) & F.col("leaf").isin(leaves)).select("key", "hash")


def difference(spark: SparkSession, a: str, b: str) -> DataFrame:
    """key, side: a (only there), b (only there) or both (with another hash)."""
    leaves = differing(spark, a, b)
    if not leaves:
        return spark.createDataFrame([], "key string, side string")
    left, right = (rows_of(spark, x, leaves).withColumnRenamed("hash", n) for x, n in ((a, "l"), (b, "r")))
    rows = left.join(right, "key", "full").where(~F.col("l").eqNullSafe(F.col("r")))
    return rows.select("key", F.when(F.col("r").isNull(), "a").when(F.col("l").isNull(), "b").otherwise("both").alias("side")).distinct()


def of_tables(found: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("name", F.lit(name)) for name, df in found.items()])
