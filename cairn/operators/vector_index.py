"""An inverted file of vectors: k-means cells of packed blocks, probed on until enough rows pass a query's filter.

Centroids are fitted to a bounded sample; every row is put into its nearest cell. How many cells a query looks at first is measured at
the build on the sample, for a wanted recall; a query whose filter lets too few rows through looks at twice as many, until it
has enough or has seen all. In exact mode it also looks at every cell that may hold something nearer than what it has: a cell's
rows lie within its radius of its centroid.

Rows without a vector, of zero length or with components that aren't finite take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.sources import versions

#: Rows that centroids are fitted to and probes are measured on; the most cells; rows of a block.
SAMPLE, MOST_CELLS, PACK = 20_000, 4096, 512
ROUNDS, WANTED = 10, 0.95
#: Rows that meet all centres at once, and bytes of blocks that a worker is handed at once.
STEP, BATCH_BYTES = 512, "16m"


def units(vectors: list[list[float] | None]) -> tuple[np.ndarray, np.ndarray]:
    """Places of usable vectors and those as unit vectors in double precision."""
    rows = [(i, np.array(v, np.float64)) for i, v in enumerate(vectors) if v and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    m = np.stack([v for _, v in rows])
    return np.array([i for i, _ in rows]), m / np.linalg.norm(m, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centre and its distance."""
    cell, far, own = np.zeros(len(x), np.int64), np.zeros(len(x)), (centres * centres).sum(1)
    for i in range(0, len(x), STEP):  # a whole sample against all centres is too much at once
        part = x[i : i + STEP]
        to = np.maximum((part * part).sum(1)[:, None] + own[None] - 2 * part @ centres.T, 0)
        at = to.argmin(1)
        cell[i : i + STEP], far[i : i + STEP] = at, np.sqrt(to[np.arange(len(part)), at])
    return cell, far


def fit(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """n centres of unit vectors by Lloyd's rounds; an empty cell gets the row that lies farthest out."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), n, replace=False)].copy()
    for _ in range(ROUNDS):
        cell, far = _nearest(x, centres)
        size = np.bincount(cell, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        empty = np.flatnonzero(size == 0)
        centres[empty] = x[np.argsort(-far)[: len(empty)]]
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, wanted: float) -> int:
    """Cells that queries like these have to look at for the wanted share of their k nearest."""
    few = x[:: max(1, len(x) // 200)]
    near = np.stack([np.argsort(-(x @ q))[: min(k + 1, len(x))] for q in few])
    cell, _ = _nearest(x, centres)
    place = np.stack([np.argsort(np.argsort(((q - centres) ** 2).sum(1))) for q in few])
    needed = np.take_along_axis(place, cell[near], axis=1)  # place of the cell that holds each neighbour
    counts = np.cumsum(np.bincount(needed.ravel(), minlength=len(centres))) / needed.size
    return int(np.searchsorted(counts, wanted)) + 1


def _celled(batches: Iterable[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, x = units(b.column("vec").to_pylist())
        if len(at):
            cell, far = _nearest(x, centres)
            rest = b.take(pa.array(at)).drop_columns(["vec"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far)], names=[*rest.schema.names, "unit", "cell", "far"])


def _packed(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows, those of a cell together, as blocks: cell, and every other column as a list (unit: joined)."""
    for b in batches:
        cells = b.column("cell").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
        cuts = [(x, min(x + size, end)) for begin, end in zip(edges, edges[1:], strict=False) for x in range(begin, end, size)]
        names = [n for n in b.schema.names if n not in ("cell", "unit")]
        columns = [pa.array([int(cells[x]) for x, _ in cuts], pa.int32()), pa.array([b"".join(b.column("unit").slice(x, y - x).to_pylist()) for x, y in cuts], pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array([b.column(n).slice(x, y - x).to_pylist() for x, y in cuts], pa.list_(b.schema.field(n).type)) for n in names]], names=["cell", "unit", *names])


def _pack(rows: DataFrame, size: int = PACK) -> DataFrame:
    """rows: cell, unit and others, those of a cell next to each other in their partitions."""
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name not in ("cell", "unit")]
    return rows.mapInArrow(partial(_packed, size=size), ", ".join(["cell int", "unit binary", *[f"`{n}` array<{t}>" for n, t in kinds]]))


def build(spark: SparkSession, root: str, rows: DataFrame, by: tuple[str, ...] = (), cells: int | None = None, k: int = 40, wanted: float = WANTED) -> None:
    """Write the index. rows: id, vec and the filter columns ``by``."""
    rows = rows.select(F.col("id").cast("long"), "vec", *[F.col(c).cast("string").alias(c) for c in by])
    n = rows.count()
    cut = -(2**63) + min(1.0, SAMPLE / max(n, 1)) * (2**64 - 1)
    sample = units([r[0] for r in rows.where(F.xxhash64("id") <= F.lit(min(int(cut), 2**63 - 1))).select("vec").toLocalIterator()])[1]  # about SAMPLE rows
    if not len(sample):
        versions.commit(spark, root, {"by": list(by), "centres": [], "probes": 0}, 0)
        return
    centres = fit(sample, min(cells or max(1, round(n**0.5)), MOST_CELLS, len(sample)))
    celled = rows.mapInArrow(partial(_celled, centres=centres), ", ".join(["id long", *[f"`{c}` string" for c in by], "unit binary", "cell int", "far double"]))
    celled.write.parquet(f"{root}/celled")
    celled = spark.read.parquet(f"{root}/celled")
    celled.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/cells")
    _pack(celled.drop("far").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")).write.partitionBy("cell").parquet(f"{root}/blocks")
    versions.commit(spark, root, {"by": list(by), "centres": centres.tolist(), "probes": probes_for(sample, centres, k, wanted)}, 0)


def _ranked(batches: Iterable[pa.RecordBatch], centres: np.ndarray, by: list[str]) -> Iterator[pa.RecordBatch]:
    """Queries with the cells in the order of their distance."""
    for b in batches:
        at, x = units(b.column("query_vec").to_pylist())
        if len(at):
            to = np.sqrt(np.maximum(1 + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0))
            order = np.argsort(to, axis=1, kind="stable")
            rest = b.take(pa.array(at))
            columns = [rest.column("query_id"), *[rest.column(c) for c in by], pa.array([r.tobytes() for r in x], pa.binary())]
            lists = [pa.array(v.tolist(), pa.list_(t)) for v, t in ((order, pa.int32()), (np.take_along_axis(to, order, 1), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=["query_id", *by, "unit", "cells", "to"])


def _met(batches: Iterable[pa.RecordBatch], k: int, by: list[str]) -> Iterator[pa.RecordBatch]:
    """Of each block of queries and block of rows: each query's k nearest that pass its filter, ties at the edge too."""
    for b in batches:
        for r in (row for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist()):  # one pair at a time is copied out of the batch
            q, ids = np.array(r["query_id"]), np.array(r["id"])
            sims = np.frombuffer(r["q_unit"]).reshape(len(q), -1) @ np.frombuffer(r["unit"]).reshape(len(ids), -1).T
            fit_ = q[:, None] != ids[None]
            for c in by:
                want, have = np.array(r[f"q_{c}"], object), np.array(r[c], object)
                fit_ &= np.equal(want, None)[:, None] | (want[:, None] == have[None])
            sims = np.where(fit_, sims, -9)
            if len(ids) > k:
                fit_ &= sims >= -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
            at = np.nonzero(fit_)
            yield pa.RecordBatch.from_arrays([pa.array(q[at[0]], pa.int64()), pa.array(ids[at[1]], pa.int64()), pa.array(sims[at])], names=["query_id", "id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = 40, exact: bool = False, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score, rank): the k nearest rows that pass, and (query_id, probed): cells looked at.

    queries: query_id (that row is no result of its own), query_vec and the index's filter columns, null for any value.
    """
    state = versions.current(spark, root)[1]
    by, centres = state["by"], np.array(state["centres"])
    place = versions.shared_folder(spark, "probes")
    empty = spark.createDataFrame([], "query_id long, id long, score double, rank int"), spark.createDataFrame([], "query_id long, probed long")
    if not len(centres):
        return empty
    asked = queries.select(F.col("query_id").cast("long"), "query_vec", *[F.col(c).cast("string").alias(c) for c in by])
    ranked = asked.mapInArrow(partial(_ranked, centres=centres, by=by), ", ".join(["query_id long", *[f"`{c}` string" for c in by], "unit binary", "cells array<int>", "to array<double>"]))
    ranked.write.parquet(f"{place}/ranked")
    ranked, blocks = spark.read.parquet(f"{place}/ranked"), spark.read.parquet(f"{root}/blocks")

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # a row of a batch holds two whole blocks

    def met(wanted: DataFrame) -> DataFrame:
        """wanted: query_id, filter columns, unit, cell."""
        sides = wanted.repartitionByRange("cell", "query_id").sortWithinPartitions("cell", "query_id")
        packed = _pack(sides).select("cell", "query_id", F.col("unit").alias("q_unit"), *[F.col(c).alias(f"q_{c}") for c in by])
        # sizes behind an explode or a worker are guessed too small, so none of these sides may be taken for one to broadcast
        return blocks.join(packed.hint("merge"), "cell").mapInArrow(partial(_met, k=k, by=by), "query_id long, id long, score double")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return spark.read.parquet(f"{place}/{name}")

    own = ["query_id", *by, "unit"]
    low, high, best, step = 0, min(max(1, probes or state["probes"]), len(centres)), empty[0], 0
    open_ = ranked
    seen = ranked.select("query_id", F.lit(0).alias("upto"))
    while True:  # at most log2 of the cells
        part = open_.select(*own, F.explode(F.slice("cells", low + 1, high - low)).alias("cell"))
        best = written(_best(best.drop("rank").unionByName(met(part)), k), f"best-{step}")
        seen = seen.unionByName(open_.select("query_id", F.lit(high).alias("upto")))
        enough = best.where(F.col("rank") == k).select("query_id")
        if high == len(centres):
            break
        open_ = written(open_.join(enough.hint("merge"), "query_id", "left_anti"), f"open-{step}")
        if open_.isEmpty():
            break
        low, high, step = high, min(2 * high, len(centres)), step + 1
    probed = seen.groupBy("query_id").agg(F.max("upto").cast("long").alias("probed"))
    if exact:
        radius = spark.read.parquet(f"{root}/cells")
        edge = best.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("edge"))
        rest = ranked.join(probed.hint("merge"), "query_id").select(*own, "probed", F.posexplode(F.arrays_zip("cells", "to")).alias("i", "c")).where("i >= probed")
        rest = rest.select(*own, F.col("c.cells").alias("cell"), F.col("c.to").alias("to")).join(edge.hint("merge"), "query_id").join(F.broadcast(radius), "cell").where(F.col("to") - F.col("radius") <= F.col("edge") + 1e-9)
        rest = written(rest.select(*own, "cell"), "rest")
        best = _best(best.drop("rank").unionByName(met(rest)), k)
        more = rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("more"))
        probed = probed.join(more, "query_id", "left").select("query_id", (F.col("probed") + F.coalesce("more", F.lit(0))).alias("probed"))
    return best, probed
