"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search in it.

Equal vectors are one node. The graph starts from exact neighbours within blocks of nodes that lie side by side
along random directions. Then rounds of joins look at neighbours of neighbours: every node hands its
(forward and some reverse) neighbours to one task as a bounded list, in which those meet of which one is a new link.
A query starts at its own node and moves, hop by hop, to the most similar nodes not yet visited.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
shorter vectors count as filled up with zeros; rows that share a vec_id are one row (the least vector
of them), a null vec_id takes no part; ties go to the smaller vec_id; with fewer candidates than asked for, all are
returned; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.tables import bucketed, stored, table

#: Neighbours of a node; reverse neighbours that a node hands on; pairs that each handed node keeps of a meeting.
K, REVERSE, KEEP = 32, 16, 8
#: Random directions of the start, nodes of a block, and cuts of a direction into cells at most (cells hold many blocks beyond).
DIRECTIONS, BLOCK, CUTS = 4, 1024, 1023
#: A link must be better by so much to take another's place: single precision tells no less apart, so near copies settle.
BETTER = 1e-6
#: Rounds end when no more than this share of the links is new.
SETTLED = 0.01
#: Nodes that a query keeps; hops end when all of them are expanded.
BEAM = 128


def _nodes(vectors: DataFrame) -> DataFrame:
    """vec_id, vec of the rows that take part, one per vec_id."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    good = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    return v.where(good).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column, filled up with zeros to dim."""
    lengths, out = np.diff(column.offsets.to_numpy()), np.zeros((len(column), dim), kind)
    out[np.arange(dim) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    m = _matrix(column, dim)
    m /= np.abs(m).max(1, keepdims=True)  # neither overflow nor underflow of squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _projected(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Unit vectors in single precision, and where each lies along the random directions."""
    directions = np.random.default_rng(7).normal(size=(dim, DIRECTIONS))
    for b in batches:
        u = _unit(b.column("vec"), dim)
        yield pa.RecordBatch.from_arrays(
            [b.column("node"), pa.array([x.tobytes() for x in u.astype(np.float32)], pa.binary()), *(pa.array(c) for c in (u @ directions).T.copy())],
            names=["node", "unit", *(f"along{i}" for i in range(DIRECTIONS))],
        )


def _links(ids: np.ndarray, units: np.ndarray, most: int, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most similar others of each of the given nodes, among themselves; those not over the bar have similarity -9."""
    sims = units @ units.T
    sims[ids[:, None] == ids] = -9
    if bar is not None:
        sims[sims <= bar + BETTER] = -9
    most = min(most, len(ids) - 1)
    best = np.argpartition(-sims, most - 1, axis=1)[:, :most] if most > 0 else np.zeros((len(ids), 0), np.int64)
    return np.repeat(ids, most), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()


def _units(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1)


_LINK = "u long, v long, sim float"


def _batch(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    good = sim > -5
    return pa.RecordBatch.from_arrays([pa.array(u[good].astype(np.int64)), pa.array(v[good].astype(np.int64)), pa.array(sim[good].astype(np.float32))], names=["u", "v", "sim"])


def _celled(batches: Iterable[pa.RecordBatch], cuts: list[list[float]]) -> Iterator[pa.RecordBatch]:
    """Each node once for each direction, with the cell that it lies in."""
    for b in batches:
        for i, edges in enumerate(cuts):
            along = b.column(f"along{i}")
            cell = np.searchsorted(np.array(edges), along.to_numpy()) + i * (CUTS + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), along, b.column("node"), b.column("unit")], names=["cell", "along", "node", "unit"])


def _block_links(batches: Iterable[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Links within blocks of each cell, whose nodes come in order along its direction; the last block reaches back."""
    cell, ids, units = None, np.zeros(0, np.int64), None
    for b in batches:
        cells, nodes, new = b.column("cell").to_numpy(), b.column("node").to_numpy(), _units(b.column("unit").to_pylist())
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]])[: len(cells) + 1])
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if cell != cells[x]:
                if len(ids) > 1:
                    yield _batch(*_links(ids, units, K))
                cell, ids, units = cells[x], nodes[x:y], new[x:y]
            else:
                ids, units = np.concatenate([ids, nodes[x:y]]), np.vstack([units, new[x:y]])
            while len(ids) > 2 * block:
                yield _batch(*_links(ids[:block], units[:block], K))
                ids, units = ids[block // 2 :], units[block // 2 :]
    if len(ids) > 1:
        yield _batch(*_links(ids, units, K))


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that one node hands on meet: each keeps its best among those it has not met here before, if better than its worst link."""
    for b in batches:
        met, out = b.column("met"), []
        at, (ids, units, worst, fresh) = met.offsets.to_numpy(), met.flatten().flatten()
        at = at - at[0]
        ids, units, worst, fresh = ids.to_numpy(), _units(units.to_pylist()), worst.to_numpy(), fresh.to_numpy(zero_copy_only=False)
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            new = fresh[x:y]
            bar = np.where(new[:, None] | new, worst[x:y, None], np.float32(9))
            out.append(_links(ids[x:y], units[x:y], KEEP, bar))
        u, v, sim = (np.concatenate(c) for c in zip(*out, strict=True))
        by = np.lexsort((v, u))  # several nodes of a batch can bring the same two together
        u, v, sim = u[by], v[by], sim[by]
        first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])[: len(u)])
        yield _batch(u[first], v[first], sim[first])


def _best(links: DataFrame, n: int) -> DataFrame:
    """The K most similar of each node, old links before new ones as good, and the worst similarity it has (-9: room for more).

    One shuffle by the node, which has a bounded list of links from each meeting.
    """
    rows = links.repartition(n, "u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"))
    own = Window.partitionBy("u")
    rows = rows.withColumn("r", F.row_number().over(own.orderBy(F.desc("sim"), "fresh", F.xxhash64("u", "v")))).where(F.col("r") <= K)
    return rows.withColumn("worst", F.when(F.count(F.lit(1)).over(own) >= K, F.min("sim").over(own)).otherwise(F.lit(-9.0)).cast("float"))


def build(units: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """The graph u, v, sim, r (rank) over the nodes of ``units`` (node, unit, along0..., in buckets of node)."""
    n_cells = min(CUTS, units.count() // (2 * block))
    shares = [(i + 1) / (n_cells + 1) for i in range(n_cells)]
    cuts = [list(x) for x in units.agg(*[F.percentile_approx(f"along{i}", shares, 10_000) for i in range(DIRECTIONS)]).first()] if shares else [[]] * DIRECTIONS
    cells = units.mapInArrow(partial(_celled, cuts=[c or [] for c in cuts]), "cell int, along double, node long, unit binary").repartition(n, "cell").sortWithinPartitions("cell", "along")
    links = cells.mapInArrow(partial(_block_links, block=block), _LINK).withColumn("fresh", F.lit(True))
    graph = bucketed(_best(links, n), "neighbours", "u", placed=True)
    while True:  # links only get better, so it ends
        back = Window.partitionBy("u").orderBy(F.desc("fresh"), F.xxhash64("u", "v"))  # tasks cut to REVERSE before the shuffle
        reverse = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh").withColumn("r", F.row_number().over(back)).where(F.col("r") <= REVERSE)
        lists = [x.groupBy("u").agg(F.collect_list(F.struct("v", "fresh")).alias(name)) for x, name in ((graph, "out"), (reverse, "in"))]  # K and REVERSE at most
        none = F.array().cast("array<struct<v: bigint, fresh: boolean>>")
        both = lists[0].join(lists[1], "u", "left").select("u", F.concat("out", F.coalesce("in", none)).alias("both"))
        told = F.exists("both", lambda x: x["fresh"])  # others have nothing new to tell
        handed = both.where(told).select("u", F.explode("both").alias("x")).groupBy("u", "x.v").agg(F.bool_or("x.fresh").alias("fresh"))
        vectors = units.select(F.col("node").alias("v"), "unit").join(graph.where("r = 1").select(F.col("u").alias("v"), "worst"), "v")
        met = handed.join(vectors, "v").groupBy("u").agg(F.collect_list(F.struct("v", "unit", "worst", "fresh")).alias("met"))  # K + REVERSE at most
        found = met.select("met").mapInArrow(_meetings, _LINK).withColumn("fresh", F.lit(True))
        graph = bucketed(_best(graph.select("u", "v", "sim").withColumn("fresh", F.lit(False)).unionByName(found), n), "neighbours", "u", placed=True)
        total = graph.agg(F.count(F.lit(1)).alias("all"), F.count_if("fresh").alias("new")).first()
        if total["new"] <= SETTLED * total["all"]:
            return graph


_STATE = "q long, q_vec array<float>, v array<long>, score array<double>, done array<boolean>"


def _moved(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """One hop: what a query keeps after it has seen the neighbours of what it kept. Rows: a query's state and the nodes met, with vectors."""
    for b in batches:
        out = []
        queries = _unit(b.column("q_vec"), dim)
        for i, unit in enumerate(queries):
            row = b.slice(i, 1)
            v, score = row.column("v").flatten().to_numpy(), row.column("score").flatten().to_numpy()
            met = row.column("met").flatten()
            if len(met):
                node, vec = met.flatten()
                node, first = np.unique(node.to_numpy(), return_index=True)
                new = ~np.isin(node, v)
                seen = _unit(vec.take(pa.array(first[new])), dim) @ unit if new.any() else np.zeros(0)
                kept = np.concatenate([v, node[new]])
                score = np.concatenate([score, seen])
                done = np.concatenate([np.ones(len(v), bool), np.zeros(new.sum(), bool)])
                by = np.lexsort((kept, -score))[:BEAM]
                v, score, done = kept[by], score[by], done[by]
            else:
                done = np.ones(len(v), bool)
            out.append((v, score, done))
        lists = [pa.array([x[k].tolist() for x in out], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.float64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("q_vec"), *lists], names=["q", "q_vec", "v", "score", "done"])


def search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """q, v, score: the BEAM most similar nodes found for each query (q, q_vec, node), its own node among them. vectors: v, vec, in buckets of v."""
    # a node that is a neighbour of very many shows only the REVERSE nearest of them; the others still lead to it
    back = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    reverse = graph.select("v", "u", "sim").withColumn("r", F.row_number().over(back)).where(F.col("r") <= REVERSE).select("v", F.col("u").alias("to"))
    edges = graph.select(F.col("u").alias("v"), F.col("v").alias("to")).unionByName(reverse).groupBy("v").agg(F.collect_set("to").alias("to"))  # K + REVERSE at most
    edges = bucketed(edges, "graph_edges", "v", placed=True)
    one = lambda c, kind: F.array(c.cast(kind))
    state = bucketed(queries.select("q", "q_vec", one(F.col("node"), "long").alias("v"), one(F.lit(1.0), "double").alias("score"), one(F.lit(False), "boolean").alias("done")), "beam", "q")
    while True:  # each hop expands nodes for good, so it ends
        go = state.select("q", F.explode(F.arrays_zip("v", "done")).alias("x")).where("NOT x.done").select("q", "x.v")
        to = go.join(edges, "v").select("q", F.explode("to").alias("v"))
        met = to.join(vectors, "v").groupBy("q").agg(F.collect_list(F.struct("v", "vec")).alias("met"))  # BEAM * (K + REVERSE) at most
        none = F.array().cast("array<struct<v: bigint, vec: array<float>>>")
        rows = state.join(met, "q", "left").withColumn("met", F.coalesce("met", none)).select("q", "q_vec", "v", "score", "done", "met")
        state = bucketed(rows.mapInArrow(partial(_moved, dim=dim), _STATE), "beam", "q", placed=True)
        if not state.where(F.exists("done", lambda x: ~x)).take(1):
            return state.select("q", F.explode(F.arrays_zip("v", "score")).alias("x")).select("q", "x.v", "x.score")


def _cosines(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = (_unit(b.column("q_vec"), dim) * _unit(b.column("vec"), dim)).sum(1)
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("vec_id"), pa.array(score)], names=["q", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector that is_query selects its k most similar others."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(_nodes(vectors), "vectors")
    dim = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(1))).first()[0]
    # the k + 1 smallest ids of equal vectors are all that can be among a query's k nearest; tasks cut to them before the shuffle
    ranked = rows.withColumn("m", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("m") <= k + 1)
    members = ranked.withColumn("node", F.min("vec_id").over(Window.partitionBy("vec"))).select("node", "vec_id", "vec", "m")
    members = stored(members, "vector-members")
    nodes = bucketed(members.where("m = 1").select("node", "vec"), "vector_nodes", "node")
    units = nodes.mapInArrow(partial(_projected, dim=dim), "node long, unit binary, " + ", ".join(f"along{i} double" for i in range(DIRECTIONS)))
    graph = build(bucketed(units, "unit_vectors", "node", placed=True), n, block)
    asked = rows.where(is_query).select(F.col("vec_id").alias("q"), F.col("vec").alias("q_vec"))
    queries = stored(asked.join(nodes, F.col("q_vec") == F.col("vec")).select("q", "q_vec", "node"), "vector-queries")
    found = search(graph, nodes.select(F.col("node").alias("v"), "vec"), queries.select("q", "q_vec", "node"), dim)
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))).where(F.col("r") <= k + 1)
    pairs = found.join(members.select(F.col("node").alias("v"), "vec_id", "vec"), "v").where("vec_id <> q").join(queries.select("q", "q_vec"), "q")
    pairs = pairs.select("q", "q_vec", "vec_id", "vec").mapInArrow(partial(_cosines, dim=dim), "q long, vec_id long, score double")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return pairs.select(F.col("q").alias("query_id"), F.col("rank").cast("int"), "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)
