"""N-gram Jaccard join by vertical partitioning: the global n-gram order is cut into fragments, each counts apart.

The order puts rare shingles first: those not known to be frequent by their hash, the frequent
ones last by their document counts. It is cut into FRAGMENTS ranges, and so is every set: a segment is the part of a
set in one fragment. The overlap of two segments is counted in a task of its own, and a pair's overlaps
are summed. Which pairs are counted follows from the order too: two sets of the wanted similarity share a shingle among
the first few of both (their prefixes), so only these propose pairs; the order decides how many
pairs are proposed, never which links are found.

Equal sets are one node. ``links`` compares every proposed pair of nodes and returns all that link. ``join`` needs
components alone and takes a short cut: in two rounds each node is compared with one partner or a few of the shingles it
shares; the last round compares every proposed pair whose ends are not yet connected, which is exact for components
whatever the first two found.

Edge cases: null, empty and wordless texts have an empty set and link with nothing; fewer words than
a shingle's make the whole sequence one shingle; rows that share a doc_id are one document, which has the links of
each of its texts; a null doc_id is never linked and has no component; an empty table gives an empty result; other columns
of the input are not looked at. Shingles are told apart by 64-bit hashes, within a fragment by 48 bits, sets by 64 bits
(two sets that share these but not 128 bits end the job with an error).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.graph import components
from cairn.llm.tables import bucketed, stored, table
from cairn.llm.textnum import Words, grouped, mix

#: Shingles in this many documents of one task's block are counted for the order; most of them that are sent to executors.
LOCAL_FREQUENT, MOST_FREQUENT = 4, 1 << 19
#: Shingles of a block.
BLOCK = 6_000_000
#: Ranges of the order: all but the last share the shingles not known to be frequent.
FRAGMENTS = 4
#: Pairs of segments counted at once, and bytes of a shingle in a segment.
PAIRS, WIDTH = 1 << 12, 6
#: Random members of a shingle's main component that the others meet in the second round.
PICKED = 3


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin (one offset more than texts)."""
    words = Words(texts)
    h, text = words.hashes(), words.text
    n = words.per_text().astype(np.int64)
    g = h.copy()
    for i in range(1, size):  # one step for each further word that the text has
        follows = np.zeros(len(h), bool)
        follows[: len(h) - i] = text[i:] == text[: len(h) - i]
        at = np.flatnonzero(follows)
        g[at] = mix(g[at] * np.uint64(0xD6E8FEB86659FD93) + h[at + i])
    opens = np.concatenate([[0], np.cumsum(n)])[:-1]
    rank = np.arange(len(h)) - np.repeat(opens, n)
    whole = (rank + size <= np.repeat(n, n)) | (rank == 0)  # of a short text, the sequence from its first word
    g, text = g[whole], text[whole]
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return g[keep], np.searchsorted(text[keep], np.arange(len(texts) + 1))


def _frequent(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Shingles of many documents of a block, with how many."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= LOCAL_FREQUENT
        return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["token", "df"])

    for _, texts in grouped(batches):
        g, _ = shingle_sets(texts, size)
        held.append(g)
        n += len(g)
        if n > BLOCK:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _most_frequent(often: DataFrame) -> DataFrame:
    """The frequent end of the order, MOST_FREQUENT shingles at most: those over a count that a histogram of counts gives.

    No task hands on more than it has of these.
    """
    level = F.floor(4 * F.log2("df"))
    found = often.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()  # 4 rows for each doubling of a count
    least, total = None, 0
    for r in found:
        total += r["n"]
        if total > MOST_FREQUENT:
            break
        least = r["level"]
    return often.where(level >= least) if least is not None else often.limit(0)


class Order:
    """The global order: position of the frequent shingles; at most MOST_FREQUENT entries."""

    def __init__(self, rows):
        tokens, df = rows["token"].to_numpy(np.int64).view(np.uint64), rows["df"].to_numpy(np.int64)
        order = np.argsort(tokens)
        self.tokens, self.df = tokens[order], df[order]

    def ranks(self, g: np.ndarray) -> np.ndarray:
        """0 for a shingle not known to be frequent, else its document count."""
        if not len(self.tokens):
            return np.zeros(len(g), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, g), len(self.tokens) - 1)
        return np.where(self.tokens[at] == g, self.df[at], 0)


def _fingerprints(g: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two numbers."""
    f1, f2 = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
    np.add.at(f1, doc, mix(g + np.uint64(1)))
    np.add.at(f2, doc, mix(g ^ np.uint64(0xA0761D6478BD642F)))
    return f1.view(np.int64), f2.view(np.int64)


def _sets(batches: Iterable[pa.RecordBatch], size: int, percent: int, order) -> Iterator[pa.RecordBatch]:
    """Per document: set size, fingerprint of the set, and its prefix in the global order."""
    for rows, texts in grouped(batches):
        g, at = shingle_sets(texts, size)
        n = np.diff(at)
        doc = np.repeat(np.arange(len(texts)), n)
        f1, f2 = _fingerprints(g, doc, len(texts))
        by = np.lexsort((g, order.value.ranks(g), doc))
        g = g[by]
        length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
        take = np.arange(len(g)) - np.repeat(at[:-1], n) < np.repeat(length, n)
        prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(g[take].view(np.int64)))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), prefix], names=["doc_id", "n", "f1", "f2", "prefix"])


_SEGMENT = "node long, fragment int, n long, shingles binary"


def _segments(batches: Iterable[pa.RecordBatch], size: int, order) -> Iterator[pa.RecordBatch]:
    """The sets of texts, cut at the fragments of the order: WIDTH bytes of each shingle."""
    for _, texts in grouped(batches):
        g, at = shingle_sets(texts, size)
        n = np.diff(at)
        doc = np.repeat(np.arange(len(texts)), n)
        node, _ = _fingerprints(g, doc, len(texts))
        place = np.where(order.value.ranks(g) > 0, FRAGMENTS - 1, ((g >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32)).astype(np.int64))
        key = doc * FRAGMENTS + place
        by = np.argsort(key, kind="stable")
        own, count = np.unique(key, return_counts=True)
        flat = np.ascontiguousarray(g[by].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])
        offsets = np.concatenate([[0], np.cumsum(count * WIDTH)]).astype(np.int32)
        shingles = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(node[own // FRAGMENTS]), pa.array((own % FRAGMENTS).astype(np.int32)), pa.array(n[own // FRAGMENTS].astype(np.int64)), shingles], names=["node", "fragment", "n", "shingles"])


_COUNTS = "a long, b long, n_a long, n_b long, overlap long"


def _overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two segments in one fragment: how many shingles they share."""
    def keys(column: pa.Array) -> np.ndarray:
        segments = column.to_pylist()
        flat = np.zeros((sum(map(len, segments)) // WIDTH, 8), np.uint8)
        flat[:, :WIDTH] = np.frombuffer(b"".join(segments), np.uint8).reshape(-1, WIDTH)
        pair = np.repeat(np.arange(len(segments), dtype=np.uint64), [len(s) // WIDTH for s in segments])
        return flat.view("<u8").ravel() | pair << np.uint64(8 * WIDTH)

    for b in batches:
        for x in range(0, b.num_rows, PAIRS):
            part = b.slice(x, PAIRS)
            both = np.sort(np.concatenate([keys(part.column("left")), keys(part.column("right"))]))
            shared = both[1:][both[1:] == both[:-1]] >> np.uint64(8 * WIDTH)
            overlap = np.bincount(shared.astype(np.int64), minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(overlap)], names=[c.split()[0] for c in _COUNTS.split(", ")])


def _close(n1: Column, n2: Column, percent: int) -> Column:
    return (n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent)


def _shared(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of all rows; nodes at the shingles of their prefixes that others share; segments of these nodes in buckets."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    often = docs.select("text").mapInArrow(partial(_frequent, size=size), "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    order = spark.sparkContext.broadcast(Order(_most_frequent(stored(often, "frequent-shingles")).toPandas()))
    sets = stored(docs.mapInArrow(partial(_sets, size=size, percent=percent, order=order), "doc_id long, n long, f1 long, f2 long, prefix array<long>"), "shingle-sets")

    nodes = sets.where("doc_id IS NOT NULL AND n > 0").groupBy(F.col("f1").alias("node")).agg(F.min("doc_id").alias("of"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("f2").alias("f2"), F.max("f2").alias("other"))
    nodes = nodes.withColumn("n", F.when(F.col("f2") == F.col("other"), F.col("n")).otherwise(F.raise_error(F.lit("two sets have one fingerprint")).cast("long")))
    posts = nodes.select("node", "of", F.posexplode("prefix").alias("pos", "token"), "n").select("node", "of", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("n_pos"), "token")
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")  # combined before its shuffle; a join splits a frequent token's rows, a window couldn't
    posts = posts.join(shared, "token")
    posts = stored(posts.select("node", "of", "token", "c", F.shiftright("n_pos", 32).alias("n"), F.col("n_pos").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")), "shared-shingles")

    # segments of all that may link, in buckets: each verification joins them without another shuffle of one side; equal sets meet before the shuffle
    segments = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(partial(_segments, size=size, order=order), _SEGMENT).groupBy("node", "fragment").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    wanted = posts.select("node").distinct().select("node", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))).alias("fragment"))
    segments = bucketed(segments.join(wanted, ["node", "fragment"], "left_semi"), "ngram_segments", "node", "fragment", placed=True)
    return sets, posts, segments


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b -> those that link, by the sum of their overlaps in all fragments: a, b, n_a, n_b, overlap."""
    left, right = (segments.select(F.col("node").alias(x), "fragment", F.col("n").alias(f"n_{x}"), F.col("shingles").alias(y)) for x, y in (("a", "left"), ("b", "right")))
    each = pairs.select("a", "b", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))).alias("fragment"))
    counts = each.join(left, ["a", "fragment"]).join(right, ["b", "fragment"]).mapInArrow(_overlaps, _COUNTS)
    counts = counts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return counts.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap")))


def _enough(n1: Column, pos1: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Whether sets can link whose first shared shingle stands at these positions of the order."""
    return (100 + percent) * F.least(n1 - pos1, n2 - pos2) >= percent * (n1 + n2)


def links(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Every pair of different sets under 100 * overlap >= percent * union: a < b, n_a, n_b, overlap.

    Rows of equal sets meet as the one with the smallest doc_id; a and b are these. In a group of near copies the
    pairs are as many as its square, as the result is.
    """
    _, posts, segments = _shared(docs, size, percent)
    left = posts.select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos")])
    near = _close(F.col("n"), F.col("n_a"), percent) & _enough(F.col("n"), F.col("pos"), F.col("n_a"), F.col("pos_a"), percent)
    pairs = left.join(posts, "token").where((F.col("node_a") < F.col("node")) & near).select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()
    rows, of = _verified(stored(pairs, "pairs"), segments, percent), posts.select("node", "of").distinct()
    rows = rows.join(of.toDF("a", "of_a"), "a").join(of.toDF("b", "of_b"), "b").where("of_a <> of_b")
    ends = F.sort_array(F.array(*(F.struct(F.col(f"of_{x}").alias("of"), F.col(f"n_{x}").alias("n")) for x in "ab")))
    return rows.select(ends[0]["of"].alias("a"), ends[1]["of"].alias("b"), ends[0]["n"].alias("n_a"), ends[1]["n"].alias("n_b"), "overlap")


def join(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document its set size (n_shingles) and component_id under 100 * intersection >= percent * union."""
    sets, posts, segments = _shared(docs, size, percent)

    def verified(pairs: DataFrame) -> DataFrame:
        return stored(_verified(pairs, segments, percent).select("a", "b"), "near-links")

    def best(rows: DataFrame, *key: str) -> DataFrame:
        """The partner with which each node shares most shingles of its prefix."""
        rows = rows.where((F.col("node") != F.col("pivot.node")) & _close(F.col("n"), F.col("pivot.n"), percent)).groupBy("node", "pivot.node", *key).agg(F.count(F.lit(1)).alias("c"))
        rows = rows.toDF("a", "b", *key, "c").groupBy("a", *key).agg(F.max(F.struct("c", "b")).alias("best"))
        return stored(rows.select("a", F.col("best.b").alias("b")).distinct(), "pairs")

    def mixed(links: DataFrame) -> DataFrame:
        """Rows of shingles that several components share, with the component that has most of them."""
        marked = posts.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        main = marked.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
        return stored(marked.join(main.select("token", F.col("top.component").alias("main")), "token"), "mixed-shingles")

    # first round: the oldest node (least doc_id) of each shingle, likely what a group of copies was made from
    rows = stored(posts.join(posts.groupBy("token").agg(F.min(F.struct("of", "node", "n")).alias("pivot")), "token"), "first-shingles")
    links = verified(best(rows))
    # second round: who is not yet in the main component of its shingles meets random members of it
    rows = mixed(links)
    picked = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), F.lit(i).alias("kind"), "node", "n")).alias(f"p{i}") for i in range(PICKED)]
    pivots = rows.where("component = main").groupBy("token").agg(*picked)
    rows = rows.where("component <> main").join(pivots, "token").withColumn("pivot", F.explode(F.array(*[f"p{i}" for i in range(PICKED)]))).withColumn("kind", F.col("pivot.kind"))
    links = links.unionByName(verified(best(rows, "kind")))
    # last round, exact: every pair with different components has an end outside the shingle's main component. The first
    # shingle that two sets share leaves the most to come
    rows = mixed(links)
    few = rows.where("component <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "component")])
    enough = _enough(F.col("n"), F.col("pos"), F.col("n_a"), F.col("pos_a"), percent)
    apart = few.join(rows, (few["token"] == rows["token"]) & (F.col("component") != F.col("component_a")) & ((F.col("component") == F.col("main")) | (F.col("node") < F.col("node_a"))) & _close(F.col("n"), F.col("n_a"), percent) & enough)
    links = links.unionByName(verified(stored(apart.select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b")).distinct(), "pairs")))

    # the texts of one document belong together
    narrow = sets.select("doc_id", "n", "f1").where("doc_id IS NOT NULL AND n > 0")
    texts = narrow.groupBy("doc_id").agg(F.min("f1").alias("a"), F.max("f1").alias("z")).where("a <> z")
    links = links.unionByName(narrow.join(texts, "doc_id").where("f1 <> a").select("a", F.col("f1").alias("b")).distinct())
    labels = stored(components(links), "components")
    groups = narrow.groupBy(F.col("f1").alias("node")).agg(F.min("doc_id").alias("of")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = stored(groups, "set-groups")
    least = groups.groupBy("component").agg(F.min("of").alias("component_id"))
    groups = groups.join(least, "component").select(F.col("node").alias("f1"), "component_id")
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    rows = sets.select("doc_id", "n", F.when(own, F.col("f1")).alias("f1")).join(groups, "f1", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents", "doc_id", "text"), size=4, percent=85)


def op10_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents", "doc_id", "text"), size=4, percent=85)
