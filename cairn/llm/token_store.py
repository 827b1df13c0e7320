"""Content-addressed store of token ids.

Rolling hashes cut each document's ids into chunks; a chunk is kept once under the digest
of its bytes; a document's recipe lists its chunks' digests. The encoding pass hashes each document's id, length
and recipe; a Merkle tree over these, with each one's place, is the manifest. Readers hash the recipes as they
find them, compare every node of the tree, and check each chunk against its digest: a file that was changed or lost ends
the job with an error.

Layout below one folder: ``raw/kind=0`` unique chunks (key, payload), ``raw/kind=1``
recipes as written by the encoding pass, ``recipes`` the same in ascending document order
with each document's start, ``manifest`` the levels of the Merkle tree, the last of one node.

Edge cases: null and empty texts are documents of the end id alone; repeated rows and ids
are documents of their own, in input order; null ids come first; an empty table
gives an empty store; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.tables import shared_dir, table
from cairn.llm.tokens import grouped, library_encoder

#: A chunk ends where the low bits of the hash of its last 16 ids are 0, within these lengths.
MASK, LEAST, MOST, REACH = 0xFF, 64, 1024, 16
#: Children of a node of the Merkle tree over documents.
FANOUT = 1024
DIGEST = 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def leaf(doc_id: int | None, n: int, recipe: bytes) -> str:
    """Hash of a document: its id (null: nothing), its number of ids and its recipe."""
    return hashlib.sha256(f"{'' if doc_id is None else doc_id}:{n}:".encode() + recipe).hexdigest()


def _gear(ids: np.ndarray) -> np.ndarray:
    """A well mixed 32-bit value for each id."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def _marks(ids: np.ndarray) -> np.ndarray:
    """Ends that a chunk may have, by the hash of the ids before each.

    Documents may be joined: only hashes of a document's first ids reach into the one before, and none of these, under LEAST, ends a chunk.
    """
    n = len(ids)
    g, h = _gear(ids), np.zeros(n, np.uint32)
    for j in range(min(REACH, n)):
        h[j:] += g[: n - j] << np.uint32(j)
    return np.flatnonzero((h >> np.uint32(REACH - 1)) & np.uint32(MASK) == 0) + 1


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document; the content around an end decides it, so copies and shared passages cut alike."""
    return _ends(len(ids), _marks(ids).tolist())


def _ends(n: int, marks: list[int]) -> list[int]:
    ends, last = [], 0
    for c in marks:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == n else [*ends, n]


def _chunked(batches: Iterable[pa.RecordBatch], path: str, end_id: int, width: str) -> Iterator[pa.RecordBatch]:
    """Chunk rows (kind 0) and one recipe row for each document (kind 1)."""
    encoder = library_encoder(path, spaced=False)
    for rows, texts in grouped(batches):
        kind, key, payload, row, doc, counts, leaves = [], [], [], [], [], [], []
        here: set[bytes] = set()
        ids, upto = encoder.encode_joined(texts, end_id)
        marks, size, first = _marks(ids), np.dtype(width).itemsize, 0
        whole = ids.astype(width).tobytes()
        places = np.searchsorted(marks, np.append(0, upto), "right").tolist()
        for i, (uid, doc_id, stop) in enumerate(zip(rows.column("_row").to_pylist(), rows.column("doc_id").to_pylist(), upto.tolist(), strict=True)):
            n, stored = stop - first, whole[first * size : stop * size]
            recipe, last = [], 0
            for e in _ends(n, (marks[places[i] : places[i + 1]] - first).tolist()):
                chunk = stored[last * size : e * size]
                recipe.append(d := digest(chunk))
                if d not in here:
                    here.add(d)
                    kind.append(0), key.append(d), payload.append(chunk), row.append(None), doc.append(None), counts.append(e - last), leaves.append(None)
                last = e
            kind.append(1), key.append(uid.to_bytes(8, "big")), payload.append(p := b"".join(recipe)), row.append(uid), doc.append(doc_id), counts.append(n), leaves.append(leaf(doc_id, n, p))
            first = stop
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.binary()), pa.array(payload, pa.binary()), pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(counts, pa.int64()), pa.array(leaves, pa.string())], names=["kind", "key", "payload", "row", "doc_id", "n", "leaf"])


_RAW = "kind int, key binary, payload binary, row long, doc_id long, n long, leaf string"
_NODE = "position long, hash string"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: str = "<u2") -> None:
    """Encode every whole text and write the store. One pass over the texts, one shuffle of the ids.

    width: little-endian type that holds every id of the vocabulary.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"), "text")
    rows = rows.mapInArrow(partial(_chunked, path=tokenizer, end_id=end_id, width=width), _RAW)
    # equal chunks meet before and after the shuffle: a chunk that many documents share is one row for each task
    unique = rows.groupBy("kind", "key").agg(F.first("payload").alias("payload"), F.first("row").alias("row"), *[F.first(c).alias(c) for c in ("doc_id", "n", "leaf")])
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/raw")
    recipes = spark.read.schema(_RAW).parquet(f"{folder}/raw").where("kind = 1")
    in_order(recipes.select("row", "doc_id", F.col("n").alias("n_tokens"), F.col("payload").alias("recipe"), "leaf"), ["doc_id", "row"], "n_tokens", f"{folder}/recipes")
    level, nodes = 0, _above(spark.read.parquet(f"{folder}/recipes").select("position", F.concat_ws(":", "start", "leaf").alias("hash")))
    while True:
        nodes.write.parquet(f"{folder}/manifest/level={level}")
        nodes = spark.read.schema(_NODE).parquet(f"{folder}/manifest/level={level}")
        if len(nodes.take(2)) < 2:
            return
        level, nodes = level + 1, _above(nodes)


def in_order(df: DataFrame, order: list[str], value: str, path: str) -> None:
    """Write df in ascending order, with ``start``, the sum of ``value`` over all rows before, and ``position``.

    Rows are dealt out by range; sums of whole ranges (one row each) are added to running sums in each.
    """
    spark = df.sparkSession
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).write.parquet(f"{path}-sorted")
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{path}-sorted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    inner = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, "part").select(*df.columns, "part", (F.col("_v") + F.coalesce(F.sum(value).over(inner), F.lit(0))).alias("start"), (F.col("_n") + F.count(F.lit(1)).over(inner)).alias("position"))
    rows.write.parquet(path)


def _above(nodes: DataFrame) -> DataFrame:
    """The next level of the tree; a node has FANOUT children at most, so each is a small group."""
    children = F.array_sort(F.collect_list(F.struct("position", "hash")))
    return nodes.groupBy(F.floor(F.col("position") / FANOUT).alias("position")).agg(F.sha2(F.to_json(children), 256).alias("hash"))


def verify(spark: SparkSession, folder: str) -> None:
    """Compare every level of the manifest with what the level below (at first the recipes as read) gives; raise on a difference."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    own = F.sha2(F.concat(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("n_tokens").cast("string"), F.lit(":")).cast("binary"), F.col("recipe")), 256)
    below, level = recipes.select("position", F.concat_ws(":", "start", own).alias("hash")), 0
    while True:
        written = spark.read.schema(_NODE).parquet(f"{folder}/manifest/level={level}")
        both = _above(below).join(written.select("position", F.col("hash").alias("written")), "position", "full_outer")
        if both.where("NOT (hash <=> written)").take(1):
            raise ValueError(f"level {level} of the manifest differs from what it covers")
        if len(written.take(2)) < 2:
            return
        below, level = written, level + 1


def root(spark: SparkSession, folder: str) -> str | None:
    """Hash of the whole store, or None if it has no documents."""
    top = spark.read.parquet(f"{folder}/manifest").groupBy("level").agg(F.first("hash").alias("hash"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).first()
    return top["hash"] if top else None


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo that of CRC-32, in its bit order."""
    out, b = np.zeros(np.broadcast(a, b).shape, np.uint32), np.broadcast_to(b, np.broadcast(a, b).shape).copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 values as seen with so many bytes behind them: joined data has the xor of its parts' shifted values."""
    power, n, out = np.array([1 << 23], np.uint32), n_bytes.astype(np.uint64), crc.astype(np.uint32)
    while n.any():
        out = np.where(n & np.uint64(1), _times(np.broadcast_to(power, out.shape), out), out)
        power, n = _times(power, power), n >> np.uint64(1)
    return out


def _read_chunks(batches: Iterable[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, payloads = b.column("key").to_pylist(), b.column("payload").to_pylist()
        for k, p in zip(keys, payloads, strict=True):
            if digest(p) != k:
                raise ValueError(f"chunk {k.hex()} doesn't have its digest")
        ids = [np.frombuffer(p, width).astype("<u4") for p in payloads]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], names=["key", "n", "crc"])


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, suffix bytes, crc) -> shifted crc."""
    for b in batches:
        crc = shift_crc(b.column("crc").to_numpy().astype(np.uint32), b.column("behind").to_numpy() * 4)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(crc.astype(np.int64)), b.column("n")], names=["row", "crc", "n"])


def read_digests(spark: SparkSession, folder: str, width: str = "<u2") -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, n_chunks.

    Each unique chunk is read and verified once; documents are put together from their
    recipes by joining the values of chunks (not their bytes). A chunk in very many documents is
    a skewed key of that join, which adaptive execution splits.
    """
    verify(spark, folder)
    raw = spark.read.schema(_RAW).parquet(f"{folder}/raw").where("kind = 0")
    chunks = raw.select("key", "payload").mapInArrow(partial(_read_chunks, width=width), "key binary, n long, crc long")
    recipes = spark.read.parquet(f"{folder}/recipes")
    each = recipes.select("row", F.posexplode(F.expr(f"transform(sequence(0, cast(length(recipe) / {DIGEST} as int) - 1), i -> substring(recipe, i * {DIGEST} + 1, {DIGEST}))")).alias("seq", "key"))
    each = each.join(chunks, "key", "left").select("row", "seq", "n", "crc")
    behind = Window.partitionBy("row").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("behind", F.coalesce(F.sum("n").over(behind), F.lit(0))).select("row", "crc", "n", "behind")
    each = each.withColumn("crc", F.coalesce("crc", F.raise_error(F.lit("a chunk is missing")).cast("long")))
    whole = each.mapInArrow(_joined, "row long, crc long, n long").groupBy("row").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n_read"), F.count(F.lit(1)).alias("n_chunks"))
    return recipes.join(whole, "row").select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32", "n_chunks")


def _rebuilt(batches: Iterable[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in b.column("chunks").to_pylist():
            for x in c:
                if digest(x["payload"]) != x["key"]:
                    raise ValueError(f"chunk {x['key'].hex()} doesn't have its digest")
        ids = [np.frombuffer(b"".join(x["payload"] for x in sorted(c, key=lambda x: x["seq"])), width).astype(np.int64) for c in b.column("chunks").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def reconstruct(spark: SparkSession, folder: str, width: str = "<u2") -> DataFrame:
    """Documents with their whole ids, in no order: for exports; the digests above need no such shuffle."""
    verify(spark, folder)
    raw = spark.read.schema(_RAW).parquet(f"{folder}/raw").where("kind = 0")
    each = spark.read.parquet(f"{folder}/recipes").select("row", "doc_id", F.posexplode(F.expr(f"transform(sequence(0, cast(length(recipe) / {DIGEST} as int) - 1), i -> substring(recipe, i * {DIGEST} + 1, {DIGEST}))")).alias("seq", "key"))
    rows = each.join(raw.select("key", "payload"), "key", "left").withColumn("payload", F.coalesce("payload", F.raise_error(F.lit("a chunk is missing")).cast("binary")))
    rows = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("seq", "key", "payload")).alias("chunks"))
    return rows.mapInArrow(partial(_rebuilt, width=width), "doc_id long, ids array<long>")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "token-store")
    write(table(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_digests(spark, folder)
