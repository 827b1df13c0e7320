"""Substring search through an index of trigrams: candidates have all trigrams of a pattern, then the pattern itself is tried on them.

Postings lie in blocks of ids, so no row grows with a frequent trigram. Patterns are those of ILIKE; ``containing`` makes one
of a user's term in which wildcards are plain characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of a block; folders by hash of the trigram.
BLOCK, BUCKETS = 4096, 64
#: Blocks of a bucket that go to one file.
REGION = 256
#: Characters of texts whose trigrams a worker holds at once; bytes of Arrow data that it is handed.
GROUP, BATCH_BYTES = 4_000_000, "16m"
_WILD = re.compile(r"\\(.)|[%_]", re.S)


def containing(term: str) -> str:
    """A pattern for texts that contain the term as it stands."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", term) + "%"


def literals(pattern: str) -> list[str]:
    """The stretches of a pattern between its wildcards, escapes resolved."""
    out, upto = [""], 0
    for m in _WILD.finditer(pattern):
        out[-1] += pattern[upto : m.start()]
        if m[1] is None:
            out.append("")
        else:
            out[-1] += m[1]
        upto = m.end()
    out[-1] += pattern[upto:]
    return [x for x in out if x]


def _grams(text: str) -> np.ndarray:
    """Distinct trigrams of a text: three code points in one number."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] | c[1:-1] << 21 | c[2:] << 42)


def _spelled(grams: np.ndarray) -> list[str]:
    text = np.stack([grams >> s & 0x1FFFFF for s in (0, 21, 42)], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + 3] for i in range(0, len(text), 3)]


def _posted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, block, ids of groups of texts. batches: block, id, low (the text in lower case)."""
    for b in batches:
        texts = b.column("low").to_pylist()
        size = np.cumsum([len(t) for t in texts]) // GROUP
        for first, end in zip(at := np.flatnonzero(np.diff(size, prepend=-1)), [*at[1:], len(texts)], strict=True):
            each = [_grams(t) for t in texts[first:end]]
            gram = np.concatenate(each)
            if not len(gram):
                continue
            n = [len(g) for g in each]
            block, ids = (np.repeat(b.column(c).to_numpy()[first:end], n) for c in ("block", "id"))
            order = np.lexsort((ids, block, gram))
            gram, block, ids = gram[order], block[order], ids[order]
            rows = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(_spelled(gram[rows]), pa.string()), pa.array(block[rows]), pa.ListArray.from_arrays(pa.array(np.append(rows, len(ids)), pa.int32()), pa.array(ids))], names=["gram", "block", "ids"])


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pattern, gram of the literal parts (pattern, low) of patterns."""
    for b in batches:
        rows = [(p, g) for p, t in zip(b.column("pattern").to_pylist(), b.column("low").to_pylist(), strict=True) for g in _spelled(_grams(t))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["pattern", "gram"])


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, path: str) -> None:
    """docs: id, text."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    texts = docs.where("id IS NOT NULL AND text IS NOT NULL").select(F.floor(F.col("id") / BLOCK).alias("block"), F.col("id").cast("long").alias("id"), F.lower("text").alias("low"))
    rows = texts.mapInArrow(_posted, "gram string, block long, ids array<long>").groupBy("gram", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    rows = rows.withColumn("bucket", _bucket(F.col("gram")))
    rows.repartition("bucket", F.floor(F.col("block") / REGION)).sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, patterns: list[str]) -> tuple[DataFrame, list[int]]:
    """(pattern: its place in the list, id) of texts with all trigrams of a pattern, and the places of patterns that have none."""
    parts = [(i, x) for i, p in enumerate(patterns) for x in literals(p)]
    asked = spark.createDataFrame(parts or [(-1, "")], "pattern int, part string").select("pattern", F.lower("part").alias("low")).mapInArrow(_asked, "pattern int, gram string").distinct()
    found = asked.select("pattern", "gram", _bucket(F.col("gram")).alias("bucket")).collect()  # a question's few
    without = sorted(set(range(len(patterns))) - {r["pattern"] for r in found})
    needed = {p: sum(r["pattern"] == p for r in found) for p in range(len(patterns))}
    wanted = spark.createDataFrame([(r["pattern"], r["gram"], needed[r["pattern"]]) for r in found], "pattern int, gram string, needed int")
    rows = spark.read.parquet(path).where(F.col("bucket").isin(sorted({r["bucket"] for r in found})) & F.col("gram").isin(sorted({r["gram"] for r in found})))
    # of a block, ids that all grams of a pattern have; blocks are bounded
    hits = rows.join(F.broadcast(wanted), "gram").select("pattern", "needed", "block", F.explode("ids").alias("id"))
    return hits.groupBy("pattern", "needed", "id").agg(F.count(F.lit(1)).alias("n")).where("n = needed").select("pattern", "id"), without


def matches(spark: SparkSession, path: str, docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern: its place in the list, id) of texts that are ILIKE each pattern. docs: id, text, those of the index."""
    found, without = candidates(spark, path, patterns)

    def like(which: list[int]) -> Column:
        out = F.lit(False)
        for i in which:
            out = F.when(F.col("pattern") == i, F.ilike("text", F.lit(patterns[i]))).otherwise(out)
        return out

    hits = docs.join(found, "id").where(like([i for i in range(len(patterns)) if i not in without])).select("pattern", "id")
    for i in without:  # nothing to look up: all texts are tried
        hits = hits.unionByName(docs.where(F.ilike("text", F.lit(patterns[i]))).select(F.lit(i).alias("pattern"), "id"))
    return hits
