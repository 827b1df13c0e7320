"""Order-preserving packing of documents into token windows by dynamic programming.

The ids of a partition's documents form one stream in the order of its rows. Window ends
may lie at document ends (free), sentence ends (a penalty for cutting a document) and, only where
these lie more than a window apart, at a coarse grid (a larger penalty). With f(j) the
least cost of a prefix that ends at cut j,

    f(j) = penalty(j) + WINDOW - pos(j) + min { f(i) + pos(i) : pos(j) - pos(i) <= WINDOW },

a sliding minimum, kept in a monotone queue: one step for each cut. No row leaves its
partition, so packing needs no shuffle; a partition ends with one window that is not full.

Edge cases: null and empty texts are documents of the end id alone; repeated rows and ids are
packed each on its own; texts longer than a window are cut into pieces; an empty table
gives no pieces; other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tables import table
from cairn.llm.tokens import grouped, library_encoder

WINDOW = 1024
#: Costs in padding ids: of a cut at a sentence's end, and at the grid.
SENTENCE, HARD, GRID = 2, 64, 256
#: Ids of documents packed at once; the stream may end a window early after so many.
BLOCK = 1 << 20

_ends: dict[str, np.ndarray] = {}


def sentence_ends(path: str) -> np.ndarray:
    """For each id whether its characters end a sentence or a line."""
    if path not in _ends:
        with open(path) as f:
            vocab = json.load(f)["model"]["vocab"]
        flags = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            flags[i] = bool(re.search("[.!?Ċ]$", piece))  # U+010A stands for a line end in byte-level vocabularies
        _ends[path] = flags
    return _ends[path]


def cuts(doc_ends: np.ndarray, soft: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ends of the windows over a stream that ends at doc_ends[-1]; soft: ends of sentences."""
    pos = np.union1d(doc_ends, soft)
    free = np.isin(pos, doc_ends)
    gaps = np.diff(pos, prepend=0)
    grid = np.concatenate([np.zeros(0, np.int64), *(np.arange(p - g + GRID, p, GRID) for p, g in zip(pos[gaps > window], gaps[gaps > window], strict=True))])
    at = np.concatenate([pos, grid])
    cost = np.concatenate([np.where(free, 0, SENTENCE), np.full(len(grid), HARD)])
    order = np.argsort(at, kind="stable")
    at, cost = at[order].tolist(), cost[order].tolist()
    back, queue = [0] * len(at), deque([(0, 0, -1)])  # (f + pos, pos, index), least first
    for j, (p, c) in enumerate(zip(at, cost, strict=True)):
        while p - queue[0][1] > window:
            queue.popleft()
        best, _, back[j] = queue[0]
        g = best + c + window  # f(j) + pos(j)
        while queue and queue[-1][0] > g:
            queue.pop()
        queue.append((g, p, j))
    out, j = [], len(at) - 1
    while j >= 0:
        out.append(at[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(docs: list[int | None], ids: list[np.ndarray], sizes: list[np.ndarray], ends: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
    stream, lengths = np.concatenate(ids), np.concatenate(sizes)
    doc_ends = np.cumsum(lengths)
    windows = cuts(doc_ends, np.flatnonzero(ends[stream]) + 1)
    stop = np.union1d(doc_ends, windows)
    start = np.concatenate([[0], stop[:-1]])
    doc, seq = np.searchsorted(doc_ends, start, side="right"), np.searchsorted(windows, start, side="right")
    begins, opens = doc_ends - lengths, np.concatenate([[0], windows[:-1]])
    view = memoryview(stream.astype("<u4").tobytes())
    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
    cols = [pa.array(docs, pa.int64()).take(pa.array(doc)), start - begins[doc], stop - start, np.array(crc, np.int64), lengths[doc], first + seq, start - opens[seq]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in cols], names=[x.split()[0] for x in _SCHEMA.split(", ")]), len(windows)


def _packed(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, ends = library_encoder(path, spaced=True), sentence_ends(path)
    first = TaskContext.get().partitionId() << 40
    docs, ids, sizes, size = [], [], [], 0
    for rows, texts in grouped(batches):
        docs += rows.column("doc_id").to_pylist()
        stream, upto = encoder.encode_joined(texts, end_id)
        ids.append(stream), sizes.append(np.diff(upto, prepend=0))
        size += len(stream)
        if size >= BLOCK:
            out, n = _pieces(docs, ids, sizes, ends, first)
            yield out
            docs, ids, sizes, size, first = [], [], [], 0, first + n
    if docs:
        yield _pieces(docs, ids, sizes, ends, first)[0]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """One row per piece of a document: where it starts there, and which window holds it at which offset."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_packed, path=tokenizer, end_id=end_id), _SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
