"""Byte-level BPE in numpy: padded matrices, one row per distinct piece, bucketed by length.

In each round every row merges its leftmost pair of least rank; pairs are looked up in a
hash table, rows are compacted, and rows without a pair left leave the matrix. Decoding
joins the bytes of the ids.

Edge cases: null and empty texts have no ids; repeated rows are encoded each; an empty table
gives an empty result; other columns of the input are not looked at. Pieces over WIDEST bytes
are merged with a heap instead of a matrix (n log n steps), with equal ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tables import table
from cairn.llm.tokens import PieceEncoder, as_ids, grouped

#: No pair; larger than any rank.
NONE = np.int32(2**31 - 1)
WIDEST = 512
#: Cells of a matrix.
CELLS = 2_000_000


class PairTable:
    """Open-addressing hash table from a pair of ids to the id (and rank) of their union."""

    def __init__(self, tokens: dict[bytes, int]):
        left, right, to = [], [], []
        for t, rank in tokens.items():
            for i in range(1, len(t)):
                if (a := tokens.get(t[:i])) is not None and (b := tokens.get(t[i:])) is not None:
                    left.append(a), right.append(b), to.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.to, self.probes = np.full(1 << self.bits, ~np.uint64(0)), np.full(1 << self.bits, NONE), 0
        to, slot = np.array(to, np.int32), self._slot(keys)
        while len(keys):  # those that find a free slot settle, the others look at the next
            free = np.flatnonzero(self.keys[slot] == ~np.uint64(0))
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.to[slot[won]] = keys[won], to[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, to, slot = keys[rest], to[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(27))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none. Negative ids (padding) are in no pair."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint32).astype(np.uint64)
        out, at, slot = np.full(keys.shape, NONE), np.flatnonzero((a >= 0) & (b >= 0)), None
        keys = keys.ravel()[at]
        slot, flat = self._slot(keys), out.ravel()
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys
            flat[at[hit]] = self.to[slot[hit]]
            go = ~hit & (found != ~np.uint64(0))
            if not go.any():
                break
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)


def merge_rows(m: np.ndarray, pairs: PairTable) -> list[np.ndarray]:
    """Ids of each row of a matrix of single-byte ids, padded with -1."""
    out: list[np.ndarray | None] = [None] * len(m)
    rows = np.arange(len(m))
    ranks = pairs.ranks(m[:, :-1], m[:, 1:])
    while len(rows):
        j = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        least = ranks[np.arange(len(rows)), j] if ranks.shape[1] else np.full(len(rows), NONE)
        done = least == NONE
        if done.any():
            for r, ids in zip(rows[done].tolist(), m[done], strict=True):
                out[r] = ids[ids >= 0]
            rows, m, ranks, j, least = (x[~done] for x in (rows, m, ranks, j, least))
            if not len(rows):
                break
        n, width = m.shape
        source = np.arange(width - 1) + (np.arange(width - 1) > j[:, None])
        m, at = np.take_along_axis(m, source, 1), np.arange(n)
        m[at, j] = least
        # ranks of the pairs beside the merged one are looked up again, the others move with their ids
        ranks = np.take_along_axis(ranks, np.minimum(source[:, : width - 2], width - 2), 1)
        before, behind = np.flatnonzero(j > 0), np.flatnonzero(j < width - 2)
        ranks[before, j[before] - 1] = pairs.ranks(m[before, j[before] - 1], m[before, j[before]])
        ranks[behind, j[behind]] = pairs.ranks(m[behind, j[behind]], m[behind, j[behind] + 1])
        longest = int((m >= 0).sum(1).max())
        m, ranks = m[:, :longest], ranks[:, : max(0, longest - 1)]
    return out


def merge_long(ids: list[int], pair: dict[tuple[int, int], int]) -> list[int]:
    """The same order of merges for one long piece, from a heap of (rank, place)."""
    left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pair.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    ids = list(ids)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        k = right[i]
        if ids[i] != a or k < 0 or ids[k] != b:
            continue
        ids[i], ids[k], right[i] = r, -1, right[k]
        if right[k] >= 0:
            left[right[k]] = i
        for x in (left[i], i):
            if x >= 0 and right[x] >= 0 and (s := pair.get((ids[x], ids[right[x]]))) is not None:
                heapq.heappush(heap, (s, x, ids[x], ids[right[x]]))
    return [x for x in ids if x >= 0]


class Bpe:
    """Encoder and decoder for a file of ranks and a pattern of pieces."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs, self.pattern = PairTable(self.tokens), regex.compile(pattern)
        self.single = np.array([self.tokens[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = {i: t for t, i in self.tokens.items()}
        self._pair_dict: dict[tuple[int, int], int] | None = None

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of one byte at least."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        for k in range(max(0, int(lengths.max(initial=0)) - 1).bit_length() + 1):
            low, high = (1 << k >> 1) + (k > 0), 1 << k
            same = np.flatnonzero((lengths >= low) & (lengths <= min(high, WIDEST)))
            for x in range(0, len(same), max(1, CELLS // high)):
                part = same[x : x + max(1, CELLS // high)]
                width = int(lengths[part].max())
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part.tolist()), np.uint8).reshape(len(part), width)
                m = np.where(np.arange(width) < lengths[part][:, None], self.single[raw], np.int32(-1))
                for i, ids in zip(part.tolist(), merge_rows(m, self.pairs), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(lengths > WIDEST).tolist():
            if self._pair_dict is None:
                used = self.pairs.to != NONE
                self._pair_dict = {(int(k >> np.uint64(32)), int(k & np.uint64(0xFFFFFFFF))): int(r) for k, r in zip(self.pairs.keys[used], self.pairs.to[used], strict=True)}
            out[i] = np.array(merge_long([int(self.single[b]) for b in pieces[i]], self._pair_dict), np.int32)
        return out

    def encode_new(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; each distinct match of the pattern is encoded once."""
        found = [self.pattern.findall(t) for t in texts]
        place: dict[str, int] = {}
        for f in found:
            for x in f:
                place.setdefault(x, len(place))
        ids = [x.tobytes() for x in self.encode_pieces([x.encode() for x in place])]
        for f in found:
            yield b"".join([ids[place[x]] for x in f])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_workers: dict[tuple[str, str], tuple[Bpe, PieceEncoder]] = {}


def _encoder(path: str, pattern: str) -> tuple[Bpe, PieceEncoder]:
    if (path, pattern) not in _workers:
        bpe = Bpe(path, pattern)
        _workers[path, pattern] = bpe, PieceEncoder(bpe.encode_new, spaced=True)
    return _workers[path, pattern]


def _encoded(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    _, encoder = _encoder(path, pattern)
    for rows, texts in grouped(batches):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(encoder.encode(texts), pa.binary())], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of each whole text as little-endian unsigned 32-bit integers."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_encoded, path=path, pattern=pattern), "doc_id long, ids binary")


def _decoded(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe, _ = _encoder(path, pattern)
    for b in batches:
        for x in range(0, b.num_rows, 200):
            part = b.slice(x, 200)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array([bpe.decode(as_ids(i)) for i in part.column("ids").to_pylist()], pa.binary())], names=["doc_id", "ids", "bytes"])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds the bytes that the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, path=path, pattern=pattern), "doc_id long, ids binary, bytes binary")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, data = b.column("ids").to_pylist(), b.column("bytes").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in data])],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode(table(spark, sf_dir, "documents", "doc_id", "text"), *how)
    return decode(encoded, *how).mapInArrow(_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
