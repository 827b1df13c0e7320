"""Names of a table found in texts, as they stand but for case: which entities a text mentions, and how often.

Names up to a size go to every worker as one Aho-Corasick automaton, which reads each text once for all of them. Larger tables of names aren't
broadcast: texts give hashed windows of every length that names have, and windows meet names by a join on length and hash.
A bitmap of bounded size keeps windows back that no name can have: of every place a text is asked for the beginnings of names first, their
greatest power of two of bytes, and only where one begins for whole names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of names for one automaton; shorter names than SHORTEST characters are no names.
MOST_BYTES, SHORTEST = 8 << 20, 2
#: Words of 64 bits in the bitmap of window hashes, as a power of two: at least, and at most however many names there are.
WORDS, MOST_WORDS = 20, 22
#: Bits of its word that a hash sets.
PROBES = 4
#: Bytes of texts that are hashed at once, whole texts.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15

_workers: dict[str, object] = {}


def names_of(table: DataFrame) -> DataFrame:
    """Distinct (entity, name) in lower case. table: entity, name."""
    low = F.lower("name")
    return table.select("entity", low.alias("name")).where(F.length("name") >= SHORTEST).distinct()


def _automaton(key: str, names: list[str]):
    import ahocorasick

    if key not in _workers:
        _workers.clear()  # one table of names at a time
        found = ahocorasick.Automaton()
        for n in names:
            found.add_word(n, n)
        found.make_automaton()
        _workers[key] = found
    return _workers[key]


def _spotted(batches: Iterable[pa.RecordBatch], names, key: str) -> Iterator[pa.RecordBatch]:
    words = _automaton(key, names.value)
    for b in batches:
        out = [(i, n, k) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for n, k in Counter(n for _, n in words.iter(t)).items()]
        if out:
            ids, found, counts = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.types[0]), pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=["id", "name", "n"])


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (byte + 1) * base ** place up to each place, and the powers that move a stretch of them to place 0, both modulo 2 ** 64."""
    if len(_powers[0]) <= len(data):
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * len(data) + 1, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(data)], out=sums[1:])
    return sums, _powers[1][: len(data) + 1]


def _hash(stretch: np.ndarray, back: np.ndarray) -> np.ndarray:
    out = stretch * back
    return out ^ (out >> np.uint64(29))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit polynomial hashes of all windows of ``size`` bytes."""
    sums, back = _sums(data)
    return _hash(sums[size:] - sums[:-size], back[: len(data) - size + 1])


def _place(h: np.ndarray, size: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the bitmap for hashes of windows (beginnings of names: size negative), and its bits."""
    mixed = (h ^ np.uint64(size * 0x5851F42D4C957F2D % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    at, mask = mixed >> np.uint64(64 - words), np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << (mixed >> np.uint64(64 - words - 6 * (i + 1)) & np.uint64(63))
    return at.astype(np.int64), mask


def _known(h: np.ndarray, size: int, known: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap may have."""
    at, mask = _place(h, size, len(known).bit_length() - 1)
    return np.flatnonzero(known[at] & mask == mask)


def _beginning(size: int) -> int:
    return 1 << size.bit_length() - 1


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts (null: none), and where each begins, with the end of the last."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def _hashed_names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, ends = _bytes_of(b.column("name"))
        sums, back = _sums(data)
        h = _hash(sums[ends[1:]] - sums[ends[:-1]], back[ends[:-1]])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(ends).astype(np.int32)), pa.array(h.view(np.int64))], names=[*b.schema.names, "size", "h"])


def _hashed_beginnings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size and h of names and, with a negative size, of their beginnings."""
    for b in batches:
        data, ends = _bytes_of(b.column("name"))
        sums, back = _sums(data)
        size = b.column("size").to_numpy(zero_copy_only=False)
        short = np.array([_beginning(x) for x in size.tolist()], np.int64)
        h = _hash(sums[ends[:-1] + short] - sums[ends[:-1]], back[ends[:-1]]).view(np.int64)
        both = np.unique(np.stack([-short, h]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(size, both[0]).astype(np.int32)), pa.array(np.append(b.column("h").to_numpy(zero_copy_only=False), both[1]))], names=["size", "h"])


def _bitmap(batches: Iterable[pa.RecordBatch], words: int = WORDS) -> Iterator[pa.RecordBatch]:
    """Words of the bitmap with the bits that the hashes of a partition set."""
    bits = np.zeros(1 << words, np.uint64)
    for b in batches:
        for size in set(b.column("size").to_pylist()):
            h = b.filter(pc.equal(b.column("size"), size)).column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            np.bitwise_or.at(bits, *_place(h, size, words))
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["word", "bits"])


def _windows(batches: Iterable[pa.RecordBatch], sizes: list[int], bits) -> Iterator[pa.RecordBatch]:
    """Windows of the sizes that the bitmap lets through: id, size, h, the window itself, its count."""
    known, classes = bits.value, defaultdict(list)
    for size in sizes:
        classes[_beginning(size)].append(size)
    for b in batches:
        whole, borders = _bytes_of(b.column(1))
        first = 0
        while first < b.num_rows:
            end = max(first + 1, int(np.searchsorted(borders, borders[first] + CHUNK, "right")) - 1)
            data, ends, found = whole[borders[first] : borders[end]], borders[first + 1 : end + 1] - borders[first], Counter()
            sums, back = _sums(data)
            for short, own in classes.items():
                if short > len(data):
                    continue
                at = _known(_hash(sums[short:] - sums[:-short], back[: len(data) - short + 1]), -short, known)
                row = np.searchsorted(ends, at, "right")
                for size in own:
                    fits = np.flatnonzero(at + size <= ends[row])
                    begin = at[fits]
                    h = _hash(sums[begin + size] - sums[begin], back[begin])
                    for x in _known(h, size, known).tolist():
                        found[int(row[fits[x]]), size, int(h[x].view(np.int64)), data[begin[x] : begin[x] + size].tobytes()] += 1
            if found:
                rows, size, h, window = zip(*found, strict=True)
                ids = b.column(0).take(pa.array(np.array(rows) + first))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int32()), pa.array(h, pa.int64()), pa.array(window, pa.binary()), pa.array(list(found.values()), pa.int64())], names=["id", "size", "h", "window", "n"])
            first = end


def mentions(texts: DataFrame, table: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """id, entity, n: texts (id, text) and the entities (entity, name) whose names are in them, occurrences of all their names together.

    Occurrences may overlap. Null texts, null names and names of one character give nothing.
    """
    spark, names = texts.sparkSession, names_of(table)
    kind = texts.schema["id"].dataType.simpleString()
    low = texts.select("id", F.lower("text").alias("text"))
    size = names.select("name").distinct().agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]  # many entities may share a name
    if size <= most:  # checked just now, so the list that is sent has a bound
        distinct = sorted({r["name"] for r in names.select("name").distinct().toLocalIterator()})
        sent, key = spark.sparkContext.broadcast(distinct), str(hash(tuple(distinct)))
        hits = low.mapInArrow(partial(_spotted, names=sent, key=key), f"id {kind}, name string, n long")
        return hits.join(names, "name").groupBy("id", "entity").agg(F.sum("n").alias("n"))
    hashed = names.mapInArrow(_hashed_names, f"entity {names.schema['entity'].dataType.simpleString()}, name string, size int, h long")
    sizes = sorted(r[0] for r in hashed.select("size").distinct().collect())  # lengths of names
    most_words = min(MOST_WORDS, max(WORDS, (hashed.count() - 1).bit_length()))
    words = hashed.select("name", "size", "h").mapInArrow(_hashed_beginnings, "size int, h long").mapInArrow(partial(_bitmap, words=most_words), "word long, bits long")
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # a bitmap of a set size
    known = np.zeros(1 << most_words, np.uint64)
    known[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    found = low.mapInArrow(partial(_windows, sizes=sizes, bits=spark.sparkContext.broadcast(known)), f"id {kind}, size int, h long, window binary, n long")
    return found.join(hashed, ["size", "h"]).where(F.col("window") == F.col("name").cast("binary")).groupBy("id", "entity").agg(F.sum("n").alias("n"))
