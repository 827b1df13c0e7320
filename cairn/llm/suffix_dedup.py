"""Removal of repeated passages by suffix arrays of shards, built by external induced sorting.

A byte goes if a string of ``length`` bytes around it also starts in a document with a smaller id.
Every such string has one least k-gram hash (its anchor), the same in all its copies. Anchors
that lie in one document alone can't hold a repeat; the others deal out the text: each run of strings with one
anchor goes to the anchor's shard, so that copies of a string meet in one shard. There a suffix
array of the distinct runs brings equal strings together, and what equals a string of a smaller
document comes back as spans of bytes.

Edge cases: null and empty texts have no bytes; matches never cross documents; rows that share a
doc_id don't remove each other's bytes; a null doc_id neither removes nor loses
bytes; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.suffix_sort import equal_runs
from cairn.llm.tables import bucketed, table, text_or_empty
from cairn.llm.textnum import _power, grouped, mix, span_hashes

#: Bytes of an anchor's k-gram; longest run of strings handed on as one piece.
GRAM, LONGEST = 16, 4096
#: Shards for each shuffle partition: a suffix array takes about a hundred times its text's share of a partition.
FINER = 3
#: Bytes of a shard beyond which its text is kept in a file instead of memory.
MAPPED = 256_000_000
#: Bytes of strings that a task holds before it hands them on.
HELD = 8_000_000


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """For each start of a string of so many bytes, the least hash of its k-grams."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64)
    power, inverse = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    x = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    width, reach = length - GRAM + 1, 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: n - length + 1], x[width - reach : width - reach + n - length + 1])


def _runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """data, and for each run of strings with one anchor: text index, first start, last start, anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    anchors = _anchors(data, length)
    n = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), n)
    starts = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(len(text))
    a = anchors[starts]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(a)]])[: len(first)] - 1
    return data, offsets, text[first], starts[first], starts[last], a[first]


def _anchor_rows(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for rows, texts in grouped(batches):
        _, _, text, _, _, a = _runs(texts, length)
        _, one = np.unique(mix(a ^ mix(text.astype(np.uint64))), return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(a[one].view(np.int64)), rows.column("doc_id").take(pa.array(text[one]))], names=["anchor", "doc_id"])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array([pack(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "row", "packed"])


_STRINGS = "shard int, n long, places binary, texts binary"


def _handed(held: list[tuple[np.ndarray, ...]], parts: list[bytes]) -> pa.RecordBatch:
    """One compressed row for each shard: string, doc_id, row, at and length of its strings (0: a copy of one already sent), and their bytes."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    shard, *places = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(shard, kind="stable")
    shard, places = shard[order], np.stack(places)[:, order]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    stop = np.concatenate([first[1:], [len(shard)]])
    by, rows, texts = order.tolist(), [], []
    for a, b in zip(first.tolist(), stop.tolist(), strict=True):
        rows.append(pack(np.diff(places[:, a:b], prepend=0).tobytes()))  # neighbours' ids and places are near
        texts.append(pack(b"".join([parts[i] for i in by[a:b]])))
    return pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int32()), pa.array(stop - first, pa.int64()), pa.array(rows, pa.binary()), pa.array(texts, pa.binary())], names=[c.split()[0] for c in _STRINGS.split(", ")])


def _string_rows(batches: Iterable[pa.RecordBatch], length: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Runs at anchors that several documents have. A task hands on the bytes of equal runs once."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    sent: set[int] = set()
    held, parts, size = [], [], 0
    for b in batches:
        for x in range(0, b.num_rows, 300):
            part = b.slice(x, 300)
            texts = [unpack(p) for p in part.column("packed").to_pylist()]
            data, offsets, text, first, last, a = _runs(texts, length)
            lists = part.column("anchors")
            n_wanted = np.diff(lists.offsets.to_numpy())
            wanted = lists.flatten().to_numpy().view(np.uint64)
            keep = np.flatnonzero(np.isin(mix(a ^ mix(text.astype(np.uint64))), mix(wanted ^ mix(np.repeat(np.arange(len(texts)), n_wanted).astype(np.uint64)))))
            if not len(keep):
                continue
            text, first, last, a = text[keep], first[keep], last[keep], a[keep]
            # very long runs are cut; each cut keeps whole strings
            times = (last - first) // LONGEST + 1
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            text, a, last, first = (np.repeat(v, times) for v in (text, a, last, first))
            first = first + step * LONGEST
            last = np.minimum(last, first + LONGEST - 1)
            ids = span_hashes(data, first, last + length)
            raw, sizes = data.tobytes(), last + length - first
            for i, (s, f, e) in enumerate(zip(ids.tolist(), first.tolist(), (last + length).tolist(), strict=True)):
                if s in sent:
                    sizes[i] = 0
                    parts.append(b"")
                else:
                    sent.add(s)
                    parts.append(raw[f:e])
            doc, row = (part.column(c).to_numpy()[text] for c in ("doc_id", "row"))
            held.append(((mix(a) >> np.uint64(32)).astype(np.int64) * shards >> 32, ids.view(np.int64), doc, row, first - offsets[text], sizes))
            size += int(sizes.sum()) + 40 * len(sizes)
            if size > HELD:
                yield _handed(held, parts)
                held, parts, size = [], [], 0
            if len(sent) > 300_000:
                sent.clear()
    if held:
        yield _handed(held, parts)


def _shard(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans (doc_id, row, start, end) of one shard that also start in a smaller document."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    with tempfile.TemporaryDirectory() as tmp:
        path, size = os.path.join(tmp, "text"), 0
        seen: set[int] = set()
        starts, lengths, written, waiting = [], [], [], []
        with open(path, "wb") as f:
            for b in batches:
                for n, places, packed in zip(b.column("n").to_pylist(), b.column("places").to_pylist(), b.column("texts").to_pylist(), strict=True):
                    places = np.cumsum(np.frombuffer(unpack(places), np.int64).reshape(5, n), 1)
                    data, stop = (np.frombuffer(unpack(packed), np.uint8) + np.uint8(1)).tobytes(), np.cumsum(places[4])  # UTF-8 has no byte 255
                    own = np.flatnonzero(places[4])
                    for key, e, m in zip(places[0, own].tolist(), stop[own].tolist(), places[4, own].tolist(), strict=True):
                        if key not in seen:
                            seen.add(key)
                            written.append(key), starts.append(size), lengths.append(m)
                            f.write(data[e - m : e] + b"\0")
                            size += m + 1
                    waiting.append(places[:4])
        if not size:
            return
        del seen
        string, doc, row, at = np.concatenate(waiting, 1)
        del waiting
        written, starts, lengths = np.array(written), np.array(starts), np.array(lengths)
        by = np.argsort(written)
        which = by[np.searchsorted(written[by], string)]
        text = np.memmap(path, np.uint8, "r") if size > MAPPED else np.fromfile(path, np.uint8)
        least = np.full(len(starts), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        order = np.argsort(starts)
        begins = starts[order]
        usable = np.zeros(size, bool)
        windows = lengths[order] - length + 1
        opens = np.cumsum(windows) - windows
        usable[np.repeat(begins - opens, windows) + np.arange(windows.sum())] = True

        # least document of each string of ``length`` bytes, by runs of equal neighbours in the suffix array
        lowest = np.full(size, np.iinfo(np.int64).max)
        held_at, held_min = np.zeros(0, np.int64), np.iinfo(np.int64).max

        def settle(positions: np.ndarray, values: np.ndarray, same: np.ndarray) -> None:
            nonlocal held_at, held_min
            positions, values = np.concatenate([held_at, positions]), np.concatenate([np.full(len(held_at), held_min), values])
            head = np.concatenate([np.zeros(len(held_at), bool), ~same])
            if len(head):
                head[0] = True
            first = np.flatnonzero(head)
            mins = np.minimum.reduceat(values, first)
            lowest[positions] = np.repeat(mins, np.diff(np.concatenate([first, [len(head)]])))
            held_at, held_min = positions[first[-1] :], mins[-1]

        for positions, same in equal_runs(text, length, usable, tmp):
            settle(positions, least[order[np.searchsorted(begins, positions, side="right") - 1]], same)

        # runs of one least document within each piece, then the pieces' occurrences in larger documents
        flat = np.flatnonzero(usable)
        piece = np.searchsorted(begins, flat, side="right") - 1
        value = lowest[flat]
        new = np.ones(len(flat), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(flat)]]) - 1
        owner, run_value = piece[first], value[first]
        run_start, run_end = flat[first] - begins[owner], flat[last] - begins[owner] + length
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        count, base = np.bincount(owner, minlength=len(order)), np.searchsorted(owner, np.arange(len(order)))
        mine = rank[which]
        for x in range(0, len(which), 500_000):
            m = mine[x : x + 500_000]
            c = count[m]
            occ = np.repeat(np.arange(x, x + len(m)), c)
            run = np.repeat(base[m], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            good = run_value[run] < doc[occ]
            occ, run = occ[good], run[good]
            yield pa.RecordBatch.from_arrays([pa.array(doc[occ]), pa.array(row[occ]), pa.array(at[occ] + run_start[run]), pa.array(at[occ] + run_end[run])], names=["doc_id", "row", "start", "end"])


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs [start, end) of overlapping or touching spans."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return np.stack([start[new], np.concatenate([reach[new[1:] - 1], reach[-1:]])], 1)


def _cut(batches: Iterable[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for x in range(0, b.num_rows, 500):
            part = b.slice(x, 500)
            texts = [unpack(p) for p in part.column("packed").to_pylist()]
            spans, row = part.column("spans"), part.column("row").to_numpy()
            text = np.repeat(np.arange(len(texts)), np.diff(spans.offsets.to_numpy()))
            of, start, end = (c.to_numpy() for c in spans.flatten().flatten())
            own = of == row[text]  # another row with this doc_id has the others
            if not own.any():
                continue
            # texts are laid out with gaps, so that no span touches another text's
            opens = np.cumsum([0, *(len(t) + 1 for t in texts)])
            m = merged(start[own] + opens[text[own]], end[own] + opens[text[own]])
            place = np.searchsorted(opens, m[:, 0], side="right") - 1
            has, first, n_spans = np.unique(place, return_index=True, return_counts=True)
            m -= opens[place][:, None]
            removed = np.add.reduceat(m[:, 1] - m[:, 0], first)
            kept = []
            for i, f, n in zip(has.tolist(), first.tolist(), n_spans.tolist(), strict=True):
                edges = [0, *m[f : f + n].ravel().tolist(), len(texts[i])]
                kept.append(b"".join([texts[i][s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(row[has], pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], names=["row", "n_removed", "n_spans", "kept"])


def _row(doc_id: str = "doc_id"):
    """Identity of a document for joins: rows equal in id and text share it."""
    return F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.col(doc_id).cast("long"), text_or_empty()))


def cut_repeats(docs: DataFrame, length: int = 50, as_text: bool = False) -> DataFrame:
    """row, n_removed, n_spans, kept (bytes, or text without cut characters) of the documents that lose bytes; see _row for the key."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), _row().alias("row"), text_or_empty().alias("text"))
    every = Window.partitionBy("anchor")
    anchors = rows.mapInArrow(partial(_anchor_rows, length=length), "anchor long, doc_id long")
    shared = anchors.withColumns({"least": F.min("doc_id").over(every), "most": F.max("doc_id").over(every)}).where("least < most")
    shared = shared.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))  # as many as a document has
    # in buckets, so that cutting needs no second shuffle of the texts
    some = bucketed(rows.mapInArrow(_packed, "doc_id long, row long, packed binary").join(shared, "doc_id").dropDuplicates(["doc_id", "row"]), "texts_with_repeats", "doc_id", placed=True)
    strings = some.mapInArrow(partial(_string_rows, length=length, shards=FINER * n), _STRINGS)
    spans = strings.repartitionById(FINER * n, "shard").mapInArrow(partial(_shard, length=length), "doc_id long, row long, start long, end long")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("row", "start", "end")).alias("spans"))
    return some.select("doc_id", "row", "packed").join(spans, "doc_id").mapInArrow(partial(_cut, as_text=as_text), f"row long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cut = cut_repeats(docs).select("row", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = text_or_empty()
    whole = docs.select("doc_id", _row().alias("row"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole_sha256"))
    zero = F.lit(0).cast("long")
    return whole.join(cut, "row", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
