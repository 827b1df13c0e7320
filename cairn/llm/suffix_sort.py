"""External induced suffix sorting of a set of strings, in numpy, with queues on disk.

A shard's strings are laid out one behind another, each closed by the byte 0. Left-most S-type
(LMS) suffixes are sorted first; the order of all others is induced: a suffix leaves a queue
in order and puts the one that begins a byte earlier into the queue of its first byte. With one
first-in-first-out queue per first byte, extraction by (byte, order of arrival) is a priority queue. Queues move
to a file when what they hold passes a limit, the laid-out text can be a memory-mapped
file, and sorted suffixes are handed on in batches. Types, LMS suffixes and their order are arrays in memory, tens of
bytes for each byte of text: a shard must fit.

The order is that of the first ``depth`` bytes at least; that is all that repeats of this length need, and it
bounds the rounds in which LMS suffixes are told apart.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Values that the queues of a sort hold in memory.
IN_MEMORY = 8_000_000
#: Suffixes of a batch.
BATCH = 400_000


class Queues:
    """One first-in-first-out queue of positions per byte, spilled together to one file each."""

    def __init__(self, folder: str, name: str, limit: int = IN_MEMORY):
        self.folder, self.name, self.limit = folder, name, limit
        self.held: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.spilled: list[int] = [0] * 256
        self.size = 0

    def _path(self, c: int) -> str:
        return os.path.join(self.folder, f"{self.name}-{c}")

    def push(self, chars: np.ndarray, positions: np.ndarray) -> None:
        """Append positions to the queues of their first bytes, keeping their order."""
        if not len(positions):
            return
        order = np.argsort(chars, kind="stable")
        positions, counts = positions[order], np.bincount(chars, minlength=256)
        stop = np.cumsum(counts)
        for c in np.flatnonzero(counts).tolist():
            self.held[c].append(positions[stop[c] - counts[c] : stop[c]])
        self.size += len(positions)
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        for c, parts in enumerate(self.held):
            if parts:
                with open(self._path(c), "ab") as f:
                    for p in parts:
                        f.write(p.tobytes())
                        self.spilled[c] += len(p)
                self.held[c] = []
        self.size = 0

    def pop(self, c: int) -> Iterator[np.ndarray]:
        """What the queue of c holds now, in batches; what is pushed meanwhile stays for the next call."""
        parts, on_disk = self.held[c], self.spilled[c]
        self.held[c], self.spilled[c] = [], 0
        self.size -= sum(len(p) for p in parts)
        if on_disk:
            os.replace(self._path(c), path := self._path(c) + "-read")
            with open(path, "rb") as f:
                while len(x := np.fromfile(f, np.int64, BATCH)):
                    yield x
            os.remove(path)
        if parts:
            yield np.concatenate(parts)


def _types(text: np.ndarray) -> np.ndarray:
    """True for S-type: the suffix is smaller than the one that begins a byte later."""
    n = len(text)
    grows = np.zeros(n, np.int8)
    grows[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    grows[-1] = -1
    at = np.where(grows != 0, np.arange(n, dtype=np.int32 if n < 2**31 - 1 else np.int64), n)
    return grows[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _overlapping(text: np.ndarray, kind: str) -> np.ndarray:
    """A number of this kind at each byte that has enough bytes behind it, over the same memory."""
    size = np.dtype(kind).itemsize
    return np.ndarray(max(0, len(text) - size + 1), kind, text, strides=(1,))


def _block_keys(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number (zeros behind the end)."""
    key, eights = np.zeros(len(at), np.uint64), _overlapping(text, ">u8")
    inside = at < len(eights)
    key[inside] = eights[at[inside]]
    for i in np.flatnonzero(~inside).tolist():  # as few as begin near the end
        key[i] = int.from_bytes(text[at[i] : at[i] + 8].tobytes().ljust(8, b"\0"), "big")
    return key


def _sorted_lms(text: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """LMS suffixes in the order of their first ``depth`` bytes: rounds of 8 bytes over those that are still tied."""
    order = lms
    rank = np.zeros(len(lms), np.int64)
    for reach in range(0, depth, 8):
        tied = np.zeros(len(order), bool)
        same = rank[1:] == rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = _block_keys(text, order[at] + reach)
        by = np.lexsort((key, rank[at])) if reach else np.argsort(key)  # at first all ranks are equal
        order[at], key = order[at[by]], key[by]
        new = np.ones(len(at), bool)
        new[1:] = (rank[at][1:] != rank[at][:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        rank[at] = at[first][np.cumsum(new) - 1]
    return order


def suffixes(text: np.ndarray, depth: int, folder: str | None = None, limit: int = IN_MEMORY) -> Iterator[np.ndarray]:
    """All positions of text in descending order of their suffixes, in batches."""
    if not len(text):
        return
    with tempfile.TemporaryDirectory(dir=folder) as tmp:
        small = _types(text)
        lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        lms = _sorted_lms(text, lms, depth)
        left, large = Queues(tmp, "lms", limit), Queues(tmp, "l", limit)
        for x in range(0, len(lms), BATCH):
            part = lms[x : x + BATCH]
            left.push(text[part], part)
        del lms

        def before(batch: np.ndarray, s_type: bool) -> np.ndarray:
            j = batch[batch > 0] - 1
            return j[small[j] == s_type]

        # ascending: L-types, induced by L-types and LMS suffixes before them; the text's end comes first
        ends = np.array([len(text) - 1])
        large.push(text[ends], ends)
        kept = Queues(tmp, "l-sorted", limit)
        for c in range(256):
            while large.held[c] or large.spilled[c]:
                for batch in large.pop(c):
                    kept.push(np.full(len(batch), c, np.uint8), batch)
                    j = before(batch, False)
                    large.push(text[j], j)
            for batch in left.pop(c):
                j = before(batch, False)
                large.push(text[j], j)
        # descending: S-types, induced by what is larger
        little = Queues(tmp, "s", limit)
        for c in range(255, -1, -1):
            while little.held[c] or little.spilled[c]:
                for batch in little.pop(c):
                    yield batch
                    j = before(batch, True)
                    little.push(text[j], j)
            parts = list(kept.pop(c))
            for batch in reversed(parts):
                batch = batch[::-1]
                yield batch
                j = before(batch, True)
                little.push(text[j], j)


def equal_runs(text: np.ndarray, length: int, usable: np.ndarray, folder: str | None = None, limit: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Usable positions in suffix order, in batches, and for each whether ``length`` bytes equal those of the one before.

    Neighbours' common-prefix values, bounded by length, are taken as the suffixes leave the queues.
    """
    last = None
    blocks = _overlapping(text, "<u8" if length >= 8 else "u1")
    reach = sorted({*range(0, length - blocks.itemsize + 1, blocks.itemsize), length - blocks.itemsize})
    for batch in suffixes(text, length, folder, limit):
        for x in range(0, len(batch), BATCH // 8):
            part = batch[x : x + BATCH // 8]
            part = part[usable[part]]
            if not len(part):
                continue
            chain = part if last is None else np.concatenate([[last], part])
            same = np.ones(len(chain) - 1, bool)
            for r in reach:
                block = blocks[chain + r]
                same &= block[1:] == block[:-1]
            yield part, np.concatenate([[False], same]) if last is None else same
            last = part[-1]
