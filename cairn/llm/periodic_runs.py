"""Runs of repeating words: suffix classes of each document are united by decreasing common prefix.

Suffixes are ordered by prefix doubling in numpy; only those still tied take part in the next round. Neighbours of that order
are united Kruskal's way, longest common prefix first: every class keeps its positions in order, the smaller one goes into
the larger, and two positions that become neighbours at a distance within their common prefix seed a run with that
distance as its period. The common prefix ends the run at the right, so a seed that the word before doesn't
extend is a whole run; no run is found twice, and neighbours never skip a position, so the period is the smallest.

Documents are independent: nothing is shuffled. Suffixes that share fewer words than the shortest wanted run needs are never united.

Edge cases: null, empty and blank texts have no words and no runs and collapse to an empty text; repeated rows are treated
each; rows without an id stay; an empty table gives an empty result; other columns of the input are not looked at. Ties for the
strongest run go to the smallest start, then period.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tables import table
from cairn.llm.textnum import grouped

#: A run has so many words and so many times its period at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4


class _Numbers(dict):
    """Word -> its number, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def tied_suffixes(words: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the order of suffixes and the words they share, ``least`` or more.

    words: a number for each word; end: where the text of each word ends; words of different texts have different numbers.
    """
    n = len(words)
    number, size = np.unique(words, return_inverse=True, return_counts=True)[1:]
    rank = (np.cumsum(size) - size)[number].astype(np.int64)  # how many suffixes stand before the class
    ranks, width, live = [rank], 1, np.flatnonzero(size[number] > 1)
    tied = live if least <= 1 else None
    while len(live):
        behind = live + width
        second = np.where(behind < end[live], rank[np.minimum(behind, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[live]))
        at, first, second = live[order], rank[live][order], second[order]
        old = np.concatenate([[True], first[1:] != first[:-1]])
        new = old | np.concatenate([[True], second[1:] != second[:-1]])
        place = np.arange(len(at))
        rank = rank.copy()
        rank[at] = first + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        ranks.append(rank)
        width *= 2
        alone = new & np.concatenate([new[1:], [True]])
        live = np.sort(at[~alone])
        if width <= least:
            tied = live
    if tied is None or not len(tied):
        return (np.zeros(0, np.int64),) * 3
    tied = tied[np.argsort(rank[tied])]
    left, right = tied[:-1], tied[1:]
    shared = np.zeros(len(left), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = left + shared, right + shared
        fits = (i < end[left]) & (j < end[right])
        shared += np.where(fits & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)]), 1 << k, 0)
    enough = shared >= least
    return left[enough], right[enough], shared[enough]


def seeds(left: np.ndarray, right: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(position, next position, words they share) for positions that become neighbours in a class, by falling shared words."""
    order = np.argsort(-shared, kind="stable")
    of: dict[int, list[int]] = {}  # position -> the class it is in: its positions in order
    for a, b, common in zip(left[order].tolist(), right[order].tolist(), shared[order].tolist(), strict=True):
        small, large = of.get(a), of.get(b)
        if small is None and large is None:
            of[a] = of[b] = [a, b] if a < b else [b, a]
            yield (a, b, common) if a < b else (b, a, common)
            continue
        if small is None or large is None:
            large, p = (large, a) if small is None else (small, b)
            i = bisect_left(large, p)
            if i:
                yield large[i - 1], p, common
            if i < len(large):
                yield p, large[i], common
            large.insert(i, p)
            of[p] = large
            continue
        if len(small) > len(large):
            small, large = large, small
        if len(small) * 8 > len(large):
            large += small
            large.sort()  # two sorted runs: one merge
        else:
            for p in small:
                insort(large, p)
        own = set(small)
        for p in small:
            of[p] = large
            i = bisect_left(large, p)
            if i and large[i - 1] not in own:
                yield large[i - 1], p, common
            if i + 1 < len(large) and large[i + 1] not in own:
                yield p, large[i + 1], common


def runs_of(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period. least_periods: 2 or more."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    n = int(sizes.sum())
    if not n:
        return found
    numbers = _Numbers()
    word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, n)
    text = np.repeat(np.arange(len(texts)), sizes)
    word += text * len(numbers)
    end, first = ends[text], (ends - sizes).tolist()
    # a run of period q shares its length less q: at least the smallest of that over q
    least = min(max(least_words - q, (least_periods - 1) * q) for q in range(1, least_words + 1))
    for i, j, common in seeds(*tied_suffixes(word, end, max(1, least))):
        period = j - i
        if period <= common and period + common >= max(least_words, least_periods * period):
            begin = first[text[i]]
            if i == begin or word[i - 1] != word[j - 1]:
                found[text[i]].append((i - begin, period + common, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains behind its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; runs come by start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ROW = "struct<start: long, length: long, period: long>"


def _found(batches: Iterable[pa.RecordBatch], least_words: int, least_periods: int) -> Iterator[pa.RecordBatch]:
    for rows, texts in grouped(batches):
        words = [t.split() for t in texts]  # at ASCII white space
        runs = runs_of(words, least_words, least_periods)
        flat = np.array(list(chain.from_iterable(runs)), np.int64).reshape(-1, 3)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        best = [strongest(r) for r in runs]
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                pa.array([len(w) for w in words], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(_RUN))),
                pa.array([b and dict(zip(("start", "length", "period"), b, strict=True)) for b in best], _RUN),
                pa.array([kept_words(w, r).decode() for w, r in zip(words, runs, strict=True)], pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), the strongest run (null: none) and the text with each run's first period only."""
    found = partial(_found, least_words=least_words, least_periods=least_periods)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, f"doc_id long, n_words long, runs array<{_ROW}>, strongest {_ROW}, collapsed string")


def _with_repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in grouped(batches):
        out = []
        for key, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
            h = 1 if key is None else zlib.crc32(str(key).encode())
            if h % 10 == 0 and (words := text.split()):
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words[a:] = (words[a : a + p] * (1 + (n - a) // p))[: n - a]
                text = b" ".join(words)
            out.append(text)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


def with_repeats(docs: DataFrame) -> DataFrame:
    """The documents of the query: in a tenth of them, by the CRC-32 of the id, the words from one on repeat a period. No id: as it is."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_with_repeats, "doc_id long, text string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, those of with_repeats with their planted repeats."""
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents", "doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = {c: F.col(f"strongest.{c}") for c in ("start", "length", "period")}
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[v.alias(c) for c, v in best.items()],
        F.expr("strongest.length * 1000L div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
