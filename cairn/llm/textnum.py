"""Words and rolling hashes of whole texts in numpy, over groups of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts handled at once (one text is never cut).
GROUP = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, 0 to n."""
    if len(_powers[0]) <= n:
        size = n + 1 + n // 4
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    power, inverse = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: ASCII white space as the contracts count it.
SPACE = _table(b" \t\n\x0b\x0c\r")
#: Everything ASCII but letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Words:
    """The words of a group of texts: data (one space behind each text), starts, ends and the index of each one's text."""

    def __init__(self, texts: list[bytes], breaks: np.ndarray = SPACE, lower: bool = True):
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.data = _LOWER[data] if lower else data
        self.n_texts, self.offsets = len(texts), np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        inside = np.concatenate([[False], ~breaks[data]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.text = np.searchsorted(self.offsets, self.starts, side="right") - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def per_text(self, values: np.ndarray | None = None) -> np.ndarray:
        """Sum of a value of each word (or their number) for each text."""
        return np.bincount(self.text, values, self.n_texts)

    def per_text_bytes(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte for each text."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(sums[self.offsets])


def grouped(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = GROUP) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in groups of about ``size`` bytes, with their texts in UTF-8 (null: empty)."""
    for b in batches:
        texts = [t or b"" for t in b.column(text).cast(pa.binary()).to_pylist()]
        first, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= size or i == len(texts) - 1:
                yield b.slice(first, i + 1 - first), texts[first : i + 1]
                first, held = i + 1, 0
