"""Vectors of texts by an encoder that the caller gives; a hashing encoder where there is no model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts are marked as questions or as passages before they are encoded.
PREFIXES = {"query": "query: ", "passage": "passage: "}
Encoder = Callable[[list[str]], np.ndarray]


def hashing(texts: list[str], dim: int = 64) -> np.ndarray:
    """Signed counts of hashed words: equal texts have equal vectors, on every machine."""
    import xxhash

    out = np.zeros((len(texts), dim), np.float32)
    for row, t in zip(out, texts, strict=True):
        for w in re.findall(r"[a-z0-9가-힣]{2,}", t.lower()):
            h = xxhash.xxh64_intdigest(w)
            row[h % dim] += 1 if h >> 63 else -1
    return out


def _encoded(batches: Iterable[pa.RecordBatch], encoder: Encoder, prefix: str, size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in range(0, b.num_rows, size):
            part = b.slice(x, size)
            v = np.asarray(encoder([prefix + t if t is not None else "" for t in part.column("text").to_pylist()]), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.where(norm > 0, v / np.where(norm > 0, norm, 1), 0)
            vec = pa.array([u.tolist() if t is not None else None for u, t in zip(v, part.column("text").to_pylist(), strict=True)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("id"), vec], names=["id", "vec"])


def encoded(texts: DataFrame, kind: str = "passage", encoder: Encoder = hashing, size: int = 16) -> DataFrame:
    """texts: id, text -> id, vec: unit vectors, in batches of ``size`` texts; a null text has none."""
    key = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(partial(_encoded, encoder=encoder, prefix=PREFIXES[kind], size=size), f"id {key}, vec array<float>")
