"""Quality by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives P and unlabelled web text U train a small network that minimises

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)),

the risk of a classifier as estimated without any negative example; the bracket is kept from
falling below zero, where it would only measure overfitting. The class prior is estimated
from the labelled training rows.

Fitting takes at most MOST positives and MOST unlabelled rows (those of least hash, documented
bound); features are computed for every whole text, scores for every row. Edge cases: null and
empty texts have the features of no words; repeated rows are scored each; without
positives every score is the prior; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tables import least_hashed, stored, table
from cairn.llm.textnum import Words, grouped, mix
from cairn.llm.toxicity import fold

MOST = 20_000
HIDDEN, STEPS, RATE = 24, 600, 0.02
#: Weight decay.
DECAY = 1e-4
FEATURES = ("words", "word_length", "symbols", "pipes", "exclamations", "upper", "digits", "high_bytes", "same_as_before", "distinct", "repeated_windows", "lines", "line_length", "stops", "commas", "short_words")


def features(texts: list[bytes]) -> np.ndarray:
    """Shape of each text: logarithms of counts, and shares of its words or bytes."""
    words, raw = Words(texts), Words(texts, lower=False)
    n, size = words.per_text(), np.array([len(t) for t in texts], float)
    per_word, per_byte = np.maximum(n, 1), np.maximum(size, 1)
    data = raw.data

    def count(test: np.ndarray) -> np.ndarray:
        return raw.per_text_bytes(test)

    def chars(x: bytes) -> np.ndarray:
        return count(np.isin(data, np.frombuffer(x, np.uint8)))

    h = words.hashes()
    lengths = (words.ends - words.starts).astype(float)
    same = np.zeros(len(h))
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (words.text[1:] == words.text[:-1])
    of = mix((words.text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))  # far from the hash of any short word
    key = mix(h ^ of)
    distinct = np.bincount(words.text[np.unique(key, return_index=True)[1]], minlength=len(texts))
    window = np.zeros(len(texts))
    if len(h) > 4:
        g = sum(np.roll(h, -i) * np.uint64(2 * i + 3) for i in range(5))[:-4]
        inside = words.text[4:] == words.text[:-4]
        g, t = mix(g ^ of[:-4])[inside], words.text[:-4][inside]
        _, first = np.unique(g, return_index=True)
        window = np.bincount(t, minlength=len(texts)) - np.bincount(t[first], minlength=len(texts))
    lines = chars(b"\n") + 1
    upper, letters = count((data >= 65) & (data <= 90)), count(((data | 32) >= 97) & ((data | 32) <= 122))
    cols = [
        np.log1p(n), lengths_mean(words, lengths, per_word), np.log1p(50 * chars(b"#*$%&<>") / per_word), np.log1p(50 * chars(b"|") / per_word), np.log1p(50 * chars(b"!") / per_word),
        upper / np.maximum(letters, 1), count((data >= 48) & (data <= 57)) / per_byte, count(data >= 128) / per_byte, words.per_text(same) / per_word, distinct / per_word,
        window / per_word, np.log1p(lines), np.log1p(n / lines), chars(b".") / per_word, chars(b",") / per_word, words.per_text((lengths <= 2).astype(float)) / per_word,
    ]
    return np.stack([np.asarray(c, float) for c in cols], 1)


def lengths_mean(words: Words, lengths: np.ndarray, per_word: np.ndarray) -> np.ndarray:
    return words.per_text(lengths) / per_word


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in grouped(batches):
        f = features(texts)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(f[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *FEATURES])


class PuNet:
    """One hidden layer over standardised features."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 1):
        both = np.vstack([positive, unlabelled])
        self.mean, self.scale, self.prior = both.mean(0), both.std(0) + 1e-6, prior
        rng = np.random.default_rng(seed)
        d = both.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        xp, xu = self._scaled(positive), self._scaled(unlabelled)
        first, second = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        for step in range(1, STEPS + 1):
            for i, g in enumerate(self.gradients(xp, xu)):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                self.p[i] = self.p[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def negative_risk(self, xp: np.ndarray, xu: np.ndarray) -> float:
        """Unbiased estimate of the part that negatives have in the risk; below 0 it is overfitted."""
        zp, zu = self._forward(xp)[0], self._forward(xu)[0]
        return np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()

    def risk(self, xp: np.ndarray, xu: np.ndarray) -> float:
        """Risk of the step at hand (logistic loss, with the weight decay): whole, or minus the overfitted part alone."""
        negative = self.negative_risk(xp, xu)
        decay = DECAY / 2 * sum((w * w).sum() for w in self.p)
        return decay + (negative + self.prior * np.logaddexp(0, -self._forward(xp)[0]).mean() if negative >= 0 else -negative)

    def gradients(self, xp: np.ndarray, xu: np.ndarray) -> list[np.ndarray]:
        zp, hp = self._forward(xp)
        zu, hu = self._forward(xu)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        if np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean() >= 0:
            gp, gu = (self.prior * (sp - 1) - self.prior * sp) / len(xp), su / len(xu)
        else:  # step back from the overfitted part
            gp, gu = self.prior * sp / len(xp), -su / len(xu)
        return [a + b + DECAY * w for a, b, w in zip(self._backward(xp, hp, gp), self._backward(xu, hu, gu), self.p, strict=True)]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p[0] + self.p[1])
        return np.clip(h @ self.p[2] + self.p[3], -30, 30), h

    def _backward(self, x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = g[:, None] * self.p[2] * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._forward(self._scaled(x))[0]))


def _scored(batches: Iterable[pa.RecordBatch], net) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.stack([b.column(f).to_numpy() for f in FEATURES], 1)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(net.score(x))], names=["doc_id", "score"])


def _kept(batches: Iterable[pa.RecordBatch], net, least: float) -> Iterator[pa.RecordBatch]:
    for rows, texts in grouped(batches):
        yield rows.filter(pa.array(net.score(features(texts)) >= least))


class Constant:
    """Without positives there is nothing to learn: every score is the prior."""

    def __init__(self, prior: float):
        self.prior = prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior)


def featured(docs: DataFrame) -> DataFrame:
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_featured, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)), "quality-features")


def fit(rows: DataFrame, labels: DataFrame) -> PuNet | Constant:
    """rows: featured documents; labels: doc_id, label (1: trusted positive) of the rows that may be learnt from.

    Labelled rows enter the risk as positives only; label 0 counts for the prior alone, which is that of
    the rows at hand (an earlier stage may have removed most of the bad ones).
    """
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    n, n_positive = labels.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (n_positive + 1) / (n + 2)
    known = labels.groupBy("doc_id").agg(F.max("label").alias("label"))

    def sample(df: DataFrame) -> np.ndarray:  # bounded by MOST rows
        return least_hashed(df, "doc_id", MOST).select(*FEATURES).toPandas().to_numpy(float)

    positive = sample(rows.join(known.where("label = 1"), "doc_id", "left_semi"))
    unlabelled = sample(rows.join(known, "doc_id", "left_anti"))
    return PuNet(positive, unlabelled, prior) if len(positive) and len(unlabelled) else Constant(prior)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every whole text."""
    rows = featured(docs)
    return rows.mapInArrow(partial(_scored, net=fit(rows, labels)), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with at least this score, in all their columns; no row leaves its partition."""
    return docs.mapInArrow(partial(_kept, net=fit(featured(docs), labels), least=least), docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold("doc_id", 4)
    labels = table(spark, sf_dir, "labels", "doc_id", F.col("quality").alias("label")).where(part != 2)
    rows = score(table(spark, sf_dir, "documents", "doc_id", "text"), labels)
    return rows.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
