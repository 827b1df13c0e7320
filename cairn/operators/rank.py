"""Ranking, fusion, gates and packing of search results."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.lexical import EXACT

#: Rows of a block of vectors, and bytes of blocks that a worker is handed at once.
PACK, BATCH_BYTES = 1024, "16m"
RRF_K = 60
GATE = 0.012


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACK rows of id and vec as one row: their ids and the unit vectors, in double precision; null and zero vectors are left out."""
    for b in (whole.slice(x, PACK) for whole in batches for x in range(0, whole.num_rows, PACK)):
        rows = [(i, np.array(v, np.float64)) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if v]
        rows = [(i, v, n) for i, v in rows if (n := np.linalg.norm(v)) > 0]
        if rows:
            unit = np.stack([v / n for _, v, n in rows])
            yield pa.RecordBatch.from_arrays([pa.array([[i for i, _, _ in rows]], pa.list_(pa.int64())), pa.array([unit.tobytes()], pa.binary())], names=["ids", "units"])


def _top(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks: the k most similar rows of each query, ties to the smaller id."""
    for b in batches:
        for i in range(b.num_rows):  # one pair at a time is copied out of the batch
            q, qu, r, ru = (b.column(c)[i].as_py() for c in ("q_ids", "q_units", "ids", "units"))
            q, r = np.array(q), np.array(r)
            sims = np.frombuffer(qu).reshape(len(q), -1) @ np.frombuffer(ru).reshape(len(r), -1).T
            sims[q[:, None] == r] = -9  # a query isn't its own result
            if len(r) > k:  # ties at the edge stay
                edge = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
                at = np.nonzero((sims >= edge) & (sims > -9))
            else:
                at = np.nonzero(sims > -9)
            yield pa.RecordBatch.from_arrays([pa.array(q[at[0]]), pa.array(r[at[1]]), pa.array(sims[at])], names=["query_id", "id", "score"])


def vector_top(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query its k most similar other rows by cosine: query_id, id, score, rank. rows: id, vec; queries: query_id, query_vec.

    Both sides are packed into blocks, and blocks meet as matrix products; a block hands on k of each query. A worker is handed a bounded
    number of bytes, since every row of a batch of pairs holds two whole blocks.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    packed = "ids array<long>, units binary"
    asked = queries.select(F.col("query_id").cast("long"), "query_vec").mapInArrow(_blocks, packed).toDF("q_ids", "q_units")
    pairs = rows.select(F.col("id").cast("long"), "vec").mapInArrow(_blocks, packed).crossJoin(asked)  # of blocks
    scored = pairs.mapInArrow(partial(_top, k=k), "query_id long, id long, score double")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def lexical(docs: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Documents with most occurrences of the terms (as they stand, no patterns) for their length: id, score, rank."""
    low, n = F.lower("text"), F.lit(0)
    for t in terms:
        n = n + (F.octet_length(low) - F.octet_length(F.replace(low, F.lit(t), F.lit("")))) / len(t.encode())  # bytes need no counting
    score = F.round(n / (1 + F.log(1 + F.length("text"))), 6)
    top = docs.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit).where("score > 0")  # a filter below would count twice
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fused(lists: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of lists of (id, rank)."""
    parts = [x.select("id", (F.lit(w) / (k + F.col("rank"))).alias("part")) for x, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"))


def gated(hits: DataFrame, top_k: int, gate: float = GATE, min_score: float = 0.0) -> DataFrame:
    """Nothing if even the best score is under the gate; else the top_k of those with min_score."""
    best = hits.agg(F.max("score").alias("_best"))
    return hits.join(F.broadcast(best)).where((F.col("_best") >= gate) & (F.col("score") >= min_score)).drop("_best").orderBy(F.desc("score"), "id").limit(top_k)


def trust_label(score: Column, first: Column) -> Column:
    return F.when(score.isNull(), "empty").when((score >= 0.05) | first, "strong").when(score >= 0.02, "medium").otherwise("weak")


def searched(hits: DataFrame, docs: DataFrame, document: str, top_k: int, gate: float = GATE) -> DataFrame:
    """The hits a search returns: document, id, score, label. hits: id, score, lex_rank; docs: id and the column ``document``.

    The gate cuts to top_k chunks before each document keeps its best, so fewer than top_k documents may return; a chunk that leads
    the lexical list is trusted whatever its fused score.
    """
    kept = gated(hits.withColumn("score", F.round("score", 9)), top_k, gate)
    best = Window.partitionBy(document).orderBy(F.desc("score"), "id")
    rows = docs.join(F.broadcast(kept), "id").withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return rows.select(document, "id", "score", trust_label(F.col("score"), F.coalesce(F.col("lex_rank") == 1, F.lit(False))).alias("label"))


def variant_weight(variant: str, original: str) -> float:
    """What a variant of a question counts: the question itself most but for exact keys, phrases by their length; single words see ``frequent_singles_down``."""
    if variant == original:
        return 1.0
    if any(re.search(p, variant) for p in EXACT):
        return 1.15
    return {0: 0.0, 1: 0.55, 2: 0.85}.get(len(variant.split()), 0.95)


def frequent_singles_down(weights: DataFrame, share: float = 0.2) -> DataFrame:
    """variant, w: single words that over ``share`` of the texts have count 0.25. weights: variant, w, df (of its most frequent term), texts."""
    single = F.col("w") == 0.55
    return weights.select("variant", F.when(single & (F.col("df") > share * F.col("texts")), 0.25).otherwise(F.col("w")).alias("w"))


def match_boost(hits: Column) -> Column:
    return F.when(hits >= 3, 0.55 + 0.05 * F.least(hits - 3, F.lit(4))).otherwise(0.12 * hits)


def applicability(overlap: Column, quality: Column, resolved: Column, same_place: Column, hits: Column) -> Column:
    s = 0.2 + 0.15 * F.least(overlap, F.lit(3)) + 0.25 * F.least(quality, F.lit(1.0)) + F.when(resolved, 0.2).otherwise(0.0) + F.when(same_place, 0.1).otherwise(0.0) + F.when(hits >= 3, 0.1).otherwise(0.0)
    return F.round(F.least(s, F.lit(1.0)), 3)


def applicability_label(score: Column, quality: Column, resolved: Column) -> Column:
    return F.when(~resolved | (quality < 0.25), "abstain").when(score >= 0.7, "possible").when(score >= 0.45, "conditional").otherwise("not-recommended")


def signal_tokens(signals: Column) -> Column:
    """Distinct tokens of each signal; made once for a bucket, before it meets texts."""
    return F.transform(signals, lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"[a-z0-9가-힣]{2,}"), 0)))


def bucket_match(signals: Column, counter: Column, observed: Column, confidence: Column) -> tuple[Column, Column]:
    """Score and label of a failure bucket for observed tokens. signals, counter: tokens of each signal.

    A signal is seen if half of its tokens are, rounded up. Each counter-signal seen takes 0.5 off; no confidence, or 0, counts as 0.5.
    """
    def seen(tokens: Column) -> Column:
        return (F.size(tokens) > 0) & (F.size(F.array_intersect(tokens, observed)) >= F.ceil(F.size(tokens) / 2))

    matched, against = F.size(F.filter(signals, seen)), F.size(F.filter(counter, seen))
    share = F.least(matched, F.lit(4)) / F.least(F.greatest(F.size(signals), F.lit(1)), F.lit(4))
    sure = F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(0.5))
    score = F.greatest(F.least(0.6 * share + 0.4 * sure - 0.5 * against, F.lit(1.0)), F.lit(0.0))
    label = F.when(against > 0, "not-recommended").when((score >= 0.7) & (matched > 0), "possible").when(score >= 0.4, "conditional").otherwise("not-recommended")
    return F.round(score, 3), label


def bucket_scores(docs: DataFrame, buckets: DataFrame, tokens: list[str], on: Column | None = None) -> DataFrame:
    """docs (with obs: tokens) and every bucket (of ``on``), obs cut to the tokens that signals have: once for a text, not for each bucket.

    buckets: signals and counter as tokens; tokens: all of them, a short list.
    """
    few = docs.withColumn("obs", F.array_intersect("obs", F.array(*map(F.lit, tokens)).cast("array<string>")))
    rows = few.join(F.broadcast(buckets), on) if on is not None else few.join(F.broadcast(buckets))
    score, label = bucket_match(F.col("signals"), F.col("counter"), F.col("obs"), F.col("confidence"))
    return rows.withColumn("score", score).withColumn("label", label)


def packed(hits: DataFrame, budget: int) -> DataFrame:
    """Per query, hits in order until the estimated tokens pass the budget; the first always stays. hits: query_id, rank, est."""
    upto = F.sum("est").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("running", upto).where((F.col("running") <= max(budget, 500)) | (F.col("rank") == 1)).withColumn("cite", F.concat(F.lit("C"), F.col("rank")))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(limit, 200))
