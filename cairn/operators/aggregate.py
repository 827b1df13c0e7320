"""Counts, shares and summary statistics. All group on the map side first."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(kind: str, value: Column) -> Column:
    """Group keys: year and month of a date, or a text; what is missing has a name of its own."""
    if kind in ("year", "month"):
        return F.coalesce(F.date_format(value, "yyyy" if kind == "year" else "yyyy-MM"), F.lit("(unknown)"))
    text = F.trim(value.cast("string"))
    return F.when(text.isNull() | (text == "") | (text == "-"), F.lit("(empty)")).otherwise(text)


def counted(df: DataFrame, key: Column, top_k: int = 200, name: str = "bucket") -> DataFrame:
    """Rows per key with their share of all rows, most frequent first, ties by key.

    The total is that of all keys, taken from the grouped rows; only they (one for each key) are ordered.
    """
    n = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select(name, "n", F.round(F.col("n") / F.col("total"), 4).alias("share")).orderBy(F.desc("n"), name).limit(min(top_k, 200))


def samples(df: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The first rows of each group; tasks cut their groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rank") <= limit)


def token_frequency(df: DataFrame, text: Column, stop: list[str], top_k: int = 100) -> DataFrame:
    """Tokens of titles of two characters at least, as they are written; shares are of titles, so they may exceed 1."""
    rows = df.select(text.alias("t"))
    total = rows.agg(F.count(F.lit(1)).alias("titles"))
    tokens = rows.select(F.explode(F.regexp_extract_all(F.regexp_replace("t", r"^\s*\[?[A-Z][A-Z0-9]+-\d+\]?\s*", ""), F.lit(r"[0-9A-Za-z가-힣]{2,}"), 0)).alias("token"))
    tokens = tokens.where(~F.col("token").rlike(r"^\d+$") & ~F.lower("token").isin(stop))
    n = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(total)).select("token", "n", F.round(F.col("n") / F.col("titles"), 4).alias("share")).orderBy(F.desc("n"), "token").limit(min(top_k, 100))


def dated(df: DataFrame, fields: dict[str, Column], field: str, since: Column | None, until: Column | None, listing: bool) -> DataFrame:
    """Rows whose date lies in the range, both ends included. An unknown field is the first of ``fields``.

    A listing has no undated rows; an aggregation loses them only where a bound is given.
    """
    day = fields.get(field, next(iter(fields.values())))
    rows = df.where(day.isNotNull()) if listing else df
    for bound, good in ((since, lambda x: day >= x), (until, lambda x: day <= x)):
        rows = rows if bound is None else rows.where(good(bound))
    return rows


#: Ranges that values are dealt into for ranks.
RANGES = 64


def nearest_rank(df: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """sorted[round(p * (n - 1))] for each p, mean and largest.

    Approximate quantiles cut the values into ranges; how many values lie in each is counted exactly, so ranks within
    ranges give ranks in the whole. A value's range follows from the value alone. One row of statistics is broadcast.
    """
    rows = df.select(value).where(F.col(value).isNotNull())
    cuts = F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest"), cuts)
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_c")).join(F.broadcast(stats))
    counts = counts.withColumn("_range", F.size(F.filter("_cuts", lambda x: x <= F.col(value)))).drop("_cuts")
    sizes = counts.groupBy("_range").agg(F.sum("_c").alias("_size"))  # RANGES rows at most
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.sum("_c").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    ranked = counts.join(F.broadcast(before), "_range").withColumn("_upto", upto)
    at = lambda p: F.bround(F.lit(p) * (F.col("n") - 1), 0)
    return ranked.groupBy("n", "mean", "largest").agg(*[F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(f"p{round(100 * p)}") for p in shares])


def laplace(support: Column, counter: Column) -> Column:
    s, c = F.greatest(support, F.lit(0)), F.greatest(counter, F.lit(0))
    return F.round((s + 1) / (s + c + 2), 3)


def best_per_key(df: DataFrame, key: str, score: str, id_: str) -> DataFrame:
    """The row with the largest score of each key, ties by the smaller id."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), id_))).where("_r = 1").drop("_r")


def similar_incidents(results: DataFrame, gold: DataFrame, top_k: int, min_rate: float = 0.7, min_cases: int = 8, min_similar: int = 8) -> DataFrame:
    """One row of gates. results: query_id, rank, id, label (of applicability). gold: query_id, kind, relevant, forbidden (arrays of ids).

    A false-apply query fails if its first result is forbidden and called possible; the others pass if one of their
    top_k is relevant, and don't count without any relevant id.
    """
    top = results.where(F.col("rank") <= top_k).groupBy("query_id").agg(F.collect_set("id").alias("ids"), F.max(F.when(F.col("rank") == 1, F.struct("id", "label"))).alias("first"))  # top_k ids at most
    false = F.col("kind") == "false_apply"
    bad = F.coalesce(F.array_contains("forbidden", F.col("first.id")) & (F.col("first.label") == "possible"), F.lit(False))
    ok = F.when(false, ~bad).when(F.size("relevant") > 0, F.coalesce(F.arrays_overlap("ids", "relevant"), F.lit(False)))
    rows = gold.join(top, "query_id", "left").select(false.alias("false"), ok.alias("ok"))
    out = rows.agg(F.count("ok").alias("n_scored"), F.count_if("ok").alias("hits"), F.count_if(~F.col("false") & F.col("ok")).alias("similar_hits"), F.count_if(F.col("false") & ~F.col("ok")).alias("false_apply_failures"))
    rate = F.coalesce(F.col("hits") / F.nullif("n_scored", F.lit(0)), F.lit(0.0))
    passed = (rate >= min_rate) & (F.col("n_scored") >= min_cases) & (F.col("false_apply_failures") == 0) & (F.col("similar_hits") >= min_similar)
    return out.select("*", F.round(rate, 4).alias("pass_rate"), passed.alias("pass"))


def groundedness(answers: DataFrame, min_answered: int = 10, min_cited: float = 0.6, min_overlap: float = 0.5) -> DataFrame:
    """One row of rates and the gate. answers: has_text, has_citation, overlap (ok, medium, low), expect_abstain, abstained, trust."""
    quiet = F.col("abstained") | F.col("trust").isin("abstain", "empty", "weak")
    ok = F.when(F.col("expect_abstain"), quiet).otherwise(F.col("has_text") & (F.col("has_citation") | F.col("abstained")))
    rows = answers.withColumn("row_ok", ok)
    asked, share = ~F.col("expect_abstain"), lambda c, d, empty: F.round(F.coalesce(F.count_if(c) / F.nullif(F.count_if(d), F.lit(0)), F.lit(empty)), 4)
    out = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(asked).alias("n_answered"),
        share(asked & F.col("has_citation"), asked, 0.0).alias("citation_rate"),
        share(asked & F.col("overlap").isin("ok", "medium"), asked, 0.0).alias("overlap_rate"),
        share(~asked & F.col("row_ok"), ~asked, 1.0).alias("abstain_ok_rate"),
        share(F.col("row_ok"), F.lit(True), 0.0).alias("row_ok_rate"),
    )
    passed = (F.col("n_answered") >= min_answered) & (F.col("citation_rate") >= min_cited) & (F.col("overlap_rate") >= min_overlap) & (F.col("abstain_ok_rate") >= 0.5)
    return out.withColumn("pass", passed)


#: Size of a sketch: exact up to about so many values, beyond it ranks are off by about 1 / SKETCH of the values.
SKETCH = 4096


def hourly_sketches(log: DataFrame, ts: str, value: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """keys, hour, n, sketch of the values of each hour; log may be a stream, which keeps open hours as its state. Null values have no part in the sketch."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    hours = rows.groupBy(*keys, F.window(ts, "1 hour").alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value), F.lit(SKETCH)).alias("sketch"))
    return hours.select(*keys, F.col("_w.start").alias("hour"), "n", "sketch")


def rolling(hourly: DataFrame, hours: list[int], points: list[float], *keys: str) -> DataFrame:
    """keys, hours, n (values), per_second and a column p50, p95 and so on for the last so many hours, by merging sketches; raw values aren't read again."""
    last = hourly.agg(F.max("hour").alias("_last"))
    spans = F.explode(F.array(*map(F.lit, hours))).alias("hours")
    rows = hourly.crossJoin(F.broadcast(last)).select("*", spans)  # one row
    rows = rows.where(F.col("hour") > F.col("_last") - F.make_dt_interval(hours="hours"))
    merged = rows.groupBy(*keys, "hours").agg(F.kll_merge_agg_double("sketch").alias("_s"), F.sum("n").alias("_n"))
    found = [F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(f"p{round(100 * p)}") for p in points]
    return merged.select(*keys, "hours", F.kll_sketch_get_n_double("_s").alias("n"), (F.col("_n") / (F.col("hours") * 3600)).alias("per_second"), *found)


#: Groups that a task holds before it hands them on.
HELD = 100_000


def _tallied(batches: Iterable[pa.RecordBatch], kinds: list[str], samples: int) -> Iterator[pa.RecordBatch]:
    """Of each kind and bucket of a task: its rows, and the smallest ids in a heap of bounded size."""
    held: dict[tuple[str, str], list] = {}

    def handed_on() -> pa.RecordBatch:
        rows = [(k, b, x[0], sorted(-i for i in x[1])) for (k, b), x in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["kind", "bucket", "n", "ids"])

    for b in batches:
        ids = b.column("_id").to_pylist()
        for kind in kinds:
            for bucket_, i in zip(b.column(kind).to_pylist(), ids, strict=True):
                x = held.get((kind, bucket_))
                if x is None:
                    x = held[kind, bucket_] = [0, []]
                x[0] += 1
                if i is not None:
                    if len(x[1]) < samples:
                        heapq.heappush(x[1], -i)
                    elif -i > x[1][0]:
                        heapq.heapreplace(x[1], -i)
        if len(held) > HELD:
            yield handed_on()
    if held:
        yield handed_on()


def tallies(df: DataFrame, key: str, kinds: dict[str, Column], samples: int = 3) -> DataFrame:
    """kind, bucket, n and the smallest ids of each bucket of every kind, in one scan.

    Tasks count all kinds at once, so what is shuffled is a row for each bucket of a task.
    """
    rows = df.select(F.col(key).cast("long").alias("_id"), *[c.cast("string").alias(k) for k, c in kinds.items()])
    part = rows.mapInArrow(partial(_tallied, kinds=list(kinds), samples=samples), "kind string, bucket string, n long, ids array<long>")
    return part.groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, samples).alias("ids"))  # a few ids of each task
