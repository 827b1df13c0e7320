"""Snapshot comparison: what an ingest has to do, without row-by-row updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Action per key from content hashes: insert, update, skip, or keep (only in the old snapshot; nothing is deleted).

    A null hash is a hash like any other: a row that has one is there.
    """
    o = old.select(*keys, F.col("content_hash").alias("old_hash"), F.col("version").alias("old_version"), F.lit(True).alias("_old"))
    n = new.select(*keys, F.col("content_hash").alias("new_hash"), F.lit(True).alias("_new"))
    rows = o.join(n, keys, "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "skip").otherwise("update")
    version = F.coalesce("old_version", F.lit(0)) + F.when(action.isin("insert", "update"), 1).otherwise(0)
    return rows.select(*keys, action.alias("action"), version.cast("int").alias("version"))


def latest(rows: DataFrame, keys: list[str], arrived: str | None = None) -> DataFrame:
    """One row per key, of repeated ones the last to arrive; of those at the same time, or without such a column, the last by hash."""
    order = [F.desc_nulls_last(arrived)] if arrived else []
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.desc("content_hash")))).where("_r = 1").drop("_r")


def apply(old: DataFrame, new: DataFrame, keys: list[str], arrived: str | None = None) -> DataFrame:
    """The next snapshot: new rows win where their hash differs; of repeated keys in new, the last to arrive (by ``latest``) counts."""
    last = latest(new, keys, arrived)
    p = plan(old, last, keys)
    fresh = last.join(p.where("action IN ('insert', 'update')"), keys).drop("action")
    stay = old.join(p.where("action IN ('skip', 'keep')").select(*keys), keys, "left_semi")
    return stay.unionByName(fresh.select(*stay.columns))


def manifest_diff(ops: DataFrame, local: DataFrame, key: str, hash_: str) -> DataFrame:
    """Keys that only ops has or whose hash differs; what only local has is not reported."""
    other = local.select(F.col(key).alias("_k"), F.col(hash_).alias("_h"))
    return ops.join(other, F.col(key) == F.col("_k"), "left").where(~F.col(hash_).eqNullSafe(F.col("_h"))).select(key, hash_)


#: Status of an insight -> where it may go; approved is the end.
TRANSITIONS = {"draft": ("review", "rejected"), "review": ("approved", "rejected", "draft"), "approved": (), "rejected": ("draft",)}


def transitioned(insights: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """insights: key, status; requests: key, to_status -> key, status (after), action (moved, refused, unknown) of each request's insight."""
    steps = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    rows = requests.join(insights, key, "left")
    may = F.array_contains(F.coalesce(F.try_element_at(steps, F.col("status")), F.array().cast("array<string>")), F.col("to_status"))
    action = F.when(F.col("status").isNull(), "unknown").when(may, "moved").otherwise("refused")
    return rows.select(key, F.when(action == "moved", F.col("to_status")).otherwise(F.col("status")).alias("status"), action.alias("action"))


def frames_due(old: DataFrame, new: DataFrame, key: str, min_quality: float, force: bool = False) -> DataFrame:
    """Frames to write: those of enough quality that are new or, with force, all of them."""
    good = new.where(F.col("quality") >= min_quality)
    return good if force else good.join(old.select(key), key, "left_anti")


def replaced(old: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Seeds take the place of rows with their keys; the others stay."""
    return old.join(seeds.select(key), key, "left_anti").unionByName(seeds.select(*old.columns))


def refined(log: DataFrame, key: str) -> DataFrame:
    """State of buckets from their refinements (key, ts, signal, confirm): signals in order of arrival, counts, confidence."""
    first = log.where("signal IS NOT NULL").groupBy(key, "signal").agg(F.min("ts").alias("ts"))
    signals = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "signal"))), lambda x: x["signal"]).alias("signals"))  # distinct signals of one bucket
    counts = log.groupBy(key).agg(F.count_if("confirm").alias("support"), F.count_if(~F.col("confirm")).alias("counter"))
    s, c = F.col("support"), F.col("counter")
    return counts.join(signals, key, "left").withColumn("confidence", F.round((s + 1) / (s + c + 2), 3))


def isolated(rows: DataFrame, source: str, parsed: Column) -> DataFrame:
    """Records by source and outcome; one that can't be parsed is counted as an error and stops nothing."""
    return rows.groupBy(source, F.when(parsed.isNull(), "error").otherwise("ok").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def refinements(log: DataFrame, key: str) -> DataFrame:
    """State of buckets from the log of their refinements: key, signals and counter_signals in order of arrival, environment, support, counter, confidence.

    log: key, ts, seq (order at one time), signal, counter_signal, environment, confirm; null: left as it is, a blank environment: none.
    """
    at, s, c = F.struct("ts", "seq"), F.col("support"), F.col("counter")
    env = F.lower(F.trim("environment"))
    state = log.groupBy(key).agg(F.max_by(env, F.when(env.isNotNull(), at)).alias("environment"), F.count_if("confirm").alias("support"), F.count_if(~F.col("confirm")).alias("counter"))
    state = state.withColumn("environment", F.nullif("environment", F.lit(""))).withColumn("confidence", F.round((s + 1) / (s + c + 2), 3))
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("said")) for k in ("signal", "counter_signal")])).alias("x")
    first = log.select(key, at.alias("at"), both).select(key, "at", "x.kind", "x.said").where("said IS NOT NULL").groupBy(key, "kind", "said").agg(F.min("at").alias("at"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "said")))), lambda x: x["said"])  # noqa: E731  distinct signals of a bucket
    signals = first.groupBy(key).agg(listed("signal").alias("signals"), listed("counter_signal").alias("counter_signals"))
    return state.join(signals, key, "left").withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k in ("signals", "counter_signals")})


def reindexing(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, action: what a bucket's document needs. Signals are its text: chunk if they changed or it is new; the environment is a field: patch; counts: nothing."""
    old = before.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in ("signals", "counter_signals", "environment")])
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = F.when(~(same("signals") & same("counter_signals")) | F.col("_k").isNull(), "chunk").when(~same("environment"), "patch").otherwise("none")
    return after.join(old, after[key].eqNullSafe(F.col("_k")), "left").select(key, action.alias("action"))
