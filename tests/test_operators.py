"""Operators on rows that their queries don't have."""

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import aggregate, rank, upsert
from cairn.streaming import incremental


def test_markup_in_any_case(spark):
    text = " {COLOR:red}a{Color}&nbsp;b{Panel:x}{NOFORMAT}{Code:java}c{code}{--}{{-}}\n\n\n\n\nd \n"
    assert spark.range(1).select(T.clean_markup(F.lit(text)).alias("x")).first()["x"] == "a b```c```\n\n\nd"


def test_nearest_rank_is_exact(spark):
    values = [float((i * 7919) % 1009) for i in range(5000)] + [3.0] * 4000 + [None]
    df = spark.createDataFrame([(v,) for v in values], "value double").repartition(7)
    row = aggregate.nearest_rank(df, "value", (0.0, 0.5, 0.95, 0.99, 1.0)).first()
    s = sorted(v for v in values if v is not None)
    assert [row[f"p{p}"] for p in (0, 50, 95, 99, 100)] == [s[round(p / 100 * (len(s) - 1))] for p in (0, 50, 95, 99, 100)]
    assert row["n"] == 9000 and row["largest"] == 1008.0


def test_null_hash_is_a_hash(spark):
    old = spark.createDataFrame([(1, None, 3), (2, "a", 1), (3, None, 1)], "k int, content_hash string, version int")
    new = spark.createDataFrame([(1, None), (2, None), (4, None)], "k int, content_hash string")
    got = {r["k"]: (r["action"], r["version"]) for r in upsert.plan(old, new, ["k"]).collect()}
    assert got == {1: ("skip", 3), 2: ("update", 2), 3: ("keep", 1), 4: ("insert", 1)}


def test_terms_are_no_patterns(spark):
    docs = spark.createDataFrame([(1, "a.b a.b axb"), (2, "c++ (x"), (3, "none")], "id long, text string")
    assert [(r["id"], r["rank"]) for r in rank.lexical(docs, ["a.b", "c++", "(x"], 5).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_ingest_writes_touched_buckets_only(spark, tmp_path):
    source, snaps, check = (str(tmp_path / x) for x in ("in", "snapshots", "checkpoint"))
    rows = lambda x: spark.createDataFrame(x, "doc_id long, text string").withColumn("content_hash", F.md5("text"))
    first = rows([(i, "a") for i in range(40)] + [(1, "b")])  # a key twice in the first batch
    for step, df in (("one", first), ("two", rows([(2, "new")]))):
        df.coalesce(1).write.parquet(f"{source}/{step}")
        incremental.ingest(spark, f"{source}/*", first.schema, snaps, check, ["doc_id"], buckets=8).awaitTermination()
    assert len(list((tmp_path / "snapshots" / "batch=1").glob("bucket=*"))) == 1
    got = incremental.snapshot(spark, snaps).collect()
    assert len(got) == 40 and {r["doc_id"]: r["version"] for r in got}[2] == 2
