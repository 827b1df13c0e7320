"""Incremental ingest applies each batch once."""

from pyspark.sql import functions as F

from cairn.streaming import incremental


def test_batches_are_applied_in_turn(spark, tmp_path):
    source, snaps, check = (str(tmp_path / x) for x in ("in", "snapshots", "checkpoint"))
    rows = lambda x: spark.createDataFrame(x, "doc_id long, text string").withColumn("content_hash", F.md5("text"))
    first = rows([(1, "a"), (2, "b")])
    first.write.parquet(f"{source}/one")
    for step in ("one", "two"):
        if step == "two":
            rows([(2, "new"), (3, "c")]).write.parquet(f"{source}/two")
        q = incremental.ingest(spark, f"{source}/*", first.schema, snaps, check, ["doc_id"])
        q.awaitTermination()
    got = {r["doc_id"]: (r["text"], r["version"]) for r in incremental.snapshot(spark, snaps).collect()}
    assert got == {1: ("a", 1), 2: ("new", 2), 3: ("c", 1)}


def test_windows_count_events(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'x' AS k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'x' UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'x'")
    assert sorted(r["n"] for r in incremental.tumbling(df, "ts", "1 hour", "k").collect()) == [1, 2]


def test_job_states_replayed_in_batches(spark, tmp_path):
    from cairn.streaming import jobs

    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    rows = spark.range(400).select((F.col("id") % 17).alias("job"), F.col("id").alias("seq"), at((F.col("id") * 7) % 400).alias("ts"), F.when(F.col("id") % 5 == 0, "done").when(F.col("id") % 7 == 0, "error").otherwise("running").alias("status"))
    rows = rows.unionByName(spark.range(1).select(F.lit(99).cast("long").alias("job"), F.lit(1000).cast("long").alias("seq"), at(F.lit(2000)).alias("ts"), F.lit("done").alias("status")))
    ordered = rows.orderBy("ts").collect()
    source, check = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    seen = {}
    for n in range(0, len(ordered) + 1, 67):  # arrival in the order of time, in batches
        part = ordered[n : n + 67]
        if part:
            spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(f"{source}/b{n}")
        out = []
        stream = jobs.watched(spark.readStream.schema(rows.schema).parquet(f"{source}/*"))
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        for r in out:
            if r["job"] not in seen or (r["ts"], r["stale"]) >= (seen[r["job"]]["ts"], seen[r["job"]]["stale"]):
                seen[r["job"]] = r
    now = rows.agg((F.max("ts") - F.expr("INTERVAL 10 SECONDS")).alias("now"))
    want = {r["job"]: tuple(r) for r in jobs.states(rows, now).collect()}
    assert {k: tuple(r) for k, r in seen.items()} == want and any(r["stale"] for r in seen.values())
