"""Warm times of headline queries: one JSON line on standard output."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from cairn.operators import fulltext
from cairn.plans import catalogue, search

NAMES = ["r04_rrf", "r03_vector_topk", "r08_dedupe", "a01_month", "a04_entity_share", "a05_title_tokens", "a08_progress", "a09_query_stats", "a14_latency_percentiles", "a15_hit_at_3", "j13_first_answer", "r14_applicability", "r15_bucket_score", "r22_pack", "u01_upsert_plan", "u05_dedup", "x06_chunks", "ext_sessions"]

#: Timed once after a first run, beside the sum: they build their index anew each time.
INDEXED = ["r01_cover_density", "f02_trigrams", "j08_dictionary", "r03_filtered_vectors"]


def seconds_of(run) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 4)


def throughput(spark: SparkSession, d: str) -> dict:
    """Many questions in one plan over an index that is there: seconds to build it, questions a second, share of blocks read."""
    began = time.perf_counter()
    root = search.index(spark, d)
    built = time.perf_counter() - began
    asked = spark.createDataFrame(search.questions(spark, d, root).collect(), "qid string, term string, weight double")  # the bench's questions, made before the clock runs
    n = asked.select("qid").distinct().count()
    took = []
    for _ in range(2):
        began = time.perf_counter()
        best, report = fulltext.search(spark, root, asked)
        best.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    cells = report.groupBy().sum("cells", "cells_read").first()
    return {"index_built_sec": round(built, 2), "questions": n, "questions_per_sec": round(n / took[-1], 1), "blocks": cells[0], "blocks_read": cells[1]}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in NAMES:
        runs = []
        for _ in range(4):  # the first compiles
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs[1:]), 4)
    indexed = {name: [seconds_of(lambda: catalogue.QUERIES[name](spark, d)) for _ in range(2)][-1] for name in INDEXED}  # noqa: B023
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"), "indexed": indexed, "search": throughput(spark, d)}))


if __name__ == "__main__":
    main()
