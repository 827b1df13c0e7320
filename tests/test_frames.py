"""Frames, chunks, taxonomy and postings ranking on literals."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import chunks, frames, taxonomy, text
from cairn.operators import lexical

SUMMARY = """# [OPS-25] cache times out
## LLM 요약
- **배경** :
  - cluster pods can't reach the cache
- **지원내용** :
  - **요청이슈** : all pods see timeouts and slow answers of Redis
  - **분석결과(원인)** :
    - peak traffic saturates the fabric
  - **조치내용** :
    - hosts moved to the second fabric

## 원본 내용
h3. 이슈 증상
 * cache down

$ redis-cli ping
# uptime
"""


def test_summary_labels(spark):
    row = frames.extracted(spark.createDataFrame([(1, "[OPS-25] cache", SUMMARY), (2, None, None)], "id long, title string, body string")).orderBy("id").collect()
    assert "timeouts" in row[0]["symptom"] and "peak traffic" in row[0]["root_cause"] and "second fabric" in row[0]["resolution"]
    assert row[0]["components"] == ["Redis", "Kubernetes", "Cluster"] and row[0]["quality"] == 1.0
    assert "redis-cli ping" in row[0]["commands"] and "uptime" in row[0]["commands"]
    assert row[1]["symptom"] is None and row[1]["quality"] == 0.0


@pytest.mark.parametrize("text, cause, resolution", [
    ("## 원본 내용\n4. 원인 : peak traffic of the batch\n* 조치내용\n  - fabric moved elsewhere\n", "peak traffic", "fabric moved"),
    ("h3. 장애 원인\n disk of the node was full\nh3. 조치 내역\n old logs were removed\n", "disk of the node", "old logs"),
    ("원인 : 미상\n조치 : restarted the service twice\n", None, "restarted"),
    ("10:00 db node 재시작 at night -> 해결O\n", None, "재시작"),
    ("nothing here\n", None, None),
])
def test_slots(text, cause, resolution):
    found = frames.slots(text, "[OPS-1] the title")
    for want, got in ((cause, found["root_cause"]), (resolution, found["resolution"])):
        assert (want is None and got is None) or want in got
    assert found["symptom"] == "the title"


def test_chunks_under_headings(spark):
    long = "\n\n".join(f"p{i} " + "x" * 300 for i in range(10)) + "\n\n" + "t" * 100
    docs = spark.createDataFrame([(1, "[s | k | t]", "lead\n# One\na\n\n## Empty\n\n### Two\n" + long), (2, "h", None), (3, "h", " ")], "id long, header string, body string")
    rows = chunks.chunked(docs).orderBy("id", "ordinal").collect()
    assert [(r["section"], r["header"]) for r in rows[:2]] == [("", "[s | k | t]"), ("One", "[s | k | t] | One")]
    assert {r["section"] for r in rows[2:]} == {"Two"} and len(rows) > 4 and {r["id"] for r in rows} == {1}
    assert all(r["tokens"] <= chunks.MOST + chunks.OVERLAP for r in rows)
    joined = [p for r in rows[2:] for p in r["text"].split("\n\n")]
    assert list(dict.fromkeys(joined)) == long.split("\n\n")
    assert chunks.pieces("y" * 5000) == ["y" * 5000]  # one paragraph is never cut


def test_taxonomy(spark):
    df = spark.createDataFrame([("k8s down", "", "", "x", "", ""), ("", "Oracle slow", "A > B > 네트워크", "x", "", ""), ("t", "b", "", "checkitem", "Web Server", ""), ("t", "b", "", "failure_bucket", "", "Cluster"), ("", "", "", "x", "", "")], "title string, body string, path string, source string, area string, fb string")
    c = F.col
    rows = df.select(taxonomy.environment(c("title"), c("body")).alias("e"), taxonomy.domain(c("title"), c("body"), c("path"), c("source"), c("area"), c("fb")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("hybrid", "middleware"), (None, "network"), (None, "web_server"), (None, "os"), (None, None)]


def test_fold_depends_on_order(spark, tmp_path):
    docs = spark.createDataFrame([(1, "disk full disk"), (2, "disk only"), (3, "full"), (4, None)], "id long, text string")
    lexical.write_index(docs, str(tmp_path / "index"))
    variants = [("disk", 0.55), ("disk full", 1.0), ("full", 0.25)]
    posts = lexical.read_index(spark, str(tmp_path / "index"), lexical.terms_of("disk full"))
    got = {r["id"]: r["score"] for r in lexical.folded(posts, variants).collect()}
    from math import log

    norm = lambda t: 1 + log(1 + len(t))
    one = [0.55 * 2 / norm("disk full disk"), 3 / norm("disk full disk"), 0.25 / norm("disk full disk")]
    assert abs(got[1] - (one[1] + 0.15 * one[2])) < 1e-12  # the new best drops what was before
    assert abs(got[2] - 0.55 / norm("disk only")) < 1e-12 and set(got) == {1, 2, 3}


def test_exact_tokens_stand_in_front(spark):
    row = spark.range(1).select(lexical.exact_tokens(F.lit("see OPS-123 and ISS-20240101-2, vm.swappiness, page_42, 1234567 OPS-123 utf-8")).alias("t")).first()
    assert row["t"] == ["OPS-123", "ISS-20240101-2", "vm.swappiness", "page_42", "1234567", "20240101"] or row["t"] == ["OPS-123", "ISS-20240101-2", "vm.swappiness", "page_42", "20240101", "1234567"]
    ranked = spark.createDataFrame([(5, 1), (7, 2)], "id long, rank int")
    docs = spark.createDataFrame([(5, "OPS-1", "a"), (6, "x", "about ops-1"), (8, "OPS-10", "b"), (9, "z", "c")], "id long, key string, title string")
    tokens = spark.createDataFrame([(0, "OPS-1")], "i int, token string")
    assert [r["id"] for r in lexical.injected(ranked, docs, tokens).orderBy("rank").collect()] == [8, 6, 5, 7]


def test_a_number_that_ends_a_key_is_no_long_number(spark):
    def tokens(said):
        return spark.range(1).select(lexical.exact_tokens(F.lit(said)).alias("t")).first()["t"]

    assert tokens("why ABC-100010 or vm.max_100000") == ["ABC-100010", "vm.max_100000"]
    assert tokens("ABC-100010 beside 100010") == ["ABC-100010", "100010"]
    assert tokens("AB-100010, 2024-100011") == ["100010", "100011"]  # these are no keys


def test_snippets_collapse_a_text_once(spark):
    df = spark.createDataFrame([("a \n b the  end",), (" \t",), (None,), ("x\x0by",)], "text string")
    got = df.select(text.snippet(F.col("text"), "the").alias("a"), text.snippet_around(F.col("text"), ["no", "THE"], 3, 6).alias("b"))
    assert [tuple(r) for r in got.collect()] == [("a b the end", "… b the…"), ("", ""), (None, ""), ("x y", "x y")]
    for f in (text.snippet(F.col("text"), "the"), text.snippet_around(F.col("text"), ["no", "the"])):
        assert df.select(f)._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 1
