"""Shared folders, written steps, and words of texts."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import tables, textnum


class Session:
    """A session without a shared folder."""

    def __init__(self, master):
        self.sparkContext, self.conf = self, self
        self.master, self.values = master, {}

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


def test_a_cluster_has_to_name_its_folder():
    assert tables.shared_dir(Session("local[4]"), "x").startswith("file:///tmp/")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(Session(master), "x")


def test_written_steps_keep_rows_and_settings(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    df = spark.range(100).selectExpr("id", "id % 7 AS k", "CASE WHEN id > 3 THEN id END AS maybe")
    for back in (tables.stored(df, "steps"), tables.bucketed(df, "steps", "k"), tables.bucketed(df.limit(0), "steps", "k", "id")):
        assert back.columns == df.columns
    assert tables.stored(df, "steps").exceptAll(tables.bucketed(df, "steps", "k", "id")).count() == 0
    assert spark.conf.get(key) == before


def test_words_and_spans():
    texts = ["", "One two  three", " ", "é x\ty\n", "one TWO three one"]
    w = textnum.Words([t.encode() for t in texts])
    assert w.per_text().tolist() == [len(re.findall(r"[^ \t-\r]+", t)) for t in texts]
    h = w.hashes()
    words = [t.lower() for x in texts for t in x.split()]
    for a in range(len(words)):
        for b in range(a):
            assert (h[a] == h[b]) == (words[a] == words[b])
    data = np.frombuffer(b"abcabcab", np.uint8)
    s = textnum.span_hashes(data, np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert s[0] == s[1] != s[2]


def test_least_hashed(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "id % 3 AS x")
    want = [r["doc_id"] for r in df.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").limit(300).collect()]
    assert [r["doc_id"] for r in tables.least_hashed(df, "doc_id", 300).collect()] == want
    assert tables.least_hashed(df, "doc_id", 9000).count() == 5000
    assert tables.least_hashed(df.selectExpr("0L AS doc_id"), "doc_id", 100).count() == 100  # one key has all rows
    assert tables.least_hashed(df.limit(0), "doc_id", 100).count() == 0


def test_least_hashed_a_little_over_the_limit(spark):
    """The cut is then the greatest hash, which a double rounds up beyond a long."""
    df = spark.range(1100).toDF("doc_id")
    want = [r["doc_id"] for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(1000).collect()]
    assert [r["doc_id"] for r in tables.least_hashed(df, "doc_id", 1000).collect()] == want


def test_frequent_end_of_the_order(spark, monkeypatch):
    from cairn.llm import ngram_join

    df = spark.range(1, 2001).selectExpr("id AS token", "CAST(1 + 100000 / id AS LONG) AS df")
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 500)
    rows = ngram_join._most_frequent(df).collect()
    assert 300 < len(rows) <= 500 and sorted(r["token"] for r in rows) == list(range(1, len(rows) + 1))
    assert ngram_join._most_frequent(df.limit(0)).count() == 0
