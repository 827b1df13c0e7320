"""The quality classifier from texts to scores against plain Python, and what its scores may depend on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import quality_classifier as q
from tests.llm.test_operators import base_text


def features_by_hand(text):
    raw = (text or "").encode()
    words = [w.lower() for w in raw.split()]
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = raw.count(b"\n") + 1
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    some = lambda x: sum(raw.count(bytes([c])) for c in x)
    letters = sum(chr(c).isalpha() for c in raw if c < 128)
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, np.log1p(50 * some(b"#*$%&<>") / n), np.log1p(50 * some(b"|") / n), np.log1p(50 * some(b"!") / n),
        sum(65 <= c <= 90 for c in raw) / max(letters, 1), sum(48 <= c <= 57 for c in raw) / size, sum(c >= 128 for c in raw) / size,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(words)) / n, (len(windows) - len(set(windows))) / n,
        np.log1p(lines), np.log1p(len(words) / lines), some(b".") / n, some(b",") / n, sum(len(w) <= 2 for w in words) / n,
    ]


TEXTS = {i: base_text(i, 40) + ("! | ## 9" * (i % 5) if i % 3 else ", A b b b\n x.") for i in range(120)} | {200: None, 201: "", 202: " \n", 203: "a b c d e a b c d e f", 204: "é" * 50, 205: "AAA aaa aAa " * 60}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def test_features():
    got = q.features([(t or "").encode() for t in TEXTS.values()])
    np.testing.assert_allclose(got, [features_by_hand(t) for t in TEXTS.values()], rtol=1e-12)


def labels_of(spark, flip=None):
    rows = [(i, int((i % 3 > 0) != (flip is not None and flip(i))), 0) for i in range(100)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_scores_are_those_of_the_risk_fitted_by_hand(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    part = q.fold("doc_id", 4)
    known = {r["doc_id"]: r["quality"] for r in labels_of(spark).where(part != 2).collect()}
    order = [r["doc_id"] for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    x = {i: features_by_hand(TEXTS[i]) for i in order}
    net = q.PuNet(np.array([x[i] for i in order if known.get(i) == 1]), np.array([x[i] for i in order if i not in known]), (sum(known.values()) + 1) / (len(known) + 2))
    want = dict(zip(order, net.score(np.array([x[i] for i in order])), strict=True))
    got = {r["doc_id"]: r for r in q.op6_quality_classifier(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert r["score"] == pytest.approx(want[i], abs=1e-6) and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == bool(docs.where(f"doc_id = {i}").select(part == 2).first()[0] if i < 3 else r["held_out"])


def test_held_out_labels_change_no_score(spark, docs, tmp_path):
    held = {r["doc_id"] for r in docs.where(q.fold("doc_id", 4) == 2).collect()}
    scores = []
    for name, flip in (("a", None), ("b", lambda i: i in held), ("c", lambda i: i not in held)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels_of(spark, flip).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        scores.append({r["doc_id"]: r["score"] for r in q.op6_quality_classifier(spark, f"{tmp_path}/{name}").collect()})
    assert scores[0] == pytest.approx(scores[1]) and scores[0] != pytest.approx(scores[2])
