"""The pipeline's stages on a small table with planted cases, and against their definitions."""

import pytest

import corpus_pipeline
from cairn.llm import packing
from tests.llm.test_operators import base_text, groups_by_hand, repeats_by_hand, rules_by_hand


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    one, passage = base_text(1), base_text(50, 60)
    texts = {i: base_text(i) for i in range(1, 40)}
    texts |= {40: one, 41: one + " tail", 42: "few words", 43: None, 44: base_text(44) + " " + passage + " " + base_text(45), 46: base_text(46) + " " + passage + " " + base_text(47)}
    texts |= {50 + i: base_text(200 + i).replace(" ", "### ") for i in range(20)}
    rows = [(k, t, "en", "s", len(t or ""), "clash") for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k < 50), 0) for k in texts if k % 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == before.columns
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
            docs = spark.createDataFrame(docs.collect(), before.schema)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(seen["quality rules"]) == {k for k, t in texts.items() if rules_by_hand(t)[0] >= 10 and k < 50}
    assert len(seen["quality classifier"]) > 0.9 * len(seen["quality rules"])
    groups = groups_by_hand(list(seen["quality classifier"].items()), 5, 80)
    assert set(seen["n-gram Jaccard join"]) == set(groups.values()) and not {40, 41} & set(groups.values())
    want = repeats_by_hand(list(seen["n-gram Jaccard join"].items()), corpus_pipeline.PASSAGE)
    assert seen["suffix-array dedup"] == {k: v[2].decode(errors="ignore") for (k, _), v in want.items()}
    if {44, 46} <= set(seen["n-gram Jaccard join"]):  # the classifier has little to learn from here
        assert len(seen["suffix-array dedup"][46]) < len(texts[46]) - 200
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(seen["suffix-array dedup"]) and all(r["length"] <= packing.WINDOW for r in pieces)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Null and repeated ids, ids with several texts, odd texts, and columns named as the stages' own."""
    d = str(tmp_path_factory.mktemp("odd"))
    one = base_text(1)
    rows = [(i, base_text(i), "s", 1) for i in range(2, 30)] + [(1, one, "s", 1), (1, one, "s", 2), (1, base_text(99), "s", 3), (40, one, "s", 1), (41, base_text(99), "s", 1), (None, one, "s", 1), (None, one, "s", 1), (None, None, "s", 1), (50, None, "s", 1), (51, "", None, 1), (52, " \n", None, None)]
    clash = ["key", "row", "kept", "place", "_doc", "_in", "score", "component_id", "n_words", "part", "token", "label"]
    spark.createDataFrame([(k, t, "en", s, n, *[f"v{n}"] * len(clash)) for k, t, s, n in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(2, 20)] + [(None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_on_odd_rows(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_folder)
        assert out.columns == docs.columns and out.schema == docs.schema or name == "suffix-array dedup"
        rows = out.collect()
        if name == "n-gram Jaccard join":
            ids = [r["doc_id"] for r in rows]
            # both texts of id 1 stay once, their copies under other ids go; rows without an id all stay
            assert sorted(r["text"] for r in rows if r["doc_id"] == 1) == sorted([base_text(1), base_text(99)])
            assert next(r["n_chars"] for r in rows if r["doc_id"] == 1 and r["text"] == base_text(1)) == 1
            assert not {40, 41} & set(ids) and ids.count(None) == sum(r["doc_id"] is None for r in before)
        before = rows
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd_folder).count() > 0


def test_empty_table(spark, odd_folder, tmp_path):
    spark.read.parquet(f"{odd_folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{odd_folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
