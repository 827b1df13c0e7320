"""Every opN_ query on one small folder of tables, against plain Python."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from cairn.llm import entries
from cairn.llm.toxicity import fold
from pyspark.sql import functions as F
from tests.llm.test_operators import base_text, groups_by_hand, repeats_by_hand, rules_by_hand, sets_by_hand


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables with nulls, odd texts, repeated rows and columns that clash with the results' names."""
    d = str(tmp_path_factory.mktemp("tables"))
    one = base_text(1)
    texts = {i: base_text(i, 40) + (" foul vile" * 4 if i % 6 == 0 else "") for i in range(2, 90)}
    texts |= {1: one, 100: one, 101: one + " tail", 102: None, 103: "", 104: " \n", 105: base_text(2, 6000), 106: base_text(7) + " " + one[:300], 107: "<|endoftext|> x ## **\n" * 9}
    rows = [(k, t, "s", 1) for k, t in texts.items()] + [(1, one, "again", None), (None, one, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score int")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 != 0), int(k % 6 == 0)) for k in texts if k < 90] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    long = "y" * 1500
    spark.createDataFrame([(1, "u", long), (2, "u", long), (3, None, None), (4, "", "z"), (5, "u", "z")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    v = np.random.default_rng(3).normal(size=(120, 8)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)] + [(200, None, 1), (250, [0.0] * 8, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, [(r["doc_id"], r["text"]) for r in docs.collect()], v


def rows_of(spark, tables, name):
    return entries.QUERIES[name](spark, tables[0]).collect()


def test_op1(spark, tables):
    rows, names = rows_of(spark, tables, "op1_quality_rules"), ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collections.Counter(tuple(r[c] for c in names) for r in rows) == collections.Counter((k, *rules_by_hand(t)) for k, t in tables[1])
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)


def library_ids(name, specials_as_text=True):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = specials_as_text
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, tables):
    rows, ids = rows_of(spark, tables, "op2_token_store"), library_ids("word_bpe_49k.json")
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == collections.Counter((k, len(x), crc(x)) for k, x in ((k, [*ids(t), 1]) for k, t in tables[1]))
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda k: (k is not None, k or 0))


def test_op3(spark, tables):
    rows, ids = rows_of(spark, tables, "op3_packing"), library_ids("byte_bpe_50k.json")
    want = collections.defaultdict(list)
    for k, t in tables[1]:
        want[k].append([*ids(t), 0])
    pieces = collections.Counter()
    for r in rows:
        whole = next(x for x in want[r["doc_id"]] if len(x) == r["doc_tokens"])
        assert crc(whole[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {k: sum(map(len, x)) for k, x in want.items()}
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s)])[:-1].tolist() and sum(n for _, n in s) <= 1024


@pytest.mark.parametrize("name, folds, held, cut, label", [("op4_toxicity", 5, 0, 0.5, "toxic"), ("op6_quality_classifier", 4, 2, 0.7, "quality")])
def test_op4_and_op6(spark, tables, name, folds, held, cut, label):
    rows = rows_of(spark, tables, name)
    assert len(rows) == len(tables[1])
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_scores_look_at_texts_alone(spark, tables, tmp_path):
    """Labels of held-out rows and other columns change no score."""
    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{tables[0]}/{t}.parquet")
        out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
        df = df.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))) if t == "labels" else df.withColumns({"score": F.lit(7), "n_tokens": F.lit("other")})
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    before, after = (collections.Counter((r["doc_id"], round(r["score"], 9)) for r in entries.QUERIES["op4_toxicity"](spark, d).collect()) for d in (tables[0], str(tmp_path)))
    assert before == after


def test_op5(spark, tables):
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows_of(spark, tables, "op5_warc")}
    assert got == {(1, 1500, "revisit", 2), (2, 1500, "response", None), (3, 0, "response", None), (4, 1, "response", None), (5, 1, "response", None)}


def test_op7(spark, tables):
    want = repeats_by_hand(tables[1])
    for r in rows_of(spark, tables, "op7_suffix_array_dedup"):
        texts = [t for k, t in tables[1] if k == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) in {(n, s, hashlib.sha256(kept).hexdigest()) for n, s, kept in (want[r["doc_id"], t] for t in texts)}


def test_op8(spark, tables):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter((k, len(x), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for k, t, x in ((k, t, enc.encode_ordinary(t or "")) for k, t in tables[1]))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(spark, tables, "op8_byte_bpe")) == want


def test_op9(spark, tables):
    v = tables[2].astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = sorted(rows_of(spark, tables, "op9_nearest_neighbours"), key=lambda r: (r["query_id"], r["rank"]))
    for q in (0, 50, 100):
        s = u @ u[q]
        s[q] = -9
        assert [(r["rank"], r["vec_id"]) for r in rows if r["query_id"] == q] == list(enumerate(np.argsort(-s)[:5].tolist(), 1))
    assert len(rows) == 15


def test_op10(spark, tables):
    want = groups_by_hand(tables[1], 4, 85)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(spark, tables, "op10_ngram_jaccard_join"))
    assert got == collections.Counter((k, len(sets_by_hand(t, 4)), want.get(k)) for k, t in tables[1])
