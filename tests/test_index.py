"""Indexes and maintained state: segments, block bounds, covers, vector cells, names, trigrams, generations, digests, sketches."""

import collections
import itertools
import math
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.functions import frames
from cairn.operators import aggregate, dictionary, digests, fulltext, lexical, rank, shelves, snapshot, trigrams, upsert, vector_index
from cairn.plans import search
from cairn.sources import versions

WORDS = [f"w{i}" for i in range(60)]


def texts_of(n, seed=0):
    r = random.Random(seed)
    return {i: " ".join(r.choices(WORDS, [1 / (k + 1) for k in range(60)], k=r.randrange(1, 40))) for i in range(n)}


def frame(spark, texts, deleted=()):
    return spark.createDataFrame([(i, t, False) for i, t in texts.items()] + [(i, None, True) for i in deleted], "id long, text string, deleted boolean")


# ---- full text


def covers_by_hand(text, terms):
    at = {t: [i for i, w in enumerate(re.findall(lexical.TERM, text.lower())) if w == t] for t in terms}
    found = sorted({(min(x), max(x)) for x in itertools.product(*at.values())})
    least = [c for c in found if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in found)]
    return sum(1 / (2 + e - b - len(terms)) for b, e in least)


def test_covers(spark):
    texts = texts_of(80, 1) | {900: "w0 w1 w0 w2 w1 w0", 901: None, 902: "", 903: "w0", 904: "W0 w1, w2!"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    for terms in (["w0"], ["w0", "w1"], ["w1", "w0", "w2"]):
        rows = [(0, 1.0, t, s, len(terms)) for s, t in enumerate(terms)]
        asked = spark.createDataFrame(rows, "variant int, weight double, term string, slot int, needed int")
        got = {r["id"]: r["score"] for r in fulltext.covers(fulltext.occurrences(docs, terms), asked, len(terms)).collect()}
        want = {i: s for i, t in texts.items() if t and (s := covers_by_hand(t, terms))}
        assert got == pytest.approx(want)
    assert fulltext.dense(docs, [("w0 w1", 1.0), ("w0 w1", 0.0), ("none", 1.0)]).count() == 40


def postings_of(spark, root):
    rows = fulltext.entries(spark, root, fulltext.rows(spark, root), places=True).select("term", "id", "tf", "length", "places").collect()
    return sorted((r["term"], r["id"], r["tf"], r["length"], tuple(r["places"])) for r in rows)


def test_segments_equal_a_fresh_index(spark, tmp_path):
    root, texts = str(tmp_path / "index"), texts_of(60)
    for n in range(4):
        fulltext.add(spark, root, frame(spark, {i: t for i, t in texts.items() if i % 4 == n}), number=n, block=16)
        fulltext.add(spark, root, frame(spark, {i: "again" for i in texts if i % 4 == n}), number=n)  # a stream's repeated batch
    before = {s["name"] for s in versions.current(spark, root)[1]["segments"]}
    changes = {3: "w1 new", 10: "", 77: "w0 w0"}
    fulltext.add(spark, root, frame(spark, changes, [5, 6]), number=4)
    assert before < {s["name"] for s in versions.current(spark, root)[1]["segments"]}  # none was rewritten
    texts = {i: t for i, t in (texts | changes).items() if i not in (5, 6)}
    fresh = str(tmp_path / "fresh")
    fulltext.add(spark, fresh, frame(spark, texts), block=16)
    want = postings_of(spark, fresh)
    df = lambda root: {r["term"]: r["df"] for r in fulltext.frequencies(spark, root, spark.createDataFrame([("w0",), ("new",), ("again",)], "term string")).collect()}
    assert postings_of(spark, root) == want and df(root) == df(fresh)
    assert fulltext.merge(spark, root) and not fulltext.merge(spark, root)
    state = versions.current(spark, root)[1]
    assert len(state["segments"]) == 2 and postings_of(spark, root) == want
    fulltext.vacuum(spark, root)
    assert postings_of(spark, root) == want and df(root) == df(fresh)


def test_bounds_skip_blocks_and_lose_nothing(spark, tmp_path):
    root, texts = str(tmp_path / "index"), texts_of(600, 3)
    for n in range(2):
        fulltext.add(spark, root, frame(spark, {i: t for i, t in texts.items() if i // 300 == n}), block=10)
    fulltext.add(spark, root, frame(spark, {7: "w0 w0 w0", 400: "w9"}, [8]))
    texts = {i: t for i, t in (texts | {7: "w0 w0 w0", 400: "w9"}).items() if i != 8}
    asks = {q: {t: 1.0 + q / 7 for t in random.Random(q).sample(WORDS[: 10 + q], 1 + q % 3)} for q in range(12)}
    asked = spark.createDataFrame([(q, t, w) for q, ts in asks.items() for t, w in ts.items()], "qid int, term string, weight double")
    best, report = fulltext.search(spark, root, asked, k=5)
    got = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in best.collect()}
    for q, ts in asks.items():
        scored = []
        for i, t in texts.items():
            tf = collections.Counter(t.split())
            s = round(sum(w * tf[x] / (1 + math.log(1 + len(t))) for x, w in ts.items()), 6)
            if s:
                scored.append((-s, i))
        for place, (s, i) in enumerate(sorted(scored)[:5], 1):
            assert got[q, place] == (i, pytest.approx(-s))
    cells = report.agg(F.sum("cells"), F.sum("cells_read")).first()
    assert cells[1] < 0.9 * cells[0]


def test_gate_then_dedupe_and_a_trusted_first(spark):
    hits = spark.createDataFrame([(1, 0.03, 2), (2, 0.029, 1), (3, 0.028, 5), (4, 0.02, None)], "id long, score double, lex_rank int")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id long, source string")
    got = {r["source"]: (r["id"], r["label"]) for r in rank.searched(hits, docs, "source", 3).collect()}
    assert got == {"a": (1, "medium"), "b": (2, "strong")}  # c fell to the gate before a gave its second place up


# ---- vectors


def vectors_of(spark, n, dims=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)) + 2.5 * r.normal(size=(12, dims))[r.integers(0, 12, n)]
    x[n // 2 : n // 2 + 30] = x[0]  # equal ones
    rows = [(i, v.tolist(), int(i % 7)) for i, v in enumerate(x)]
    odd = [(n, None, 0), (n + 1, [0.0] * dims, 0), (n + 2, [float("nan")] * dims, 0)]
    return x, spark.createDataFrame(rows + odd, "id long, vec array<double>, kind int")


def nearest_by_hand(x, q, k, ok):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit[q]
    return sorted(((-s, i) for i, s in enumerate(sims) if i != q and ok(i)))[:k]


def test_vector_cells(spark, tmp_path):
    root = str(tmp_path / "vectors")
    x, rows = vectors_of(spark, 3000)
    vector_index.build(spark, root, rows, ("kind",), cells=40, k=10)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), F.when(F.col("id") % 200 == 0, F.col("kind")).alias("kind"))
    want = {q: nearest_by_hand(x, q, 10, lambda i, q=q: q % 200 != 0 or i % 7 == q % 7) for q in range(0, 3000, 100)}
    for exact in (False, True):
        best, probed = vector_index.search(spark, root, asked, k=10, exact=exact)
        got = collections.defaultdict(list)
        for r in best.orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["id"], r["score"]))
        assert set(got) == set(want)
        for filtered in (False, True):
            qs = [q for q in want if (q % 200 == 0) == filtered]
            hit = sum(s >= -want[q][-1][0] - 1e-9 for q in qs for _, s in got[q])
            assert hit >= (10 if exact else 9) * len(qs)
        looked = probed.agg(F.avg("probed")).first()[0]
        assert exact or looked < 30  # of 40 cells
    assert all(len(g) == 10 for g in got.values())


def test_vector_cells_of_few_rows_and_rare_filters(spark, tmp_path):
    x, rows = vectors_of(spark, 200, seed=2)
    rare = rows.withColumn("kind", F.when(F.col("id") == 150, 99).otherwise(0))
    vector_index.build(spark, str(tmp_path / "a"), rare, ("kind",), cells=10, k=3)
    asked = rare.where("id = 4").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), F.lit(99).alias("kind"))
    best, probed = vector_index.search(spark, str(tmp_path / "a"), asked, k=3)
    assert [r["id"] for r in best.collect()] == [150] and probed.first()["probed"] == 10  # all cells, as too few pass
    vector_index.build(spark, str(tmp_path / "b"), rows.limit(0), (), k=3)
    assert vector_index.search(spark, str(tmp_path / "b"), asked.drop("kind"), k=3)[0].count() == 0


# ---- names and substrings


def test_names_both_ways(spark):
    r = random.Random(5)
    names = [(f"e{i % 20}", "".join(r.choice("abé ") for _ in range(r.randrange(0, 7)))) for i in range(120)] + [("e0", None), ("e1", "AB"), ("e2", "ab"), ("e2", "ab")]
    texts = [(i, "".join(r.choice("abÉ cA") for _ in range(r.randrange(0, 50)))) for i in range(80)] + [(900, None), (901, "")]
    table, docs = spark.createDataFrame(names, "entity string, name string"), spark.createDataFrame(texts, "id long, text string")
    want = collections.Counter()
    for e, n in {(e, n.lower()) for e, n in names if n and len(n) > 1}:
        for i, t in texts:
            if t and (k := len(re.findall(f"(?={re.escape(n)})", t.lower()))):
                want[i, e] += k
    for most in (1 << 20, 0):
        assert {(r["id"], r["entity"]): r["n"] for r in dictionary.mentions(docs, table, most).collect()} == want
        assert dictionary.mentions(docs, table.limit(0), most).count() == 0
        assert dictionary.mentions(docs.limit(0), table, most).count() == 0


def test_window_hashes():
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=300)), np.uint8)
    for size in range(1, 20):
        h = dictionary.window_hashes(data, size)
        same = collections.defaultdict(set)
        for i, x in enumerate(h.tolist()):
            same[data[i : i + size].tobytes()].add(x)
        assert len(h) == 301 - size and all(len(x) == 1 for x in same.values()) and len(set(h.tolist())) == len(same)


def test_substrings(spark, tmp_path):
    r = random.Random(6)
    texts = [(i, "".join(r.choice("abAB%_é\n") for _ in range(r.randrange(0, 30)))) for i in range(300)] + [(900, None)]
    docs = spark.createDataFrame(texts, "id long, text string")
    trigrams.build(docs, str(tmp_path / "t"))
    patterns = ["%aba%", "ab%ba", trigrams.containing("a_b"), trigrams.containing("%b"), "%a_é%", "%", "_", trigrams.containing("bé\na")]
    got = collections.Counter((r["pattern"], r["id"]) for r in trigrams.matches(spark, str(tmp_path / "t"), docs, patterns).collect())
    want = collections.Counter((i, r["id"]) for i, p in enumerate(patterns) for r in docs.where(F.ilike("text", F.lit(p))).collect())
    assert got == want
    found, without = trigrams.candidates(spark, str(tmp_path / "t"), patterns)
    assert without == [1, 3, 4, 5, 6] and found.where("pattern = 0").count() < 150
    assert trigrams.literals(r"%a\%b_c\\%") == ["a%b", "c\\"]


def test_trigrams_of_a_text_that_comes_twice_and_of_rare_characters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "GROUP", 20)
    texts = [(1, "a😀b😀c"), (1, "xa😀b"), (2, "ab"), (3, ""), (4, "İSTANBUL xyz"), (5000, "A😀B"), (-3, "xyz"), (None, "xyz")]
    docs = spark.createDataFrame(texts, "id long, text string")
    trigrams.build(docs, str(tmp_path / "t"))
    patterns = ["%a😀b%", "%xyz%", "%stan%"]
    got = collections.Counter((r["pattern"], r["id"]) for r in trigrams.matches(spark, str(tmp_path / "t"), docs, patterns).collect())
    assert got == {(0, 1): 2, (0, 5000): 1, (1, 4): 1, (1, -3): 1, (2, 4): 1}  # rows of id 1 counted each gram twice before, so none was found
    assert sorted(trigrams._spelled(trigrams._grams("a😀bca😀b"))) == ["a😀b", "bca", "ca😀", "😀bc"]


# ---- state


def chunked(docs):
    return docs.select("key", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("ordinal", "word"))


def batch(spark, rows):
    return spark.createDataFrame(rows, "key long, text string, lang string, arrived int, deleted boolean")


def test_generations(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    apply = lambda rows: snapshot.apply(spark, root, batch(spark, rows), chunked, fill=("lang",))
    state = lambda: ({r["key"]: (r["text"], r["lang"], r["generation"]) for r in snapshot.documents(spark, root).collect()}, collections.Counter(r["key"] for r in snapshot.chunks(spark, root).collect()))
    assert snapshot.documents(spark, root) is None
    apply([(1, "a b", "en", 1, False), (1, "late c d", "de", 2, False), (2, "x", "en", 1, False), (3, None, None, 1, False), (9, "never", None, 1, True)])
    first = {1: ("late c d", "de", 1), 2: ("x", "en", 1), 3: (None, None, 1)}, {1: 3, 2: 1, 3: 1}
    assert state() == first
    change = [(1, "new", None, 3, False), (2, None, None, 3, True), (4, "f g", "fr", 3, False), (3, None, "en", 3, False)]

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", killed)
        with pytest.raises(RuntimeError, match="killed"):
            apply(change)
    assert state() == first  # what a killed apply leaves doesn't count
    apply(change)
    second = {1: ("new", "de", 2), 3: (None, None, 1), 4: ("f g", "fr", 2)}, {1: 1, 3: 1, 4: 2}
    assert state() == second
    apply([(2, "back", None, 4, False), (4, "f g", "fr", 4, False)])
    third = {**second[0], 2: ("back", None, 3)}, {**second[1], 2: 1}
    assert state() == third
    snapshot.compact(spark, root)
    assert state() == third and len(versions.current(spark, root)[1]["generations"]) == 1
    snapshot.vacuum(spark, root)
    assert state() == third
    apply([(1, None, None, 5, True)])
    assert 1 not in state()[0] and state()[1][1] == 0


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "v")
    assert versions.current(spark, root) == (0, {})
    assert versions.commit(spark, root, {"a": 1}, 0) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        versions.commit(spark, root, {"a": 2}, 0)
    assert versions.current(spark, root) == (1, {"a": 1})


def test_digest_trees(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id AS k", "id % 10 AS v", "CAST(NULL AS STRING) AS s")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    digests.write(rows, "k", ["v", "s"], a)
    digests.write(rows.where("k <> 7").withColumn("v", F.when(F.col("k") == 4000, 77).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(9999, 1, "x")], "k long, v long, s string")), "k", ["v", "s"], b)
    assert sorted(map(tuple, digests.difference(spark, a, b).collect())) == [("4000", "both"), ("7", "a"), ("9999", "b")]
    leaves = digests.differing(spark, a, b)
    assert len(leaves) == 3 and digests.rows_of(spark, a, leaves).count() < 30  # of 5000
    assert digests.difference(spark, a, a).count() == 0


def test_sketches_batch_and_stream(spark, tmp_path):
    r = np.random.default_rng(1)
    values = r.gamma(2, size=30_000)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, value double").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("i") * 3)).withColumn("k", F.lit("x"))
    hourly = aggregate.hourly_sketches(rows, "ts", "value", "k")
    got = {x["hours"]: x for x in aggregate.rolling(hourly, [1, 24], [0.5, 0.95], "k").collect()}
    last = hourly.agg(F.max("hour")).first()[0]
    for hours in (1, 24):
        span = sorted(x["value"] for x in rows.where(F.col("ts") >= F.lit(last) - F.expr(f"INTERVAL {hours - 1} HOURS")).collect())
        assert got[hours]["n"] == len(span)
        for p in (0.5, 0.95):
            place = np.searchsorted(span, got[hours][f"p{round(100 * p)}"]) / len(span)
            assert abs(place - p) < 0.005
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = aggregate.hourly_sketches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "value", "k")
    q = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    merged = {x["hours"]: (x["n"], x["p50"]) for x in aggregate.rolling(spark.table("hourly"), [1, 24], [0.5], "k").collect()}
    assert merged[1] == (got[1]["n"], got[1]["p50"]) and merged[24][0] == got[24]["n"]


# ---- rules mended


def test_each_counter_signal_counts(spark):
    rows = [(["disk full", "io error"], ["net down", "link  LOST lost"], ["disk", "io", "net", "lost"], 0.9), (["a b c d"], [], ["aa"], None), (["aa bb"], [], ["aa"], 0.0)]
    df = spark.createDataFrame(rows, "signals array<string>, counter array<string>, obs array<string>, confidence double")
    score, label = rank.bucket_match(rank.signal_tokens(F.col("signals")), rank.signal_tokens(F.col("counter")), F.col("obs"), F.col("confidence"))
    assert [tuple(r) for r in df.select(score, label).collect()] == [(0.0, "not-recommended"), (0.2, "not-recommended"), (0.8, "possible")]


def test_components_keep_their_order(spark):
    df = spark.createDataFrame([("BGP flap on Linux host", ""), ("Network", "BGP of SCP"), (None, None)], "title string, body string")
    assert [r[0] for r in df.select(frames.components(F.col("title"), F.col("body"))).collect()] == [["Linux", "Network"], ["Network", "SCP"], []]


def test_the_last_to_arrive_counts(spark):
    rows = spark.createDataFrame([(1, "ff", 1), (1, "aa", 2), (2, "bb", None), (2, "aa", 1)], "k long, content_hash string, at int")
    assert {r["k"]: r["content_hash"] for r in upsert.latest(rows, ["k"], "at").collect()} == {1: "aa", 2: "aa"}
    assert {r["k"]: r["content_hash"] for r in upsert.latest(rows, ["k"]).collect()} == {1: "ff", 2: "bb"}


def test_tallies_hand_on_full_groups(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(aggregate, "HELD", 2)
    rows = pa.RecordBatch.from_pydict({"_id": [5, 1, 3, 2, None], "a": ["x", "x", "x", "y", None], "b": ["1", "2", "1", "1", "1"]})
    out = [tuple(r.values()) for b in aggregate._tallied([rows, rows.slice(1, 2)], ["a", "b"], 2) for r in b.to_pylist()]
    assert sorted(out, key=str) == sorted([("a", "x", 3, [1, 3]), ("a", "y", 1, [2]), ("a", None, 1, []), ("b", "1", 4, [2, 3]), ("b", "2", 1, [1]), ("a", "x", 2, [1, 3]), ("b", "2", 1, [1]), ("b", "1", 1, [3])], key=str)


def test_attachments_of_diagrams(spark):
    from cairn.functions import diagrams

    macro = '<ac:structured-macro ac:name="drawio"><ac:parameter ac:name="diagramName">{}</ac:parameter></ac:structured-macro>'
    pages = spark.createDataFrame([(1, macro.format(" A ") + "<p>" + macro.format("b.c")), (2, None), (3, '<ac:structured-macro ac:name="drawio"><x></ac:structured-macro>' + macro.format("q"))], "page_id long, body string")
    titles = {1: ["A.png", "a.XML", "A", "~A.tmp", "A.drawio", "B.C.drawio", "b.c"], 2: ["only.drawio"], 3: ["q.png", "r.drawio"]}
    files = spark.createDataFrame([(p, 10 * p + i, i, t) for p, ts in titles.items() for i, t in enumerate(ts)], "page_id long, attachment_id long, ordinal int, title string")
    got = sorted(map(tuple, diagrams.diagrams(pages, files).collect()), key=str)
    assert got == sorted([(1, "A", 14, True), (1, "b.c", 16, True), (1, "B.C", 15, False), (2, "only", 20, False), (3, "q", None, True), (3, "r", 31, False)], key=str)


def test_reindexing_follows_meaning(spark):
    log = [(1, 1, 0, "a", None, None, True), (1, 2, 0, "a", None, " Prod ", False), (1, 2, 1, "b", None, None, True), (2, 1, 0, None, "x", "", True), (3, 1, 0, None, None, None, True)]
    schema = "k long, ts int, seq int, signal string, counter_signal string, environment string, confirm boolean"
    now = upsert.refinements(spark.createDataFrame(log, schema), "k")
    assert {r["k"]: (r["signals"], r["counter_signals"], r["environment"], r["support"], r["counter"], r["confidence"]) for r in now.collect()} == {1: (["a", "b"], [], "prod", 2, 1, 0.6), 2: ([], ["x"], None, 1, 0, 0.667), 3: ([], [], None, 1, 0, 0.667)}
    later = log + [(1, 3, 0, "b", None, "test", True), (2, 3, 0, None, "y", None, True), (3, 3, 0, None, None, None, False), (4, 3, 0, None, None, None, True)]
    after = upsert.refinements(spark.createDataFrame(later, schema), "k")
    assert {r["k"]: r["action"] for r in upsert.reindexing(now, after, "k").collect()} == {1: "patch", 2: "chunk", 3: "none", 4: "chunk"}


def test_weights_of_variants(spark):
    weigh = lambda v: rank.variant_weight(v, "the question")
    assert [weigh(v) for v in ("the question", "see ABC-123", "a b c", "a b", "word", "")] == [1.0, 1.15, 0.95, 0.85, 0.55, 0.0]
    df = spark.createDataFrame([(0, 0.55, 30, 100), (1, 0.55, 20, 100), (2, 0.85, 90, 100), (3, 0.55, None, 100)], "variant int, w double, df long, texts long")
    assert {r["variant"]: r["w"] for r in rank.frequent_singles_down(df).collect()} == {0: 0.25, 1: 0.55, 2: 0.85, 3: 0.55}


def test_blocks_of_vectors_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array([[1.0, 2.0]] * 2500)], names=["id", "vec"])
    blocks = list(rank._blocks([batch]))
    assert [len(b.column("ids")[0]) for b in blocks] == [1024, 1024, 452]


def test_pairs_of_blocks_reach_a_worker_in_bounded_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rank.vector_top(spark.createDataFrame([(1, [1.0])], "id long, vec array<double>"), spark.createDataFrame([(2, [1.0])], "query_id long, query_vec array<double>"), 1)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == rank.BATCH_BYTES


def test_bitmap_in_a_fresh_worker():
    """A worker has imported what the module itself imports, nothing else."""
    code = (
        "import sys, pyarrow as pa; from cairn.operators import dictionary as d;"
        "b = pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([7], pa.int64())], names=['size', 'h']); assert next(d._bitmap([b])).num_rows == 1"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_shared_names_count_once_for_the_automaton(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "about Seoul")], "id long, text string")
    table = spark.createDataFrame([(f"e{i}", "seoul") for i in range(9)], "entity string, name string")
    monkeypatch.setattr(dictionary, "_hashed_names", None)  # 5 bytes of distinct names, 45 with their entities
    assert sorted(r["entity"] for r in dictionary.mentions(texts, table, most=10).collect()) == [f"e{i}" for i in range(9)]


def test_questions_in_slices_leave_no_cells(spark, tmp_path):
    root = str(tmp_path / "index")
    fulltext.add(spark, root, frame(spark, texts_of(300, 7)), block=16)
    asked = spark.createDataFrame([(f"q{i}", f"w{(i + j) % 9}", 1.0) for i in range(30) for j in range(2)], "qid string, term string, weight double")
    whole, report = (sorted(map(tuple, x.collect())) for x in fulltext.search(spark, root, asked, k=5))
    sliced = fulltext.search(spark, root, asked, k=5, most=3000)
    assert [sorted(map(tuple, x.collect())) for x in sliced] == [whole, report]
    place = Path(sliced[0].inputFiles()[0].removeprefix("file://")).parents[1]
    assert not list((place / "slice").iterdir())


def test_a_sample_meets_centres_in_steps(monkeypatch):
    r = np.random.default_rng(3)
    x, centres = r.normal(size=(1500, 8)), r.normal(size=(7, 8))
    monkeypatch.setattr(vector_index, "STEP", 10**6)
    whole = vector_index._nearest(x, centres)
    monkeypatch.setattr(vector_index, "STEP", 100)
    assert all(np.allclose(a, b) for a, b in zip(whole, vector_index._nearest(x, centres), strict=True))


def test_no_side_of_queries_is_broadcast(spark, tmp_path):
    root, r = str(tmp_path / "vectors"), np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(200, 6)))], "id long, vec array<double>")
    vector_index.build(spark, root, rows, cells=6, k=3)
    best, probed = vector_index.search(spark, root, rows.where("id % 9 = 0").toDF("query_id", "query_vec"), k=3, exact=True)
    assert best.groupBy("query_id").count().where("count = 3").count() == 23
    assert "BroadcastHashJoin" not in best._jdf.queryExecution().executedPlan().toString()


def test_a_segment_packs_the_rows_of_a_block(spark, tmp_path):
    root, r = str(tmp_path / "index"), random.Random(9)
    texts = {i: " ".join(f"t{r.randrange(900)} 가나{r.randrange(9)}, É{r.randrange(300)}x" for _ in range(40)) for i in range(-20, 100)}
    fulltext.add(spark, root, frame(spark, texts | {500: None, 501: "", 502: "-"}), block=16)
    changed = {i: f"again {t}" for i, t in texts.items() if i % 9}
    fulltext.add(spark, root, frame(spark, changed))
    fulltext.add(spark, root, frame(spark, {}, [3, 4, 9999]))  # deletions alone
    kept = {i: t for i, t in (texts | changed).items() if i not in (3, 4)}
    want = collections.Counter()
    for i, t in kept.items():
        want.update((x, i) for x in re.findall(lexical.TERM, t.lower()))
    name = versions.current(spark, root)[1]["segments"][0]["name"]
    packed, terms = spark.read.parquet(f"{root}/segments/{name}").count(), len({x for x, _ in want})
    assert packed <= fulltext.BUCKETS * 9 and terms > 1000  # a row for each term and block before
    for n_segments in (3, 2):
        assert len(versions.current(spark, root)[1]["segments"]) == n_segments
        rows = fulltext.live(spark, root).collect()
        assert {(x["term"], x["id"]): x["tf"] for x in rows} == want and len(rows) == len(want)
        assert all(x["length"] == len(kept[x["id"]]) for x in rows)
        assert postings_of(spark, root) == sorted((t, i, n, len(kept[i]), tuple(p for p, x in enumerate(re.findall(lexical.TERM, kept[i].lower())) if x == t)) for (t, i), n in want.items())
        one = fulltext.entries(spark, root, fulltext.rows(spark, root, ["again", "가나1"], ("ids", "lengths", "tfs"))).select("term", "id", "tf").collect()
        assert {(x["term"], x["id"]): x["tf"] for x in one} == {k: n for k, n in want.items() if k[0] in ("again", "가나1")}
        fulltext.merge(spark, root, fan=2)


def test_questions_over_shelves_equal_reading_everything(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shelves, "TEXTS", 16)
    monkeypatch.setattr(shelves, "FEWEST", 3)
    r, texts = random.Random(11), texts_of(400, 11)
    texts |= {1000 + i: " ".join(r.choices(WORDS, k=r.randrange(300, 900))) for i in range(40)} | {2000 + i: texts[7] for i in range(60)}
    texts |= {3000: None, 3001: "", 3002: "-", 3003: "W59 w59 only"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    place = str(tmp_path / "shelves")
    shelves.write(docs, place)
    counts = {i: collections.Counter(re.findall(lexical.TERM, t.lower())) for i, t in texts.items() if t}
    df = collections.Counter(t for c in counts.values() for t in c)
    assert {x["term"]: x["df"] for x in shelves.frequencies(spark, place).collect()} == df
    asks = {f"q{q}": {t: 0.5 + r.random() for t in r.sample(WORDS, r.choice([1, 3, 30, 60]))} for q in range(25)} | {"rare": {"only": 2.0}, "none": {"absent": 1.0}}
    asked = spark.createDataFrame([(q, t, w) for q, ts in asks.items() for t, w in ts.items()], "qid string, term string, weight double")
    got = {(x["qid"], x["rank"]): (x["id"], x["score"]) for x in shelves.search(spark, place, asked, k=9).collect()}
    want = {}
    for q, ts in asks.items():
        scored = [(-round(sum(w * c[t] / (1 + math.log(1 + len(texts[i]))) for t, w in ts.items()), 6), i) for i, c in counts.items() if any(t in c for t in ts)]
        want |= {(q, place): (i, -s) for place, (s, i) in enumerate(sorted(scored)[:9], 1)}
    assert {k: i for k, (i, _) in got.items()} == {k: i for k, (i, _) in want.items()} and all(got[k][1] == pytest.approx(s) for k, (_, s) in want.items())
    assert shelves.search(spark, place, asked.limit(0)).count() == 0


def test_shelves_that_cannot_matter_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shelves, "RUN", 2000)
    place, read = str(tmp_path / "shelves"), []
    shelves.write(spark.createDataFrame([(i, "w0 " * (1 + i // 2)) for i in range(200)], "id long, text string"), place)
    files, whole = shelves._files(spark, place), shelves._read
    monkeypatch.setattr(shelves, "_read", lambda uri, columns: (read.append((uri, len(columns))), whole(uri, columns))[1])
    found = shelves._answered(pa.table({"qid": ["a"], "term": ["w0"], "weight": [1.0]}), files, 4)
    assert found.column("id").to_pylist() == [198, 199, 196, 197] and found.column("rank").to_pylist() == [1, 2, 3, 4]
    assert len(files) > 4 and [u for u, n in read if n > 2] == files[:1]


def test_all_terms_of_a_question_count(spark, tmp_path):
    words = "aa bb cc dd ee ff gg hh ii".split()
    spark.createDataFrame([(i, " ".join(words[i:])) for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")  # the last word is in all texts
    spark.createDataFrame([("c", 1, "user", " ".join(words)), ("c", 2, "system", "ii")], "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(r["id"] for r in search.r01_many_questions(spark, str(tmp_path)).collect()) == list(range(9))
    root = search.index(spark, str(tmp_path))
    assert sorted(r["term"] for r in search.questions(spark, str(tmp_path), root).collect()) == words


def test_few_windows_without_a_name_pass():
    r = random.Random(2)
    names = sorted({"".join(r.choices("abcdefgh ", k=r.randrange(8, 60))) for _ in range(40000)})
    hashed = list(dictionary._hashed_names([pa.RecordBatch.from_pydict({"name": names})]))
    known = np.zeros(1 << dictionary.WORDS, np.uint64)
    for b in dictionary._bitmap(dictionary._hashed_beginnings(hashed)):
        known[b.column("word").to_numpy()] = b.column("bits").to_numpy().view(np.uint64)
    texts = ["".join(r.choices("abcdefgh ", k=400)) for _ in range(1000)] + [f"é{n}é" for n in names[::400]] + ["", None, names[0] + names[1]]
    bits = type("Sent", (), {"value": known})
    found = [x for b in dictionary._windows([pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})], sorted({len(n) for n in names}), bits) for x in b.to_pylist()]
    want = {(i, n) for i, t in enumerate(texts[1000:], 1000) if t for n in names if n in t}
    assert want <= {(x["id"], x["window"].decode()) for x in found}
    assert len(found) < len(want) + 100  # of some 20 million windows; 11,469 of the first thousand texts passed before
