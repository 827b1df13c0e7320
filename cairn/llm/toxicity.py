"""Toxicity by class-conditional Kneser-Ney word models with shared backoff counts.

For each class k (toxic, ordinary) with T_k words, a word w counted c_k(w) times has the probability

    P_k(w) = (max(c_k(w) - D, 0) + F_k P(w)) / T_k         F_k: all that the discount D takes from the class

and the backed-off P is common to both classes. It comes from continuation counts n (distinct words before, in
all labelled texts), for words and then for their stems of 6, 5 and 4 bytes:

    P(w) = (max(n(w) - d, 0) + f P(s) / m(s)) / N          m(s): kinds of words with the stem s, f: all that d takes

and so on from stem to shorter stem, uniform at last. So a rare expression needs more in one class than its share of
the common counts before it speaks. A text's evidence is its length-normalised log-likelihood ratio, over the whole text and
over its most toxic windows, and how many words speak how strongly; a logistic curve, fitted on labelled rows that
the counts have not seen, turns it into a score.

All labelled training rows are counted and every count is kept; a word whose discounted counts are 0 in both classes has the
ratio of a new word, so only the others are looked up. The tables stay distributed: they are dealt into parts by key, texts are
scored in blocks, and a block asks each part for its distinct words. A task holds one part or one block at a time; the
parts grow in number with the rows. Edge cases: null, empty and wordless texts have no evidence and get the score of that;
repeated rows are scored each; without labels of both classes every score is 0.5; an empty table gives an empty result; labels
of several rows count each; a null doc_id is scored but never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tables import least_hashed, stored, table
from cairn.llm.textnum import GROUP, NOT_WORD, Words, grouped, mix, span_hashes

#: Discounts of a count in a class, and of a continuation count. Held-out quality chose the first (README).
DISCOUNT, CONTINUED = 2.0, 0.75
STEMS = (6, 5, 4)
#: Words of a window, and labelled rows at most that fit the logistic curve.
WINDOWS, CURVE_ROWS = (1, 4, 16), 20_000
#: Words that a task counts before it hands them on; bytes of a block of texts; rows for each part of the tables.
HELD, BLOCK, PART_ROWS = 1_000_000, 8_000_000, 8192
#: Bytes that tell the words before one word apart, and parts among which its pairs are dealt.
BEFORE, SPREAD = 5, 16
#: Ratios from which a word counts as a hit, and the most that one word can say.
HITS, MOST = (1, 2, 3, 4), 8.0
FEATURES = ("whole", *(f"window_{w}" for w in WINDOWS), *(f"hits_{h}" for h in HITS))


def fold(doc_id: str | Column, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def _compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([pack(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "packed"])


def _squeezed(values: np.ndarray) -> bytes:
    """An array of numbers, equal bytes of all values side by side, compressed."""
    import zstandard

    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=3).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _loosened(packed: bytes, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _keys_squeezed(keys: np.ndarray) -> bytes:
    return _squeezed(np.diff(keys, prepend=np.int64(0)))


def _keys_loosened(packed: bytes) -> np.ndarray:
    return np.cumsum(_loosened(packed, np.int64))


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ascending keys by the part of the tables they belong to, and where each part begins in it."""
    part = ((mix(keys.view(np.uint64)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _keys(words: Words, ends: np.ndarray) -> np.ndarray:
    return span_hashes(words.data, words.starts, ends).view(np.int64)


_STEM_COLUMNS = tuple(f"stem{n}" for n in STEMS)
_PACKED = "part int, words binary, counts binary, keys binary, heads binary, before binary"
_WORD = "key long, " + ", ".join(f"{c} long" for c in _STEM_COLUMNS) + ", toxic long, ordinary long, n long"


def _spread(w: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Keys by which the pairs of a word are dealt: a frequent word's go to SPREAD parts."""
    return (w.view(np.uint64) + (before % np.uint64(SPREAD)) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def _counted(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """What a task holds, packed for each part: its words with counts in both classes, and the distinct pairs of a word
    and the one before (BEFORE bytes of its hash), as words, how many pairs each has, and these."""
    import zstandard

    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
    held: list[tuple[np.ndarray, ...]] = []
    names: dict[int, bytes] = {}

    def dealt(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
        order, at = _dealt(keys, parts)
        return [(p, order[at[p] : at[p + 1]]) for p in np.flatnonzero(np.diff(at)).tolist()]

    def out() -> pa.RecordBatch:
        w, before, t = (np.concatenate(x) for x in zip(*held, strict=True))
        rows: dict[int, list] = {}
        keys, place = np.unique(w, return_inverse=True)
        toxic, both = np.bincount(place, t, len(keys)).astype(np.int64), np.bincount(place, minlength=len(keys))
        for p, x in dealt(keys):
            text, at = zip(*sorted((names[k], i) for k, i in zip(keys[x].tolist(), x.tolist(), strict=True)), strict=True)
            at = np.array(at)
            rows[p] = [pack(b" ".join(text)), _squeezed(np.stack([toxic[at], (both - toxic)[at]])), b"", b"", b""]
        by = np.lexsort((before, w))
        w, before = w[by], before[by]
        new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (before[1:] != before[:-1])]))
        w, before = w[new], before[new]
        for p, x in dealt(_spread(w, before)):
            x = np.sort(x)  # words ascend again
            head, n = np.unique(w[x], return_counts=True)
            flat = np.ascontiguousarray(before[x].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BEFORE])
            rows.setdefault(p, [b"", b"", b"", b"", b""])[2:] = _keys_squeezed(head), _squeezed(n), flat.tobytes()
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows.values(), strict=True))], names=[c.split()[0] for c in _PACKED.split(", ")])

    size = 0
    for b in batches:
        texts, flags = [unpack(p) for p in b.column("packed").to_pylist()], b.column("toxic").to_numpy()
        for x in range(0, len(texts), 200):
            words = Words(texts[x : x + 200], NOT_WORD)
            if len(words.starts):
                w = _keys(words, words.ends)
                before = np.zeros(len(w), np.uint64)
                before[1:] = np.where(words.text[1:] == words.text[:-1], w[:-1].view(np.uint64) >> np.uint64(64 - 8 * BEFORE), 0)
                held.append((w, before, flags[x : x + 200][words.text].astype(np.int64)))
                size += len(w)
                keys, first = np.unique(w, return_index=True)
                raw = words.data.tobytes()
                for k, s, e in zip(keys.tolist(), words.starts[first].tolist(), words.ends[first].tolist(), strict=True):
                    if k not in names:
                        names[k] = raw[s:e]
            if size > HELD:
                yield out()
                held, names, size = [], {}, 0
    if held:
        yield out()


def _summed(rows: pa.Table) -> pa.Table:
    """Of one part: its words with stems and summed counts; and how many distinct pairs here have which second word."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    packed = [(w, c) for w, c in zip(rows.column("words").to_pylist(), rows.column("counts").to_pylist(), strict=True) if w]
    words = Words([unpack(w) for w, _ in packed], NOT_WORD)
    toxic, ordinary = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip((np.zeros(0, np.int64),) * 2, *(_loosened(c, np.int64).reshape(2, -1) for _, c in packed), strict=True))
    w = _keys(words, words.ends)
    stems = [_keys(words, np.minimum(words.ends, words.starts + n)) for n in STEMS]
    keys, first, place = np.unique(w, return_index=True, return_inverse=True)
    zero, none = np.zeros(len(keys), np.int64), pa.nulls
    own = [keys, *(s[first] for s in stems), *(np.bincount(place, x, len(keys)).astype(np.int64) for x in (toxic, ordinary)), zero]

    pairs = [p for p in zip(*(rows.column(c).to_pylist() for c in ("keys", "heads", "before")), strict=True) if p[0]]
    second = np.concatenate([np.zeros(0, np.int64), *(np.repeat(_keys_loosened(k), _loosened(n, np.int64)) for k, n, _ in pairs)])
    flat = np.zeros((len(second), 8), np.uint8)
    flat[:, :BEFORE] = np.frombuffer(b"".join(b for _, _, b in pairs), np.uint8).reshape(-1, BEFORE)
    before = flat.view("<u8").ravel()
    by = np.lexsort((before, second))
    second, before = second[by], before[by]
    new = np.concatenate([[True], (second[1:] != second[:-1]) | (before[1:] != before[:-1])])[: len(second)]
    then, n = np.unique(second[new], return_counts=True)
    nulls = none(len(then), pa.int64())
    zero = pa.array(np.zeros(len(then), np.int64))
    both = [pa.chunked_array([pa.array(a), b]) for a, b in zip(own, [pa.array(then), *[nulls] * len(STEMS), zero, zero, pa.array(n.astype(np.int64))], strict=True)]
    return pa.table(both, names=[c.split()[0] for c in _WORD.split(", ")])


def word_counts(docs: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """key, stems, toxic, ordinary, n: all words of the labelled texts, their counts in both classes and distinct words before."""
    # labels are as many as labelled documents, so both sides are shuffled, texts compressed
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(_compressed, "doc_id long, packed binary")
    rows = stored(rows.join(labels.select("doc_id", F.col("label").alias("toxic")), "doc_id").select("packed", "toxic"), "labelled-texts")
    words = rows.mapInArrow(partial(_counted, parts=parts), _PACKED).groupBy("part").applyInArrow(_summed, _WORD)
    return stored(words.groupBy("key").agg(*[F.max(c).alias(c) for c in _STEM_COLUMNS], *[F.sum(c).alias(c) for c in ("toxic", "ordinary", "n")]), "toxicity-words")


def backed_off(words: DataFrame) -> DataFrame:
    """words and p, the common backed-off probability of each."""
    levels, lower = [], [*_STEM_COLUMNS]
    level = words.select("key", *_STEM_COLUMNS, "n")
    for i, c in enumerate(("key", *_STEM_COLUMNS)):
        levels.append((c, level))
        if i < len(STEMS):
            up = lower[i:]
            level = level.groupBy(*up).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    p = None
    for c, level in reversed(levels):
        total = level.agg(F.sum("n").alias("n"), F.sum(F.least("n", F.lit(CONTINUED))).alias("taken"), F.count(F.lit(1)).alias("kinds")).first()
        n, free = max(total["n"] or 0, 1), float(total["taken"] or 0)
        if p is None:
            below = F.lit(1 / max(total["kinds"], 1))
        else:
            above = p.select(F.col(last).alias("_s"), F.col("p").alias("_p"), F.col("m").alias("_m"))
            level = level.join(above, F.col(last) == F.col("_s"))
            below = F.col("_p") / F.col("_m")
        p = level.withColumn("p", (F.greatest(F.col("n") - CONTINUED, F.lit(0.0)) + F.lit(free) * below) / n).drop("_s", "_p", "_m")
        last = c
    return words.join(p.select("key", "p"), "key")


def ratios(words: DataFrame) -> tuple[DataFrame, float]:
    """key, ratio: log-likelihood ratio, toxic to ordinary, of the words that don't have that of a new word; and this one."""
    classes = "toxic", "ordinary"
    total = words.agg(*[F.sum(c).alias(c) for c in classes], *[F.sum(F.least(F.col(c), F.lit(DISCOUNT))).alias(f"free_{c}") for c in classes]).first()
    if not (total["toxic"] and total["ordinary"]):
        return words.select("key", F.lit(0.0).alias("ratio")).limit(0), 0.0
    free = {c: float(total[f"free_{c}"]) for c in classes}

    def likelihood(c: str) -> Column:
        return F.log((F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + F.lit(free[c]) * F.col("p")) / float(total[c]))

    some = backed_off(words).where(F.greatest(*classes) > DISCOUNT)
    new = float(np.log(free["toxic"] / total["toxic"]) - np.log(free["ordinary"] / total["ordinary"]))
    return some.select("key", (likelihood("toxic") - likelihood("ordinary")).alias("ratio")), new


def _entries(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, ratio = b.column("key").to_numpy(), b.column("ratio").to_numpy()
        by = np.argsort(keys)
        keys, ratio = keys[by], ratio[by].astype(np.float32)
        order, at = _dealt(keys, parts)
        has = np.flatnonzero(np.diff(at))
        takes = [order[at[p] : at[p + 1]] for p in has]
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array([_keys_squeezed(keys[x]) for x in takes], pa.binary()), pa.array([_squeezed(ratio[x]) for x in takes], pa.binary())], names=["part", "keys", "ratios"])


_PIECE = "block long, part int, digest long, packed binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["block", "part", "digest", "packed"])


def _blocks(batches: Iterable[pa.RecordBatch], parts: int, ask: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's rows: to ask, their distinct words for each part; else (part -1) the documents as
    places of their words among these, in order. A digest of the words tells whether both are of the same block."""
    import zstandard
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    pack = zstandard.ZstdCompressor(level=3).compress
    ids, counts, words, size = [], [], [], 0

    def out() -> pa.RecordBatch:
        distinct, place, times = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        digest = int(mix(distinct.view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
        if ask:
            order, at = _dealt(distinct, parts)
            return _pieces([(number, p, digest, _keys_squeezed(distinct[order[at[p] : at[p + 1]]])) for p in np.flatnonzero(np.diff(at)).tolist()])
        often = np.argsort(-times, kind="stable")  # small numbers for frequent words
        rank, answer = np.empty(len(often), np.uint32), np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often))
        answer[_dealt(distinct, parts)[0]] = np.arange(len(often))  # where the answer to each word will stand
        doc = pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.concatenate(counts).astype(np.int64))], names=["doc_id", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, doc.schema) as s:
            s.write_batch(doc)
        parcel = pack(sink.getvalue().to_pybytes()), _squeezed(answer[often]), _squeezed(rank[place])
        return _pieces([(number, -1, digest, b"".join(len(x).to_bytes(8, "little") + x for x in parcel))])

    for rows, texts in grouped(batches, size=GROUP // 4):
        w = Words(texts, NOT_WORD)
        ids += rows.column("doc_id").to_pylist()
        counts.append(w.per_text())
        words.append(_keys(w, w.ends))
        size += sum(map(len, texts))
        if size >= BLOCK:
            yield out()
            ids, counts, words, size, number = [], [], [], 0, number + 1
    if ids:
        yield out()


def _answers(entries: pa.Table, asked: pa.Table, new: float) -> pa.Table:
    """Ratios of the words that blocks ask one part of the table for; those it doesn't have are new."""
    known, values = np.zeros(0, np.int64), np.zeros(0, np.float32)
    if entries.num_rows:
        known = np.concatenate([_keys_loosened(p) for p in entries.column("keys").to_pylist()])
        order = np.argsort(known)
        known, values = known[order], np.concatenate([_loosened(p, np.float32) for p in entries.column("ratios").to_pylist()])[order]
    out = []
    for number, part, digest, packed in zip(*(asked.column(c).to_pylist() for c in ("block", "part", "digest", "packed")), strict=True):
        keys = _keys_loosened(packed)
        found = np.full(len(keys), new, np.float32)
        if len(known):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found = np.where(known[at] == keys, values[at], found)
        out.append((number, part, digest, _squeezed(found)))
    return pa.Table.from_batches([_pieces(out)])


def features(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FEATURES of texts of n words each, from the ratios of all their words; all 0 without words."""
    out, has = np.zeros((len(n), len(FEATURES))), np.flatnonzero(n)
    if not len(has):
        return out
    r, n = np.clip(ratio.astype(float), -MOST, MOST), n[has]
    opens, stop = np.cumsum(n) - n, np.repeat(np.cumsum(n), n)
    sums, at = np.concatenate([[0.0], np.cumsum(r)]), np.arange(len(r))
    out[has, 0] = np.add.reduceat(r, opens) / n
    for k, size in enumerate(WINDOWS):
        mean = (sums[np.minimum(at + size, stop)] - sums[at]) / np.minimum(size, np.repeat(n, n))
        out[has, k + 1] = np.maximum.reduceat(mean, opens)
    for k, hit in enumerate(HITS):
        out[has, 1 + len(WINDOWS) + k] = np.log1p(np.add.reduceat((r > hit).astype(float), opens))
    return out


def _evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the texts of each block, from its documents and the answers of all parts, which follow in order."""
    import zstandard

    def out() -> pa.RecordBatch:
        cut, at = [], 0
        while at < len(documents):
            n = int.from_bytes(documents[at : at + 8], "little")
            cut.append(documents[at + 8 : at + 8 + n])
            at += 8 + n
        if not cut:
            raise ValueError(f"block {number} has answers without documents")
        rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(cut[0])).read_all()
        answer, rank = _loosened(cut[1], np.uint32), _loosened(cut[2], np.uint32)
        got = np.concatenate([np.zeros(0, np.float32), *answers])
        if len(got) != len(answer):
            raise ValueError(f"block {number} has {len(answer)} distinct words and {len(got)} answers")
        f = features(got[answer][rank], rows.column("n").to_numpy())
        return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), *(pa.array(f[:, i].copy()) for i in range(len(FEATURES)))], names=["doc_id", *FEATURES])

    number, digest, documents, answers = None, 0, b"", []
    for b in batches:
        for block, part, check, packed in zip(*(b.column(c).to_pylist() for c in ("block", "part", "digest", "packed")), strict=True):
            if block != number:
                if number is not None:
                    yield out()
                number, digest, documents, answers = block, check, b"", []
            if check != digest:
                raise ValueError(f"block {number} differs between its documents and its questions")
            if part < 0:
                documents = packed
            else:
                answers.append(_loosened(packed, np.float32))
    if number is not None:
        yield out()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by Newton's method."""
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        pen = np.full(len(w), ridge)
        pen[-1] = 1e-6
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pen), x1.T @ (p - y) + pen * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, labels: DataFrame, curve_part: Column) -> DataFrame:
    """doc_id and score of every whole text. labels: doc_id, label (0 or 1) of the rows that may be learnt from.

    Rows with curve_part fit the curve (the CURVE_ROWS of least hash), all others are counted.
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(n, docs.count() // PART_ROWS)
    known, new = ratios(word_counts(docs, labels.where(~curve_part), parts))
    model = known.mapInArrow(partial(_entries, parts=parts), "part int, keys binary, ratios binary")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    asked, documents = (rows.mapInArrow(partial(_blocks, parts=parts, ask=ask), _PIECE) for ask in (True, False))
    answers = model.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(lambda m, a: _answers(m, a, new), _PIECE)
    pieces = documents.unionByName(answers).repartition(n, "block").sortWithinPartitions("block", "part")
    evidence = stored(pieces.mapInArrow(_evidence, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)), "toxicity-evidence")
    fit = least_hashed(evidence.join(labels.where(curve_part), "doc_id"), "doc_id", CURVE_ROWS).toPandas()
    x, y = fit[list(FEATURES)].to_numpy(float), fit["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return evidence.select("doc_id", F.lit(0.5).alias("score"))
    w, b = logistic(x, y)
    z = sum((F.col(f) * F.lit(float(c)) for f, c in zip(FEATURES, w, strict=True)), F.lit(b))
    return evidence.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold("doc_id", 5)
    labels = table(spark, sf_dir, "labels", "doc_id", F.col("toxic").alias("label")).where(part != 0)
    rows = score(table(spark, sf_dir, "documents", "doc_id", "text"), labels, part == 4)
    return rows.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
