"""A full-text index in segments: postings with positions in blocks of ids, ranking by covers, many questions in one plan.

A batch writes one segment and the ids it touches; entries of older segments with those ids are dead. Segments are never
changed: a manifest lists them, and neighbours of like size are merged. A row holds a term's entries in one block of ids, so no row grows with
a term, and the greatest weight in a row bounds what its block can give to a question; blocks that can't reach a question's
best are not read. On disk the rows of one block whose terms share a hash bucket are packed into one, with the numbers of a column as bytes: most terms
have one entry in a block, and a row of Spark for each would cost far more than its entries.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators import lexical
from cairn.sources import versions

#: Ids of a block; files by hash of the term.
BLOCK, BUCKETS = 256, 64
#: Blocks of a bucket that go to one file; bytes of texts or packed rows that a worker looks at together, whole blocks aside.
REGION, GROUP = 4096, 4_000_000
#: Bytes of Arrow data that a Python worker is handed at once.
BATCH_BYTES = "16m"
#: Bytes of a row group, so a reader holds little of the packed columns at once.
ROW_GROUP = 16 << 20
#: Ids touched after the oldest segment up to which every task gets them; more of them meet the rows by a join.
LOOKED_UP = 4_000_000
#: So many neighbouring segments of like size become one.
FAN = 4
#: Sums of doubles in any order differ by less.
SLACK = 1e-6
#: Entries that questions meet in one slice of them; a slice's shuffles and cells are gone before the next one.
SLICE = 50_000_000


def occurrences(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """term, id, length and the sorted places (from 0, counted in terms) of each term of each text. docs: id, text."""
    terms = docs.select("id", F.length("text").alias("length"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(lexical.TERM), 0)).alias("place", "term"))
    if only is not None:
        terms = terms.where(F.col("term").isin(only))
    return terms.groupBy("term", "id").agg(F.first("length").alias("length"), F.sort_array(F.collect_list("place")).alias("places"))


def weight(tf: Column, length: Column) -> Column:
    """What a text gives for a term."""
    return tf / (1 + F.log(1 + length))


# ---- ranking by covers


def covers(posts: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """variant, weight, id, score: the sum over minimal stretches that hold all terms of a variant, 1 / (1 + other terms inside).

    posts: term, id, places; asked: variant, weight, term, slot (from 0), needed (terms of the variant, ``most`` at the most).
    A stretch that ends at a place starts at the least of the terms' last places; it is minimal if no earlier end has that start.
    """
    rows = posts.join(F.broadcast(asked), "term")
    whole = Window.partitionBy("variant", "id")
    rows = rows.withColumn("found", F.count(F.lit(1)).over(whole)).where("found = needed")
    at = rows.select("variant", "weight", "needed", "slot", "id", F.explode("places").alias("place"))
    upto = whole.orderBy("place")
    last = [F.when(F.col("needed") > i, F.max(F.when(F.col("slot") == i, F.col("place"))).over(upto)) for i in range(most)]
    missing = F.lit(False)
    for i, x in enumerate(last):
        missing = missing | ((F.col("needed") > i) & x.isNull())
    begin = F.when(~missing, F.least(*last) if most > 1 else last[0])
    ends = at.withColumn("begin", begin)
    ends = ends.withColumn("before", F.lag("begin").over(upto)).where("begin IS NOT NULL AND (before IS NULL OR begin > before)")
    return ends.groupBy("variant", "weight", "id").agg(F.sum(1 / (2 + F.col("place") - F.col("begin") - F.col("needed"))).alias("score"))


def dense(docs: DataFrame, variants: list[tuple[str, float]], limit: int = 40) -> DataFrame:
    """id, score of texts by the variants of a question, folded in their order; each variant ranks by its covers."""
    rows = [(i, w, t, slot, len(ts)) for i, (v, w) in enumerate(variants) if w > 0 for ts in [lexical.terms_of(v)] for slot, t in enumerate(ts)]
    asked = docs.sparkSession.createDataFrame(rows, "variant int, weight double, term string, slot int, needed int")  # a question's few
    posts = occurrences(docs, sorted({r[2] for r in rows}))
    return lexical.fold(covers(posts, asked, max(r[4] for r in rows)), limit)


# ---- segments


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


#: Numbers of packed rows: those of terms, of entries (in order of terms, then ids), and places (in order of entries). Terms are joined by spaces.
_NUMBERS = {"n": np.int32, "top": np.float64, "ids": np.int64, "lengths": np.int32, "tfs": np.int32, "places": np.int32}
_PACKED = ", ".join(["block long, bucket int, terms string", *[f"{c} binary" for c in _NUMBERS]])
_TYPES = {"n": "int", "top": "double", "ids": "array<long>", "lengths": "array<int>", "tfs": "array<int>", "places": "array<int>"}


def _whole(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows sorted by the keys, in tables of about GROUP bytes that end where a key changes."""
    held, size, last = [], 0, None
    for b in batches:
        if b.num_rows == 0:
            continue
        at = np.stack([b.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
        for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            key = at[:, first].tolist()
            if size >= GROUP and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(b.slice(first, end - first))
            size, last = size + held[-1].nbytes, key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where one of the keys differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _packed(block: np.ndarray, bucket: np.ndarray, code: np.ndarray, names: pa.Array, ids: np.ndarray, lengths: np.ndarray, tfs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Packed rows of entries sorted by block, bucket, term and id. code: place of an entry's term in names; places: all entries' places in their order."""
    rows = _starts(block, bucket, code)
    cells = _starts(block[rows], bucket[rows])
    first, n = rows[cells], np.diff(rows, append=len(ids))
    top = np.maximum.reduceat(tfs / (1 + np.log(1 + lengths)), rows)  # as in ``weight``
    before = np.append(0, np.cumsum(tfs))
    terms = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cells, len(rows)), pa.int32()), names.take(pa.array(code[rows]))), " ")
    parts = {"n": (n, cells), "top": (top, cells), "ids": (ids, first), "lengths": (lengths, first), "tfs": (tfs, first), "places": (places, before[first])}
    return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int64()), pa.array(bucket[first], pa.int32()), terms, *[_bytes(v.astype(_NUMBERS[c]), at) for c, (v, at) in parts.items()]], names=["block", "bucket", "terms", *parts])


def _bytes(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A value of bytes for each stretch of numbers."""
    ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def _numbers(t: pa.RecordBatch, column: str) -> np.ndarray:
    """All numbers of a column of bytes."""
    c = t.column(column)
    ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    kind = np.dtype(_NUMBERS[column])
    return np.frombuffer(c.buffers()[2], kind, (ends[-1] - ends[0]) // kind.itemsize, ends[0])


def _entries_of(t: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of each entry the row and its term (as a place in the distinct terms), and which entries are alive (not in dead with an after over seq)."""
    terms = pc.split_pattern(t.column("terms"), " ")
    n, ids = _numbers(t, "n"), _numbers(t, "ids")
    term_row = np.repeat(np.arange(t.num_rows), pc.list_value_length(terms).to_numpy())
    terms = terms.flatten().dictionary_encode()
    row, alive = np.repeat(term_row, n), np.ones(len(ids), bool)
    upto = np.searchsorted(row, np.arange(t.num_rows + 1))
    for r, (seq, dead, after) in enumerate(zip(t.column("seq").to_pylist(), t.column("dead"), t.column("after"), strict=True)):
        if dead.is_valid:
            gone = dead.values.to_numpy()[after.values.to_numpy() > seq]
            own = slice(upto[r], upto[r + 1])
            alive[own] = ~np.isin(ids[own], gone)
    return row, terms.dictionary, np.repeat(terms.indices.to_numpy(), n), alive


def _live(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 64):
            t = b.slice(i, 64)
            row, names, code, alive = _entries_of(t)
            numbers = [pa.array(_numbers(t, c)[alive]) for c in ("ids", "lengths", "tfs")]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code[alive])), *numbers], names=["term", "id", "length", "tf"])


def _rows_of(batches: Iterable[pa.RecordBatch], lists: tuple[str, ...], wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 64):
            t = b.slice(i, 64)
            terms = pc.split_pattern(t.column("terms"), " ")
            row, n = np.repeat(np.arange(t.num_rows), pc.list_value_length(terms).to_numpy()), _numbers(t, "n")
            at = np.append(0, np.cumsum(n))
            columns = {"seq": t.column("seq").take(pa.array(row)), "term": terms.flatten(), "block": t.column("block").take(pa.array(row)), "n": pa.array(n), "top": pa.array(_numbers(t, "top"))}
            for c in lists:
                ends = np.append(0, np.cumsum(_numbers(t, "tfs")))[at] if c == "places" else at
                columns[c] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_numbers(t, c)))
            out = pa.RecordBatch.from_pydict(columns)
            yield out if wanted is None else out.filter(pc.is_in(out.column("term"), pa.array(sorted(wanted), pa.string())))


def _indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of texts. batches: block, id, length, low (the text in lower case), sorted by block and id, whole blocks in one task."""
    find = re.compile(lexical.TERM).findall
    for t in _whole(batches, "block"):
        found = [find(x) if x else [] for x in t.column("low").to_pylist()]
        counts = np.array([len(x) for x in found], np.int64)
        if not counts.any():
            continue
        terms = pa.array([x for ts in found for x in ts], pa.string()).dictionary_encode()
        names, code = terms.dictionary, terms.indices.to_numpy().astype(np.int64)
        del found, terms
        buckets = np.array([zlib.crc32(x.encode()) % BUCKETS for x in names.to_pylist()], np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        block, ids, lengths = (t.column(c).to_numpy() for c in ("block", "id", "length"))
        _, nth = np.unique(block, return_inverse=True)
        key = (nth[doc] * BUCKETS + buckets[code]) * len(names) + code
        # rows of one id count as one text
        order = np.argsort(key, kind="stable") if (np.diff(ids) != 0).all() else np.lexsort((place, ids[doc], key))
        key, doc, code, place = key[order], doc[order], code[order], place[order]
        at = _starts(key, ids[doc])
        doc, code = doc[at], code[at]
        yield _packed(block[doc], buckets[code], code, names, ids[doc], lengths[doc], np.diff(at, append=len(place)), place)


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of several segments, sorted by bucket and block -> one for each bucket and block, without dead entries."""
    for t in _whole(batches, "bucket", "block"):
        t = t.to_batches()[0]
        row, names, code, alive = _entries_of(t)
        ids, lengths, tfs, places = (_numbers(t, c) for c in ("ids", "lengths", "tfs", "places"))
        block, bucket = t.column("block").to_numpy()[row], t.column("bucket").to_numpy()[row]
        order = np.lexsort((ids, code, block, bucket))
        order = order[alive[order]]
        if len(order):
            starts, tf = np.cumsum(tfs) - tfs, tfs[order].astype(np.int64)
            at = np.arange(tf.sum()) + np.repeat(starts[order] - (np.cumsum(tf) - tf), tf)
            yield _packed(block[order], bucket[order], code[order], names, ids[order], lengths[order], tf, places[at])


def _dealt(packed: DataFrame) -> DataFrame:
    """Packed rows by bucket and region, so a segment has a file for each and not one for each task."""
    return packed.repartition("bucket", F.floor(F.col("block") / REGION))


def _write(packed: DataFrame, path: str) -> None:
    packed.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    packed.write.partitionBy("bucket").option("parquet.block.size", ROW_GROUP).parquet(path)


def add(spark: SparkSession, root: str, batch: DataFrame, number: int | None = None, block: int = BLOCK) -> None:
    """Index a batch (id, text, deleted; an id once) as a new segment. No older segment is read.

    number: of a stream's batch; one that was already committed is left alone, so each counts once.
    block: ids of a block; the first batch fixes it for the index, since dead ids are looked up by block.
    """
    version, state = versions.current(spark, root)
    block = state.get("block", block)
    if number is not None and number <= state.get("number", -1):
        return
    name, last, batch = versions.new_name(), state.get("last", 0) + 1, batch.where("id IS NOT NULL")
    batch.select("id").write.parquet(f"{root}/touched/{name}")
    # blocks come together as texts, which are smaller than their postings
    texts = batch.where("NOT deleted").select(F.floor(F.col("id") / block).alias("block"), "id", "text").repartition("block").sortWithinPartitions("block", "id")
    packed = texts.select("block", "id", F.length("text").alias("length"), F.lower("text").alias("low")).where("low IS NOT NULL").mapInArrow(_indexed, _PACKED)
    with versions.tidy(spark):
        _write(_dealt(packed).sortWithinPartitions("bucket", "block"), f"{root}/segments/{name}")
    n = spark.read.parquet(f"{root}/touched/{name}").count()
    segment = {"name": name, "seq": last, "n": n}
    state = {"last": last, "number": state.get("number", -1) if number is None else number, "block": block, "segments": [*state.get("segments", []), segment], "touched": [*state.get("touched", []), segment]}
    versions.commit(spark, root, state, version)


def _stored(spark: SparkSession, root: str, segments: list[dict], *columns: str) -> DataFrame:
    """Packed rows of segments with their seq; a segment of deletions alone has no files."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    schema = f"{_PACKED.replace('bucket int, ', '')}, bucket int"
    parts = [spark.read.schema(schema).parquet(f"{root}/segments/{s['name']}").select("block", "bucket", "terms", *columns).withColumn("seq", F.lit(s["seq"])) for s in segments]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rows(spark: SparkSession, root: str, terms: list[str] | None = None, lists: tuple[str, ...] = ("ids", "lengths", "tfs", "places")) -> DataFrame:
    """Rows of all segments: seq, term, block, n, top and the wanted lists (places: those of one id after the other). terms: a question's few."""
    columns = dict.fromkeys(["n", "top", *(["tfs"] if "places" in lists else []), *lists])
    out = _stored(spark, root, versions.current(spark, root)[1]["segments"], *columns)
    if terms is not None:
        numbers = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
        out = out.where(F.col("bucket").isin(numbers))
    kinds = ", ".join(["seq int, term string, block long", *[f"{c} {_TYPES[c]}" for c in dict.fromkeys(["n", "top", *lists])]])
    return out.drop("bucket").mapInArrow(partial(_rows_of, lists=lists, wanted=None if terms is None else frozenset(terms)), kinds)


def live(spark: SparkSession, root: str) -> DataFrame:
    """term, id, length, tf of all live entries, without rows between."""
    stored = _stored(spark, root, versions.current(spark, root)[1]["segments"], "n", "ids", "lengths", "tfs")
    return _with_dead(spark, root, stored).mapInArrow(_live, "term string, id long, length int, tf int")


def _with_dead(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """found (block) with the dead and after of its block, null where there are none."""
    dead = _dead(spark, root)
    if dead is None:
        return found.withColumn("dead", F.lit(None).cast("array<long>")).withColumn("after", F.lit(None).cast("array<int>"))
    return found.join(dead, "block", "left")


def _dead(spark: SparkSession, root: str) -> DataFrame | None:
    """block, dead and after: its ids that batches after the oldest segment touched, and the last of these for each id; None where there is only that segment."""
    state = versions.current(spark, root)[1]
    oldest = min(s["seq"] for s in state["segments"])
    later = [t for t in state["touched"] if t["seq"] > oldest]
    parts = [spark.read.parquet(f"{root}/touched/{t['name']}").withColumn("seq", F.lit(t["seq"])) for t in later]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    each = out.groupBy("id").agg(F.max("seq").alias("after"))
    dead = each.groupBy(F.floor(F.col("id") / state["block"]).alias("block")).agg(F.collect_list(F.struct("id", "after")).alias("_d"))
    dead = dead.select("block", F.col("_d.id").alias("dead"), F.col("_d.after").alias("after"))
    return F.broadcast(dead) if sum(t["n"] for t in later) <= LOOKED_UP else dead


def entries(spark: SparkSession, root: str, found: DataFrame, places: bool = False) -> DataFrame:
    """The live entries of rows (seq, block): all their other columns, id, length, tf and, where wanted, places."""
    keep = [c for c in found.columns if c not in ("ids", "lengths", "tfs", "places", "n", "top")]
    last = F.get("after", (F.array_position("dead", F.col("id")) - 1).cast("int"))
    out = _with_dead(spark, root, found).select("*", F.posexplode("ids").alias("_k", "id")).where(last.isNull() | (F.col("seq") >= last))
    own = [F.get("lengths", F.col("_k")).alias("length"), F.get("tfs", F.col("_k")).alias("tf")]
    if places:
        before = F.aggregate(F.slice("tfs", F.lit(1), F.col("_k")), F.lit(0), lambda a, x: a + x)
        own.append(F.slice("places", before + 1, F.get("tfs", F.col("_k"))).alias("places"))
    return out.select(*keep, "id", *own)


def frequencies(spark: SparkSession, root: str, terms: DataFrame) -> DataFrame:
    """term, df: live texts of each of the terms (term)."""
    found = rows(spark, root, lists=() if _dead(spark, root) is None else ("ids", "lengths", "tfs")).join(terms.select("term").distinct(), "term", "left_semi")
    if _dead(spark, root) is None:
        return found.groupBy("term").agg(F.sum("n").alias("df"))  # ids are not read
    return entries(spark, root, found).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def merge(spark: SparkSession, root: str, fan: int = FAN) -> bool:
    """Make one of the first ``fan`` neighbours of like size (the same power of ``fan``); says whether there were any."""
    version, state = versions.current(spark, root)
    tiers = [int(math.log(max(s["n"], 1), fan)) for s in state["segments"]]
    start = next((i for i in range(len(tiers) - fan + 1) if len(set(tiers[i : i + fan])) == 1), None)
    if start is None:
        return False
    segments = state["segments"]
    joined = segments[start : start + fan]
    stored = _with_dead(spark, root, _stored(spark, root, joined, *_NUMBERS))
    name, last = versions.new_name(), joined[-1]["seq"]
    with versions.tidy(spark):
        _write(_dealt(stored).sortWithinPartitions("bucket", "block").mapInArrow(_merged, _PACKED), f"{root}/segments/{name}")
    left = [*segments[:start], {"name": name, "seq": last, "n": sum(s["n"] for s in joined)}, *segments[start + fan :]]
    oldest = left[0]["seq"]
    versions.commit(spark, root, state | {"segments": left, "touched": [t for t in state["touched"] if t["seq"] > oldest]}, version)
    return True


def vacuum(spark: SparkSession, root: str) -> None:
    state = versions.current(spark, root)[1]
    for kind in ("segments", "touched"):
        versions.removed_unlisted(spark, root, kind, {x["name"] for x in state.get(kind, [])})


# ---- many questions


def _scores(spark: SparkSession, root: str, cells: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """qid, id, score of all texts in the cells (qid, seq, block)."""
    wanted = cells.select("qid", "seq", "block").join(asked, "qid")
    found = index.select("seq", "block", "term", "ids", "lengths", "tfs").join(wanted, ["seq", "block", "term"])
    each = entries(spark, root, found)
    return each.groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") * weight(F.col("tf"), F.col("length"))), 6).alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, root: str, asked: DataFrame, k: int = 40, most: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(qid, id, score, rank) of the k best texts of each question, and (qid, cells, cells_read): blocks with its terms, and those read.

    asked: qid, term, weight (a term once for a question). A text scores the sum of its terms' weights. A cell, one block of one segment, can give a question
    the sum of its terms' greatest weights at most. The most promising cells of each question, with 2 k entries of a term, are scored first; their k-th score
    is a floor, and of the others only cells that can reach it are read. The result is that of reading everything.

    Entries met grow with questions times texts, so questions are answered in slices: what lies on disk at once has a bound, the results
    of earlier slices aside.
    """
    index, place = rows(spark, root, lists=("ids", "lengths", "tfs")), versions.shared_folder(spark, "answers")
    asked.write.parquet(f"{place}/asked")
    asked = spark.read.parquet(f"{place}/asked")
    met = index.groupBy("term").agg(F.sum("n").alias("n")).join(asked.groupBy("term").agg(F.count(F.lit(1)).alias("asking")), "term")
    slices = max(1, math.ceil((met.agg(F.sum(F.col("n") * F.col("asking"))).first()[0] or 0) / most))
    for i in range(slices):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == i)
        with versions.tidy(spark):
            best, report = _search(spark, root, part, k, index, f"{place}/slice")
            best.write.mode("append").parquet(f"{place}/best")
            report.write.mode("append").parquet(f"{place}/report")
        versions.removed_unlisted(spark, place, "slice", set())
    return spark.read.schema(best.schema).parquet(f"{place}/best"), spark.read.schema(report.schema).parquet(f"{place}/report")


def _search(spark: SparkSession, root: str, asked: DataFrame, k: int, index: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
    """``search`` for questions whose cells are written below ``place``."""
    tops = index.select("seq", "block", "term", "n", "top").join(asked, "term")
    cells = tops.groupBy("qid", "seq", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), F.max("n").alias("n"))
    ahead = Window.partitionBy("qid").orderBy(F.desc("bound"), "seq", "block").rowsBetween(Window.unboundedPreceding, -1)
    cells.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)) < 2 * k).write.parquet(f"{place}/cells")
    cells = spark.read.parquet(f"{place}/cells")
    _best(_scores(spark, root, cells.where("first"), asked, index), k).write.parquet(f"{place}/first")
    first = spark.read.parquet(f"{place}/first")
    floor = first.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    rest = cells.where("NOT first").join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
    best = _best(first.drop("rank").unionByName(_scores(spark, root, rest, asked, index)), k)
    more = rest.groupBy("qid").agg(F.count(F.lit(1)).alias("more"))
    report = cells.groupBy("qid").agg(F.count(F.lit(1)).alias("cells"), F.count_if("first").alias("of_first")).join(more, "qid", "left")
    return best, report.select("qid", "cells", (F.col("of_first") + F.coalesce("more", F.lit(0))).alias("cells_read"))
