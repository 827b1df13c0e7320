"""WARC archives: writing, normalising of whole-file gzip streams, and reading by offset.

Pages are written as WARC records into one gzip stream per task, the monolithic form that
can't be read from the middle. The normaliser inflates such a stream once, rewrites every record
as a gzip member of its own and writes a sidecar index of offsets; readers then seek.
Everything is streamed, so an archive may be larger than memory; only one record is held at a time.

Edge cases: a null payload is empty; payloads under MIN_REVISIT bytes are always responses; rows
tied on the largest page_id of their payload are all responses; a null page_id is never a
target, and is a response if its payload has no other id; an empty table makes no archives; other
columns of the input are not looked at. A truncated stream raises EOFError.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.tables import shared_dir, stored, table

#: Equal payloads of at least so many bytes are stored once.
MIN_REVISIT = 1000
#: A payload that very many pages share is joined in so many parts.
SALTS = 16
_DATE = "2024-01-01T00:00:00Z"


def opened(uri: str, mode: str) -> BinaryIO:
    """A file of the shared store, by its URI."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    if mode == "wb":
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return fs.open_output_stream(path, compression=None)
    return fs.open_input_file(path)


def planned(pages: DataFrame) -> DataFrame:
    """Adds digest, n_bytes, and refers_to for pages whose payload is stored with another page."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long"), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS))})
    groups = pages.select(F.col("page_id").cast("long"), html.alias("payload")).where(F.octet_length("payload") >= MIN_REVISIT)
    groups = groups.groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select("digest", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    rows = rows.join(groups, ["digest", "salt"], "left")
    other = F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", "payload", "digest", "n_bytes", F.when(other, F.col("target")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def _write_monolithic(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One gzip stream for the task's pages. A repeated task writes another file; only the one it reports counts."""
    path, raw, out, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, None, 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
            if out is None:
                raw = opened(path, "wb")
                out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=4, mtime=0)
            out.write(_record(*row))
            n += 1
    if out is not None:
        out.close(), raw.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Writes monolithic archives; returns their paths."""
    return stored(plan.mapInArrow(partial(_write_monolithic, folder=folder), "path string, n_records long"), "warc-written")


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, block and raw bytes of each record of an inflated WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise EOFError("a record's header isn't complete")
            head.append(line)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in head[1:])}
        block = stream.read(size := int(fields["content-length"]))
        if len(block) != size:
            raise EOFError("a record's block isn't complete")
        yield fields, block, b"".join(head) + b"\r\n" + block + b"\r\n\r\n"


def _normalise(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for source in b.column("path").to_pylist():
            path, offset, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
            with opened(source, "rb") as raw, gzip.GzipFile(fileobj=raw) as whole, opened(path, "wb") as out, opened(f"{path}.idx", "wb") as index:
                for _, _, data in records(whole):
                    member = gzip.compress(data, compresslevel=4, mtime=0)
                    out.write(member)
                    index.write(struct.pack("<QI", offset, len(member)))
                    offset, n = offset + len(member), n + 1
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive with one gzip member per record and an index beside it (``.idx``: offset u64, length u32, little-endian)."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(archives.select("path").repartition(n).mapInArrow(partial(_normalise, folder=folder), "path string, n_records long"), "warc-normalised")


_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "null") else None


def _read(batches: Iterable[pa.RecordBatch], at_once: int = 100) -> Iterator[pa.RecordBatch]:
    import io

    names = [x.split()[0] for x in _READ.split(", ")]
    for b in batches:
        for path in b.column("path").to_pylist():
            with opened(path, "rb") as data, opened(f"{path}.idx", "rb") as index:
                while part := index.read(12 * at_once):
                    rows = []
                    for offset, length in struct.iter_unpack("<QI", part):
                        data.seek(offset)
                        ((h, block, _),) = records(io.BytesIO(zlib.decompress(data.read(length), 31)))
                        digest, n = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                        if h["warc-type"] == "response" and (len(block) != n or hashlib.sha1(block).hexdigest() != digest):
                            raise ValueError(f"{h['warc-record-id']}: the payload doesn't have its digest")
                        rows.append((_page(h["warc-record-id"]), h["warc-target-uri"], block, n, digest, h["warc-type"], _page(h.get("warc-refers-to"))))
                    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record, each inflated alone at its indexed offset; a revisit has no payload of its own."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n).mapInArrow(_read, _READ)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    written = write_archives(planned(table(spark, sf_dir, "pages", "page_id", "url", "html")), f"{folder}/monolithic")
    rows = read_archives(normalise(written, f"{folder}/members"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND target IS DISTINCT FROM page_id AND target IS NOT NULL AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN target END AS refers_to
FROM r
"""
