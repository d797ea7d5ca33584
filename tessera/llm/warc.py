"""WARC archives: written with an index first, read back by coalesced byte ranges.

Every write task produces one ``.warc.gz`` (a gzip member per record) in a
shared folder and returns an index row per record: file, offset, length, url,
digest. Readers select index rows, never scan archives: the rows of a stretch
of a file are sorted by offset, neighbouring ranges are merged into reads of
bounded size, and each member is unpacked from its own bytes.

Equal payloads of at least ``min_bytes`` bytes are stored once: the record
with the largest page_id is the response, the others are ``revisit`` records
(profile identical-payload-digest) that refer to it and keep the payload's
length in their HTTP header.

Scale: payloads move once (to the join with their decision, by page_id, so
one payload shared by a third of all pages does not meet in one task); the
grouping by digest moves (digest, id) only and is pre-aggregated. A retried
or speculative task writes a file under a new name; the stored index names
the files of the committed tasks alone. Files go through the file system that
the folder's URI names.

Cases: NULL html is the empty payload; a NULL url is written as
``urn:page:<id>``; rows with a NULL page_id are responses only if all rows of
their payload have none; repeated rows are one record each and are returned
each. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_folder, stored

TASK_BYTES = 1 << 26  # archive bytes that a read task has on average, where that gives more tasks than the session's
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, sha1, top)``: top is the page that a revisit refers to, NULL for responses."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    slim = stored(pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n_bytes")).distinct(),
                  "warc-slim")
    tops = slim.where(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(
        F.max("page_id").alias("top"), F.count(F.lit(1)).alias("ids")).where("ids > 1")
    known = slim.join(tops, "sha1").where(~F.col("page_id").eqNullSafe(F.col("top"))).select(
        F.col("page_id").alias("id"), F.col("sha1").alias("sha"), "top")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha1"))
    return rows.join(known, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("sha")), "left") \
        .select("page_id", "url", "html", "sha1", "top")


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1}')}>"


def pack(page_id: int | None, url: str | None, html: str | None, sha1: str, top: int | None, date: str) -> bytes:
    """One gzip member with the page's record."""
    payload = (html or "").encode()
    url = "urn:page:" + str(page_id) if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if top is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if top is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha1)}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Page-Id: {'' if page_id is None else page_id}"]
    if top is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(top, sha1)}", f"X-Refers-To-Page: {top}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def unpack(member: bytes) -> dict:
    """The record of a gzip member; raises if a response's payload does not match its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = field["WARC-Type"]
    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")
    number = lambda x: int(x) if x else None
    return {"page_id": number(field["X-Page-Id"]), "url": field["WARC-Target-URI"], "payload_bytes": n,
            "payload_digest": digest, "record_type": kind, "refers_to": number(field.get("X-Refers-To-Page")),
            "payload": payload if kind == "response" else None}


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI of the file system on which Spark resolves it, whether it names one or not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(path).toString()


def _open(folder: str):
    """File system and path of a URI; ``file:/x`` and ``file:///x`` are one."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def write_warc(decided: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Archives of the rows of ``decide`` in ``folder``; returns their stored index."""
    folder = qualified(decided.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                            ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
        try:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    if out is None:
                        system, path = _open(folder)
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    member = pack(r["page_id"], r["url"], r["html"], r["sha1"], r["top"], date)
                    out.write(member)
                    rows.append({"file": name, "offset": at, "length": len(member), "url": r["url"],
                                 "digest": base64.b32encode(bytes.fromhex(r["sha1"])).decode(), "page_id": r["page_id"],
                                 "record_type": "response" if r["top"] is None else "revisit"})
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            if out is not None:
                out.close()
    slim = decided.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "sha1", F.col("top").cast("long").alias("top"))
    return stored(slim.mapInArrow(run, INDEX), "warc-index")


def read_warc(index: DataFrame, folder: str, payloads: bool = True, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """The records of the selected ``index`` rows.

    Ranges closer than ``gap`` are read together, up to ``most`` bytes at once
    (more only for a single record larger than that). Stretches of ``most`` bytes
    of a file are dealt to a number of tasks that the records' bytes set."""
    folder = qualified(index.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        open_name, source, ranges, start, end = None, None, [], 0, 0

        def read():
            data = source.read_at(end - start, start)
            rows = [unpack(data[o - start:o - start + n]) for o, n in ranges]
            if not payloads:
                rows = [r | {"payload": None} for r in rows]
            return pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            for name, o, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if ranges and (name != open_name or o - end > gap or o + n - start > most):
                    yield read()
                    ranges = []
                if name != open_name:
                    system, path = _open(folder)
                    source, open_name = system.open_input_file(f"{path}/{name}"), name
                if not ranges:
                    start = o
                ranges.append((o, n))
                end = o + n
        if ranges:
            yield read()
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(partitions(index.sparkSession), -(-size // TASK_BYTES))
    return (index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / most))
            .sortWithinPartitions("file", "offset").mapInArrow(run, RECORD))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written, then all records read back."""
    folder = shared_folder(spark, "warc")
    index = write_warc(decide(spark.read.parquet(f"{sf_dir}/pages.parquet"), 0), folder)
    return read_warc(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
