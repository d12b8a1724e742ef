"""WARC archives, index first.

Writing makes one gzip member of each record and an index row for it: archive, offset, length, URL, digest. Each task writes
archives of its own under a new name in the shared folder, and the index holds only those of tasks that ended well; what a
lost task has left is never read. Reading sorts the wanted index rows by place, joins neighbouring byte ranges into one read,
and takes the records out of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, matched, shared_dir, trimmed

#: A task goes on to another archive when one has so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Ranges are read together if no more than GAP bytes lie between them, up to READ bytes at once (a larger record is read alone).
GAP, READ = 64 << 10, 8 << 20
#: Bytes of archives, and records, that a task of reading takes, about.
TASK_BYTES, TASK_RECORDS = 64 << 20, 4096
_CRLF = b"\r\n"
INDEX = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, archive string, offset long, length long"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_KINDS = [pa.int64() if x.split()[1] == "long" else pa.string() for x in INDEX.split(", ")]


def store_of(uri: str):
    """The file system of a shared folder's URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(url: str | None, kind: str, payload: bytes, digest: str, size: int, page_id: int | None, refers_to: int | None, date: str) -> bytes:
    """A whole uncompressed WARC/1.1 record. A revisit has no payload of its own."""
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{kind}|{digest}")).encode() + b">",
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"X-Page-ID: " + str("" if page_id is None else page_id).encode(),
        b"X-Payload-Length: " + str(size).encode(),
    ]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"X-Refers-To-Page-ID: " + str("" if refers_to is None else refers_to).encode()]
        payload = b""
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: " + str(len(payload)).encode()]
    return _CRLF.join(head) + _CRLF * 2 + payload + _CRLF * 2


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of an uncompressed record."""
    head, _, rest = raw.partition(_CRLF * 2)
    lines = head.split(_CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != _CRLF * 2:
        raise ValueError("a record of another length than it says")
    return headers, rest[:size]


def with_types(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, __sha1, record_type, refers_to.

    Of records with equal payloads of at least min_revisit_bytes that with the largest page_id (then url) is the response and
    the others revisit it; of rows equal in all of them one is the response. Null page_ids are the smallest. The payload of
    most pages is not shuffled: only digests that occur more than once are joined, by broadcast if they are few, else after a bit
    map of them has let other pages through."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    digested = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("__sha1"))
    skinny = digested.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "url", "__sha1")
    order = F.struct(F.col("page_id").isNotNull().alias("has"), F.col("page_id").alias("page_id"), F.col("url").isNotNull().alias("named"), F.col("url").alias("url"))
    rows = skinny.groupBy("__sha1", "page_id", "url").agg(F.count("*").alias("rows"))
    shared = cut(rows.groupBy("__sha1").agg(F.max(F.struct(order.alias("o"), F.col("rows"))).alias("best"), F.sum("rows").alias("times")).where("times > 1").select(F.col("__sha1").alias("sha1"), F.col("best.o.page_id").alias("to"), F.col("best.o.url").alias("to_url"), F.col("best.rows").alias("ties")))
    ties = shared.agg(F.max("ties")).first()[0]
    shared = shared.withColumn("__k", F.xxhash64("sha1"))
    typed = matched(digested, F.xxhash64("__sha1"), shared, "__k", F.col("__sha1") == F.col("sha1"), "left")
    best = F.col("page_id").eqNullSafe(F.col("to")) & F.col("url").eqNullSafe(F.col("to_url"))
    response = F.col("sha1").isNull() | best
    columns = ["page_id", "url", "payload", "__sha1", "record_type", "refers_to"]
    typed = typed.withColumn("record_type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))).withColumn("refers_to", F.when(~response, F.col("to")))
    if (ties or 1) < 2:
        return typed.select(columns)
    tied = F.col("sha1").isNotNull() & best & (F.col("ties") > 1)
    one = typed.where(tied).groupBy("__sha1").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "payload", "to", "ties")))
    again = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("ties")))).withColumn("record_type", F.when(F.col("i") == 1, F.lit("response")).otherwise(F.lit("revisit"))).withColumn("refers_to", F.when(F.col("i") > 1, F.col("to")))
    return typed.where(~tied).select(columns).unionByName(again.select(columns))


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, level: int = 6, date: datetime | None = None) -> DataFrame:
    """Writes a record for each row of (page_id, url, html) and returns the index, itself written to the shared folder.

    Null html is an empty payload, null url an empty one. An empty table writes nothing. Other columns are left alone."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    stamp = (date or datetime(2020, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        out = name = None
        at = 0
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                page, url, text, kind, to = (batch.column(c)[r].as_py() for c in ("page_id", "url", "payload", "record_type", "refers_to"))
                payload = text.encode("utf-8")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    store.create_dir(path, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = squeeze.compress(record(url, kind, payload, digest, len(payload), page, to, stamp)) + squeeze.flush()
                out.write(member)
                rows.append((page, url, kind, to, digest, len(payload), name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
        if out is not None:
            out.close()

    index = with_types(pages, min_revisit_bytes).select(F.col("page_id").cast("long"), "url", "payload", "record_type", F.col("refers_to").cast("long")).mapInArrow(trimmed(write), INDEX)
    return cut(index.withColumn("archive", F.concat(F.lit(f"{folder}/"), "archive")))


def ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """From sorted places: first and last record (exclusive) and begin and end of each joint read."""
    i = 0
    while i < len(offsets):
        j, end = i + 1, offsets[i] + lengths[i]
        while j < len(offsets) and offsets[j] - end <= GAP and offsets[j] + lengths[j] - offsets[i] <= READ:
            end = max(end, offsets[j] + lengths[j])
            j += 1
        yield i, j, offsets[i], end
        i = j


def read_records(index: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload of the index rows given.

    What comes back is what the archive says; the digest of every response is computed again, and a difference raises. A
    revisit's payload is null. Rows are dealt out by place, so that a task reads neighbouring records; the tasks are as many as the
    bytes and records ask for."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string"

    def number(x: str) -> int | None:
        return int(x) if x else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            archives = batch.column("archive").to_pylist()
            offsets, lengths = batch.column("offset").to_pylist(), batch.column("length").to_pylist()
            begin = 0
            while begin < len(archives):
                end = begin
                while end < len(archives) and archives[end] == archives[begin]:
                    end += 1
                if name != archives[begin]:
                    if opened is not None:
                        opened.close()
                    store, path = store_of(archives[begin])
                    opened, name = store.open_input_file(path), archives[begin]
                for i, j, low, high in ranges(offsets[begin:end], lengths[begin:end]):
                    data = opened.read_at(high - low, low)
                    rows = []
                    for k in range(begin + i, begin + j):
                        headers, payload = parse(zlib.decompress(data[offsets[k] - low : offsets[k] - low + lengths[k]], 31))
                        digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                        if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(headers["x-payload-length"])):
                            raise ValueError(f"{archives[k]} at {offsets[k]}: the payload has another digest or length")
                        rows.append((number(headers["x-page-id"]), headers["warc-target-uri"], kind, number(headers.get("x-refers-to-page-id", "")), digest, int(headers["x-payload-length"]), payload.decode("utf-8") if kind == "response" else None))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()], strict=True)], names=names)
                begin = end
        if opened is not None:
            opened.close()

    placed = index.select("archive", "offset", "length")
    all_ = placed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    tasks = max(1, -(-all_["b"] // TASK_BYTES), -(-all_["n"] // TASK_RECORDS))
    return placed.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(trimmed(read), schema)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder, with what lost tasks have left in it, once what was to be read from it has been."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def archived(pages: DataFrame, columns: list[str], **options) -> DataFrame:
    """Columns of all records after writing and reading them, itself written; the archives are gone then."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    found = cut(read_records(write_archives(pages, folder, **options)).select(*columns))
    delete_folder(spark, folder)
    return found
