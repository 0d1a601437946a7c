"""WARC archives, index first.

Each task writes one archive of its rows, a gzip member per record, into the shared folder, and
yields an index row (file, offset, length, url, digest) for each. The index is committed as a table
before anything is read; archives of attempts that the index does not name are removed. Reading takes
selected index rows, sorts them by file and offset, deals them out in that order to one task for
every SPAN bytes of records, coalesces neighbouring byte ranges up to a gap and a size, and reads and
parses each range once.

Of records with equal payloads the one with the smallest id is a response, the others are revisits
without payload that refer to it; their HTTP headers keep the payload's length.

Defined cases: a null payload is empty, and empty payloads equal each other; rows that share the
smallest id of their payload are all responses; a null id is larger than any other; a null url is
left out of the record; control characters and blanks in a url are percent-encoded inside the record
and kept in the index; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_batches, staged

INDEX = "id long, url string, file string, offset long, length long, payload_digest string, record_type string"
RECORD = "id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Reads are joined over gaps up to GAP bytes, into ranges up to RANGE bytes (a longer record is a range of its own).
GAP, RANGE = 1 << 16, 8 << 20
#: Bytes of records that one task reads, about.
SPAN = 8 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return fs, path.rstrip("/")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest(), version=4)}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def decode_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers of the record, HTTP head, payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Archives under root for rows (id, url, payload string); returns the committed index."""
    spark = pages.sparkSession
    small_batches(spark)
    keyed = pages.select(F.col("id").cast("long").alias("id"), "url", F.coalesce("payload", F.lit("")).alias("payload")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    # In a table of its own, so that a payload which many rows share can be split in the join.
    shared = staged(keyed.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-shared")
    rows = keyed.join(shared, "sha", "left").select("id", "url", "payload", "sha", "first", (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(root)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, offset = None, 0
        try:
            for b in batches:
                found = []
                for page_id, url, payload, sha, first, revisit in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    if out is None:
                        fs.create_dir(top, recursive=True)
                        out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    member = encode_record(page_id, url, payload.encode(), digest, first if revisit else None, revisit)
                    out.write(member)
                    found.append((page_id, url, name, offset, len(member), digest, "revisit" if revisit else "response"))
                    offset += len(member)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    index = staged(rows.mapInArrow(run, INDEX), "warc-index")
    named = {r[0] for r in index.select("file").distinct().collect()}
    fs, top = open_fs(root)
    for f in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
        if f.base_name not in named:
            fs.delete_file(f.path)
    return index


def ranges(rows: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = RANGE) -> Iterator[tuple[str, int, int, list[int]]]:
    """Coalesce (file, offset, length), sorted, to (file, start, end, row numbers)."""
    file, start, end, held = None, 0, 0, []
    for i, (f, at, n) in enumerate(rows):
        if held and (f != file or at > end + gap or max(end, at + n) - start > most):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = f, at, at + n
        held.append(i)
        end = max(end, at + n)
    if held:
        yield file, start, end, held


def read_records(index: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows. Digest and length of a response are taken from its payload as read."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    small_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(root)
        handle, opened = None, None
        for b in batches:
            files, offsets, lengths, urls = (b.column(n).to_pylist() for n in ("file", "offset", "length", "url"))
            for file, start, end, held in ranges(zip(files, offsets, lengths, strict=True)):
                if file != opened:
                    if handle is not None:
                        handle.close()
                    handle, opened = fs.open_input_file(f"{top}/{file}"), file
                handle.seek(start)
                data = handle.read(end - start)
                found = []
                for i in held:
                    fields, http, payload = decode_record(data[offsets[i] - start : offsets[i] - start + lengths[i]])
                    kind = fields["WARC-Type"]
                    if kind == "response":
                        digest, size = digest32(payload), len(payload)
                    else:
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
                    if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"{file} at {offsets[i]}: digest does not match")
                    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                    found.append((None if page is None else int(page), urls[i], kind, digest, size, None if refers is None else int(refers), payload if payloads and kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
        if handle is not None:
            handle.close()

    # The index is small; the number of tasks follows the bytes that it points to.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // SPAN))
    spread = index.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.select("file", "offset", "length", "url").mapInArrow(run, RECORD)


def archive_folder(spark: SparkSession) -> str:
    return scratch(spark, "warc")
