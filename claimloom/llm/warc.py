"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Reader: each task owns a byte range of one file. It scans for the gzip magic, takes a hit for a
member only if it inflates to a WARC version line, complete headers and a block of the stated
length (with gzip's own checksum), and owns exactly the records that start inside its range; it
reads past the end to finish the last of them. From a record's end the scan goes on, so a damaged
stretch costs the records it holds and no more. Ranges are independent: no index is kept, and
memory is one range and one record.

Writer: each task writes its own files under a temporary name and renames them when whole, so a
task that runs twice leaves the same files. Paths go through a file system found by their URI.

Of equal payloads of LEAST_REVISIT bytes or more, that of the least page_id becomes a response and
the others revisits, whose block holds the HTTP headers alone; digest and length of the full
payload are kept there.

Defined cases: a null payload is empty; a null page_id is kept as null and is never referred to;
repeated rows with the least page_id are all responses; a null url leaves the target out;
characters that a header can't hold are percent-encoded in it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import BATCH_ROWS, scratch_path, small_batches, texts_of

LEAST_REVISIT = 100
#: Bytes of a range, and of an archive file before the next is begun.
RANGE_BYTES = 8 << 20
FILE_BYTES = 256 << 20
#: Tasks that ranges are dealt to, at most; a task takes several ranges then, one after the other.
MOST_TASKS = 20_000

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:page:(-?\d*)>")


def _member(kind: str, page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, n_bytes, first): first is the page that a revisit refers to, else null."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    least = own.where(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return own.join(least, "digest", "left").withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))


def write(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> list[tuple[str, int]]:
    """Writes rows of with_revisits as archives below path; returns the files and their sizes."""
    small_batches(records.sparkSession)

    def task(batches):
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base)
        context = TaskContext.get()
        files, out, size, names = [], None, 0, None

        def finish():
            out.close()
            if fs.get_file_info(names[1]).type != pafs.FileType.NotFound:
                fs.delete_file(names[1])
            fs.move(*names)
            files.append((names[1], size))

        for batch in batches:
            ids, urls, texts = batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), texts_of(batch, "html")
            for page, url, payload, digest, n, first in zip(ids, urls, texts, batch.column("digest").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("first").to_pylist(), strict=True):
                if out is None:
                    name = f"{base}/part-{context.partitionId():06d}-{len(files):04d}.warc.gz"
                    names, size = (f"{base}/.{context.taskAttemptId()}-{len(files)}", name), 0
                    out = fs.open_output_stream(names[0])
                kind = "response" if first is None else "revisit"
                member = _member(kind, page, url, payload if first is None else b"", n, digest, first, date)
                out.write(member)
                size += len(member)
                if size >= file_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([s for _, s in files], pa.int64())], names=["file", "size"])

    kept = records.select("page_id", "url", "html", "digest", "n_bytes", "first").withColumn("page_id", F.col("page_id").cast("long")).withColumn("first", F.col("first").cast("long"))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return [(scheme + r["file"] if scheme else r["file"], r["size"]) for r in kept.mapInArrow(task, "file string, size long").collect()]


def _inflate(data: bytes, at: int, more) -> tuple[bytes, int, bytes] | None:
    """(member's content, offset after it, data, perhaps grown) if a record's member starts at `at`."""
    d, p, out = zlib.decompressobj(31), at, []
    try:
        head = d.decompress(memoryview(data)[p : p + 512])
        if len(head) >= 7 and not head.startswith(b"WARC/1."):
            return None
        p, out = min(p + 512, len(data)), [head]
        while not d.eof:
            if p >= len(data):
                grown = more(len(data))
                if len(grown) == len(data):
                    return None
                data = grown
            chunk = memoryview(data)[p : p + 65536]
            out.append(d.decompress(chunk))
            p += len(chunk)
    except zlib.error:
        return None
    return b"".join(out), p - len(d.unused_data), data


def _parse(content: bytes) -> dict | None:
    head, found, rest = content.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    n = fields.get("content-length", "")
    if not n.isdigit() or len(rest) < int(n) or not {"warc-type", "warc-record-id"} <= fields.keys():
        return None
    fields["block"] = rest[: int(n)]
    return fields


def members(data: bytes, limit: int, more) -> Iterator[tuple[int, dict]]:
    """(offset, fields) of each record that starts before limit; more(n) returns data grown beyond n bytes, if it can."""
    at = 0
    while 0 <= (at := data.find(MAGIC, at)) < limit:
        got = _inflate(data, at, more)
        fields = got and _parse(got[0])
        if fields:
            yield at, fields
            at, data = got[1], got[2]
        else:
            at += 1


def _row(fields: dict, file: str, offset: int) -> tuple:
    http, _, payload = fields["block"].partition(b"\r\n\r\n")
    page, refers = _ID.fullmatch(fields["warc-record-id"]), _ID.fullmatch(fields.get("warc-refers-to", ""))
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    kind = fields["warc-type"]
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields.get("warc-payload-digest", "").removeprefix("sha256:")
    number = lambda m: int(m[1]) if m and m[1] else None
    return number(page), fields.get("warc-target-uri"), kind, len(payload) if kind == "response" else number(length), digest, number(refers), payload if kind == "response" else None, file, offset


READ_SCHEMA = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string, offset long"
_READ_ARROW = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])


def read(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the archives, each range of bytes read on its own; the driver lists files, ranges are made by the tasks."""
    total = sum(-(-n // range_bytes) for _, n in files)
    listed = spark.createDataFrame(files, "file string, size long")
    ranges = listed.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("stop"), "size")
    source = ranges.repartition(max(1, min(total, MOST_TASKS)), "file", "start")

    def task(batches):
        for batch in batches:
            for r in batch.to_pylist():
                fs, name = pafs.FileSystem.from_uri(r["file"])
                with fs.open_input_file(name) as f:
                    held = [f.read_at(min(r["stop"] + len(MAGIC), r["size"]) - r["start"], r["start"])]

                    def more(n, f=f, r=r, held=held):
                        # doubling: what was read is copied a bounded number of times, however long a record is
                        held[0] += f.read_at(min(max(1 << 20, n), r["size"] - r["start"] - n), r["start"] + n)
                        return held[0]

                    rows, size = [], 0
                    for at, fields in members(held[0], r["stop"] - r["start"], more):
                        row = list(_row(fields, r["file"], r["start"] + at))
                        size += len(row[6] or b"")
                        row[6] = row[6] if payloads else None
                        rows.append(row)
                        if size > 4 << 20 or len(rows) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ_ARROW)], schema=_READ_ARROW)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ_ARROW)], schema=_READ_ARROW)

    return source.mapInArrow(task, READ_SCHEMA)


def report(pages: DataFrame) -> DataFrame:
    """Archives of all pages written to the shared folder and read back."""
    spark = pages.sparkSession
    files = write(with_revisits(pages), scratch_path(spark, "warc"))
    return read(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
