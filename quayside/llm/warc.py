"""WARC archives: one gzip member per record, a sequential reader with incremental decompression.

Writing: pages with equal payloads (at least ``least_bytes`` long) are written once as a response, by the page with the
largest id; the others become revisit records that refer to it and carry only the HTTP head. Each task writes
its own archives into the shared folder under names no other attempt uses; only the archives named in the
returned table count, so a task that is lost and repeated leaves at most unread files.

Reading: one archive per row, read in chunks of 1 MB. Members are decompressed incrementally, the block is framed by
Content-Length, and block and payload digests are verified. A truncated or malformed archive ends the job with its name and offset.

Defined cases: null html is an empty payload; a null url has no target URI and reads back as null; a null id is written as
"none" and reads back as null (as response, unless its payload also belongs to a page with an id); rows that repeat id and payload are
written each, all as responses if theirs is the largest id; an empty table gives no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.shared import text_of, written
from quayside.session import fresh_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "file string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, verified boolean"
_CHUNK = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member of a stream, decompressed chunk by chunk."""
    at, data = 0, stream.read(_CHUNK)
    while data:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not data and not (data := stream.read(_CHUNK)):
                raise ValueError(f"archive ends inside the record at {at}")
            parts.append(unpacker.decompress(data))
            used += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
        yield at, b"".join(parts)
        at += used
        data = data or stream.read(_CHUNK)


def parse(raw: bytes) -> dict:
    """Fields of one record; its block is framed by Content-Length and its digests are verified. A response that announces no length of its own is as long as its block."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block of {size} bytes is announced, {len(rest) - 4} are there")
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    announced = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    whole = fields["warc-type"] == "response"
    good = f"sha1:{base32_sha1(block)}" == fields.get("warc-block-digest") and (not whole or (base32_sha1(payload) == digest and (announced is None or int(announced[1]) == len(payload))))
    return {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
            "payload_digest": digest, "payload_bytes": int(announced[1]) if announced else len(payload), "payload": payload if whole else None, "verified": good}


def _name(key: int | None) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per row of ``pages``; (file, records, bytes) of the archives, as a table."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    decided = rows.join(written(shared, "equal-payloads"), "sha", "left").select("id", "url", "html", "first")

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        name = out = None
        done, size, count = [], 0, 0
        for batch in batches:
            for key, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{len(done)}-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                again = first is not None and first != key
                data = record("revisit" if again else "response", _name(key), url, html.encode("utf-8", "surrogatepass"), _name(first) if again else None)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (f"{folder}/{name}", count, size)], None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        yield pa.RecordBatch.from_pydict({"file": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]}, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(decided.mapInArrow(run, "file string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, file_col: str = "file") -> DataFrame:
    """One row per record of the archives, in the columns of ``RECORD_SCHEMA``."""

    def run(batches):
        from pyarrow import fs

        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        schema = pa.schema(list(zip(names, (pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.bool_()))))
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(file)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for offset, raw in members(stream):
                        try:
                            rows.append({"file": file, "offset": offset} | parse(raw))
                        except (ValueError, KeyError) as e:
                            raise ValueError(f"{file} at {offset}: {e}") from e
                        size += len(raw)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = archives.select(F.col(file_col).alias("file"))
    return files.repartition(max(1, files.count()), "file").mapInArrow(run, RECORD_SCHEMA)
