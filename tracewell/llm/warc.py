"""WARC archives: one gzip member a record, written to the shared storage and read back sequentially.

Writing: pages with equal payloads are found by an aggregation of their digests; the one with the
smallest page_id is a ``response``, the others are ``revisit`` records without the payload. Reading:
gzip members are decompressed incrementally, records framed by Content-Length, block and payload
digests verified; a damaged record raises ValueError.

Defined results: null html is an empty payload; a null url has no target header; rows that repeat both
page_id and payload are responses alike; a null page_id never is a response while an equal payload
has an id; an empty table writes no archive and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, qualified, released, scratch

ID_PREFIX = "urn:tracewell:page:"
DATE = "2024-01-01T00:00:00Z"
#: A task starts another archive beyond this many compressed bytes.
ARCHIVE_BYTES = 1 << 30
CHUNK = 1 << 20


def open_fs(uri: str):
    """(filesystem, path) of a folder in the shared storage."""
    from pyarrow import fs

    if re.match(r"\w[\w+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, first) -> bytes:
    """The gzip member of one page; ``first`` is the page_id of the response that it revisits, or None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    head = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<{ID_PREFIX}{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
    }
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if first is not None:
        head["WARC-Refers-To"] = f"<{ID_PREFIX}{first}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head |= {
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "Content-Length": str(len(block)),
    }
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(lines.encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream, chunk: int = CHUNK):
    """The decompressed gzip members of a stream, one after another, never more than one in memory."""
    unpack, parts, fresh = zlib.decompressobj(31), [], True
    data = stream.read(chunk)
    while data:
        parts.append(unpack.decompress(data))
        fresh = False
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts, fresh = unpack.unused_data, zlib.decompressobj(31), [], True
        else:
            data = b""
        data = data or stream.read(chunk)
    if not fresh:
        raise ValueError("the last gzip member is cut short")


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8").split("\r\n")[1:])}


def parse(member: bytes) -> dict:
    """A record's fields, with framing and digests verified."""
    end = member.find(b"\r\n\r\n")
    if end < 0 or not member.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    head = _fields(member[:end])
    block = member[end + 4 : end + 4 + int(head["content-length"])]
    if member[end + 4 + int(head["content-length"]) :] != b"\r\n\r\n":
        raise ValueError(f"record {head.get('warc-record-id')} isn't framed by its Content-Length")
    if head["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"block digest of record {head.get('warc-record-id')} differs")
    cut = block.find(b"\r\n\r\n")
    http, payload = _fields(block[:cut]), block[cut + 4 :]
    if head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{sha1_base32(payload)}":
        raise ValueError(f"payload digest of record {head.get('warc-record-id')} differs")
    number = lambda x: int(x[1:-1].removeprefix(ID_PREFIX)) if x and x[1:-1] != ID_PREFIX else None
    return {
        "page_id": number(head["warc-record-id"]),
        "url": head.get("warc-target-uri"),
        "payload_bytes": int(http["content-length"]),
        "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": head["warc-type"],
        "refers_to": number(head.get("warc-refers-to")),
        "payload": payload if head["warc-type"] == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, least_revisit_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives under ``folder``; returns (path, n_records, n_bytes) of each.

    Every task writes files of its own name; only those of tasks that ended well are listed, so a
    repeated task leaves no record twice. The list is written before it is returned.
    """
    raw = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", raw.alias("payload"), F.sha2(raw, 256).alias("digest"))
    firsts = pages.filter(F.length("payload") >= least_revisit_bytes).groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first"))
    # Which pages revisit which is found on ids alone; payloads are dealt by page, so pages with equal payloads don't meet in a task.
    keys = pages.select("page_id", "digest").distinct()
    refers = keys.join(firsts, F.col("digest") == F.col("of")).filter(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    refers = refers.select(F.col("page_id").alias("id"), "of", "first")
    dealt = pages.join(refers, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left").select("page_id", "url", "payload", "first")
    folder = qualified(pages.sparkSession, folder)

    def run(batches):
        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)
        out, listed, name, n, size = None, [], "", 0, 0
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is not None and size >= ARCHIVE_BYTES:
                    out.close()
                    listed.append((name, n, size))
                    out = None
                if out is None:
                    name, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name)
                member = record(page_id, url, payload, first)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            listed.append((name, n, size))
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*listed, strict=True)], ["path", "n_records", "n_bytes"])

    return materialise(dealt.mapInArrow(lambda batches: released(run(batches)), "path string, n_records bigint, n_bytes bigint"))


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the listed archives (column path): identity, digests, type and, if asked, the payload."""
    folder = qualified(archives.sparkSession, folder)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = {"page_id": "bigint", "payload_bytes": "bigint", "refers_to": "bigint", "payload": "binary"}
    arrow = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        store, _ = open_fs(folder)
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], arrow[kinds.get(k, "string")]) for k in names], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path) as stream:
                    for member in members(stream):
                        rows.append(parse(member))
                        held += len(member) if with_payload else 300
                        if held >= 1 << 24:
                            yield make(rows)
                            rows, held = [], 0
                if rows:
                    yield make(rows)

    return archives.select("path").mapInArrow(lambda batches: released(run(batches)), ", ".join(f"{k} {kinds.get(k, 'string')}" for k in names))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, least_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages, then read the archives back."""
    folder = folder or scratch(spark, "warc")
    return read_archives(write_archives(pages, folder, least_revisit_bytes), folder)
