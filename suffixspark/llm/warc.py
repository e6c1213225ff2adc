"""WARC: write pages as records, read archives back as rows of payload chunks with digests.

Writing: a record per row, payload the content in UTF-8 (null: empty). Of the rows with equal payloads of at least min_revisit_bytes, the one with
the smallest id is a response (so are repeats of that id; nulls are largest), the others are revisit records, which carry the payload's digest and
length but no payload. Each record is a gzip member. Tasks write files of their own name into a folder that all executors share; the list of files that finished is what is read,
so that what a lost task left is ignored.

Reading: payloads are streamed. Each chunk is a row (record_id, chunk_no, n_bytes, digest of the payload up to its end, last), so that no record is
held whole. Records without payload have one empty chunk."""

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffixspark.session import checkpoint_dir, cut

FILE_BYTES = 32 << 20
CHUNK_BYTES = 64 << 10
CHUNK = "record_id string, record_type string, target_uri string, refers_to string, chunk_no long, n_bytes long, payload_bytes long, digest string, last boolean"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def classify(pages: DataFrame, key: str, content: str, min_revisit_bytes: int = 0) -> DataFrame:
    """key, url, payload, sha (20 bytes) and first (the smallest key with this payload; null: a payload too short for revisits)."""
    payload = F.coalesce(F.encode(F.col(content).cast("string"), "UTF-8"), F.lit(b""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("key"), url.alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    first = cut(rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first"))
    return rows.join(first, "sha", "left")


def _head(kind: str, fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields]) + "\r\n").encode()


def _uri(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def _write_record(out, key: int | None, url: str | None, payload: memoryview, sha: bytes, first: int | None) -> int:
    own, target, digest = f"<urn:page:{'' if key is None else key}>", _uri(url), f"sha1:{base32(sha)}"
    fields = [("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest)]
    if first is not None and key != first:
        more = [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", len(payload))]
        http, body = b"HTTP/1.1 200 OK\r\n\r\n", payload[:0]
        head = _head("revisit", [*fields, *more, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http))])
    else:
        http, body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode(), payload
        head = _head("response", [*fields, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + len(payload))])
    member, size = zlib.compressobj(1, zlib.DEFLATED, 31), 0
    for part in (head + http, *(body[at : at + CHUNK_BYTES] for at in range(0, len(body), CHUNK_BYTES)), b"\r\n\r\n"):
        packed = member.compress(part)
        out.write(packed)
        size += len(packed)
    last = member.flush()
    out.write(last)
    return size + len(last)


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of classify as WARC files into folder; path and records of each finished file. Lazy: cut the result before reading."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    name, size, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                key, url, payload, sha, first = (batch.column(k)[i] for k in range(5))
                size += _write_record(out, key.as_py(), url.as_py(), memoryview(payload.as_buffer()), sha.as_py(), first.as_py())
                records += 1
                if size >= file_bytes:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        names, counts = zip(*done, strict=True) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return rows.select("key", "url", "payload", "sha", "first").mapInArrow(write, "path string, records long")


def _fields(stream) -> dict[str, str]:
    """Header lines up to the empty one; {} at the end of the file."""
    out = {}
    while (line := stream.readline()) not in (b"", b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _chunks(stream, chunk_bytes: int) -> Iterator[tuple]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        h = _fields(stream)
        left, kind = int(h.get("content-length", 0)), h.get("warc-type", "")
        said = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if "application/http" in h.get("content-type", ""):
            while left > 0:
                line = stream.readline(left)
                left -= len(line)
                if line in (b"\r\n", b""):
                    break
        of = (h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-refers-to"))
        if kind == "revisit":
            stream.read(left)
            yield (*of, 0, 0, int(h.get("x-payload-length", 0)), said, True)
            continue
        sha, read, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(left, chunk_bytes))
            if left and not data:
                raise ValueError(f"the archive ends within {of[0]}")
            left -= len(data)
            read += len(data)
            sha.update(data)
            now = base32(sha.digest())
            if not left and said not in (None, now):
                raise ValueError(f"payload of {of[0]} has digest {now}, its header says {said}")
            yield (*of, number, len(data), read, now, not left)
            number += 1
            if not left:
                break


def read_archives(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives in files (a DataFrame with path)."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with gzip.open(io.BufferedReader(_Raw(fs.open_input_file(name)), 1 << 20)) as stream:
                    rows = []
                    for row in _chunks(stream, chunk_bytes):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("path").mapInArrow(read, CHUNK)


class _Raw(io.RawIOBase):
    """An Arrow file as a raw Python stream."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def round_trip(pages: DataFrame, key: str = "page_id", content: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read their chunk table back."""
    folder = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files = cut(write_archives(classify(pages, key, content, min_revisit_bytes), folder))
    scheme = folder.partition("://")[0] if "://" in folder else "file"
    named = files.select(F.concat(F.lit(f"{scheme}://"), "path").alias("path")).repartition(max(1, files.count()))
    return read_archives(named)
