"""WARC archives written and read by Spark tasks, and transactions assembled from their records.

A page gives three records, one gzip member each: a request and a metadata record that name the response (or revisit)
record in WARC-Concurrent-To, and that record itself. Of pages with equal payloads the one with the smallest id is stored as
a response; the others are revisits that refer to it and keep the HTTP head, so the payload's length and digest are known.
Archives are streamed to and from the shared store through ``pyarrow.fs``; a task that is run again writes files of its own,
and only the files in the manifest are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stereolith.llm import text as T
from stereolith.plans.scratch import Scratch

ARCHIVE_BYTES = 32_000_000
#: Bytes of archives that a reading task takes, where there are more archives than cores.
READ_BYTES = 256_000_000
#: Pages of one payload that meet its first page in one place, and the most payloads with more pages (what is broadcast).
SPLIT, HOT = 1_000, 100_000
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
_KINDS = {"response": 1, "request": 2, "metadata": 3}

RECORD = "path string, position long, record_id string, type string, page_id long, target_uri string, date string, concurrent_to string, refers_to long, payload_digest string, payload_bytes long, fields map<string,string>, block binary"


def record_id(kind: str, page_id: int | None) -> str:
    """An id that holds the page's: kind, whether there is a page id, and the id as 64 bits."""
    number = (_KINDS[kind] << 120) | ((page_id is not None) << 112) | ((page_id or 0) % (1 << 64))
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = number % (1 << 64)
    return (low - (1 << 64) * (low >> 63)) if number >> 112 & 1 else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record(kind: str, ident: str, uri: str | None, date: str, block: bytes, content_type: str, *more: tuple[str, str]) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), *([("WARC-Target-URI", _clean(uri))] if uri is not None else []), *more, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def transaction(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str = DATE) -> bytes:
    """The three records of a page; ``first``: the page whose response holds the same payload, if that isn't this one."""
    main, digest = record_id("response", page_id), f"sha1:{base32_sha1(payload)}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    try:
        parts = urlsplit(url or "")
        host, path = parts.netloc, (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        host, path = "", url or "/"
    asked = f"GET {_clean(path)} HTTP/1.1\r\nHost: {_clean(host)}\r\n\r\n".encode()
    to = ("WARC-Concurrent-To", main)
    if first is None:
        own = _record("response", main, url, date, head + payload, "application/http; msgtype=response", ("WARC-Payload-Digest", digest))
    else:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        own = _record("revisit", main, url, date, head, "application/http; msgtype=response", profile, ("WARC-Refers-To", record_id("response", first)), ("WARC-Payload-Digest", digest))
    return _record("request", record_id("request", page_id), url, date, asked, "application/http; msgtype=request", to) + own + _record("metadata", record_id("metadata", page_id), url, date, f"payload-length: {len(payload)}\r\n".encode(), "application/warc-fields", to)


def _writer(root: str, most: int):
    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, name, size, count, made = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, first in zip(*(c for c in batch.columns), strict=True):
                if out is None or size > most:
                    if out is not None:
                        out.close()
                        made.append((f"{root}/{name}", size, count))
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = transaction(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py())
                out.write(data)
                size += len(data)
                count += 3
        if out is not None:
            out.close()
            made.append((f"{root}/{name}", size, count))
        if made:
            yield pa.record_batch({"path": [m[0] for m in made], "bytes": pa.array([m[1] for m in made], pa.int64()), "records": pa.array([m[2] for m in made], pa.int64())})

    return run


def write_archives(pages: DataFrame, root: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a page's records for each row of ``pages`` (``page_id, url, html``); returns ``path, bytes, records``.

    A null html is an empty payload. Rows that repeat the smallest id of a payload are all responses; a null page id never is the
    one that others refer to, unless no other page has the payload, and then its rows are responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    split = max(SPLIT, pages.count() // HOT)
    first = first.select("digest", "first", F.floor(F.col("n") / split).alias("k"))
    hot = F.broadcast(first.where("k > 0").select("digest", "k"))
    dealt = rows.join(hot, "digest", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("k") + 1), F.lit(0)))
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), "k")).alias("part"))
    met = dealt.join(first, ["digest", "part"], "left").select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("first"))
    return met.mapInArrow(_writer(root, most), "path string, bytes long, records long")


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The gzip members of a stream, one after another."""
    unpack, parts, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(chunk)
        else:
            data = stream.read(chunk)
    if any(parts):
        raise ValueError("an archive ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields (names in lower case) and its block."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _reader(with_block: bool, at_once: int = 8_000_000):
    names = [x.split()[0] for x in RECORD.replace("map<string,string>", "map").split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def row(path: str, k: int, member: bytes) -> tuple:
        f, block = parse(member)
        kind, ident = f["warc-type"], f["warc-record-id"]
        digest = length = None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            digest = f["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                length = len(payload)
                if base32_sha1(payload) != digest:
                    raise ValueError(f"{ident}: the payload differs from its digest")
            else:
                length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        refers = page_of(f["warc-refers-to"]) if "warc-refers-to" in f else None
        return path, k, ident, kind, page_of(ident), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-concurrent-to"), refers, digest, length, list(f.items()), block if with_block or kind not in ("response", "revisit") else None

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for part in batches:
            for path in part.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    for k, member in enumerate(members(stream)):
                        held.append(row(path, k, member))
                        size += len(member) if with_block else 600
                        if size > at_once:
                            yield batch()
                            held.clear()
                            size = 0
        if held:
            yield batch()

    return run


def read_records(manifest: DataFrame, with_block: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` (``path, bytes``) names; without ``with_block``, ``block`` is null for responses and revisits."""
    count, size = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(1, min(count, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, (size or 0) // READ_BYTES)))
    return manifest.select("path").repartitionByRange(tasks, "path").mapInArrow(_reader(with_block), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit record with its request and metadata.

    Records meet through concurrent-to ids within their archive. Records that repeat an id (repeated input rows) are told apart
    by their order. A response without request or metadata has nulls there.
    """
    turn = F.row_number().over(Window.partitionBy("path", "key").orderBy("position"))
    nested = F.struct("record_id", "position", "fields", "block")

    def of(kinds: list[str], key: str) -> DataFrame:
        return records.where(F.col("type").isin(kinds)).withColumn("key", F.col(key)).withColumn("turn", turn)

    main = of(["response", "revisit"], "record_id")
    request = of(["request"], "concurrent_to").select("path", "key", "turn", nested.alias("request"))
    metadata = of(["metadata"], "concurrent_to").select("path", "key", "turn", nested.alias("metadata"))
    met = main.join(request, ["path", "key", "turn"], "left").join(metadata, ["path", "key", "turn"], "left")
    response = F.struct("record_id", "position", "type", "payload_digest", "payload_bytes", "refers_to", "fields", "block").alias("response")
    return met.select("page_id", "path", "target_uri", "date", response, "request", "metadata")


def round_trip(pages: DataFrame, with_block: bool = False) -> DataFrame:
    """``pages`` written to archives in the shared folder, read back and assembled."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.table(write_archives(pages, scratch.path("archives")), "manifest")
    return captures(scratch.table(read_records(manifest, with_block), "records"))
