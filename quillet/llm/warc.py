"""WARC archives in seekable Zstandard bundles.

Pages become WARC 1.1 records: a response for the first of equal payloads (that of the largest page_id), a revisit for
each other. Records are grouped into frames that decompress on their own; a bundle is a run of frames, then a skippable
frame with the record index (record id, frame, offset inside the frame's plain bytes, length), then the seek table
of the Zstandard seekable format as its footer. `record_at` reads one record by its id: footer, index, one frame.

Equal payloads are told by their SHA-1, computed in the scan. Digests are counted before they move, those that occur
twice are joined back to the digests, and what a page refers to is joined to it where it lies (common.placed): payloads
are never shuffled, so one that a third of all pages share is spread like any other. Bundles are rows of a table in the
shared folder (written under Spark's commit protocol, so a lost executor leaves no half bundle); `export` turns a row
into a file.

Defined cases: null html is an empty payload; equal rows of the largest page_id are all responses; pages without
page_id are written under the id "none", never name a response unless no page of theirs has an id, and come back with
a null page_id; other columns are ignored; an empty table gives no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, drop, in_place, placed, stash

FRAME, BUNDLE, LEVEL = 1 << 18, 16 << 20, 3
# Magic numbers of the Zstandard seekable format and of a skippable frame of our own for the record index.
_SEEK, _SKIP_SEEK, _SKIP_INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
_DATE = "2020-01-01T00:00:00Z"  # records carry no clock: equal input gives equal bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, ordinal: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{ordinal}')}>"


def _line(value: str) -> str:
    """A header value on one line; what would break it is escaped."""
    return json.dumps(value, ensure_ascii=False)[1:-1] if any(c in value for c in '\r\n"\\') or value != value.strip() else value


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, first: bool, name: str) -> bytes:
    """One WARC record: an HTTP response with the payload, or its header alone for a revisit."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first else 'revisit'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {_DATE}",
        f"X-Page-ID: {'none' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_line(url)}")
    if not first:
        head.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(6, f"X-Refers-To-Page-ID: {'none' if refers_to is None else refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Parsed:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_bytes(self) -> int:
        """Length of the full payload, which a revisit only states."""
        http = self.block.partition(b"\r\n\r\n")[0].decode()
        return int(next(x.split(":")[1] for x in http.split("\r\n") if x.lower().startswith("content-length:")))


def parse(data: bytes, at: int = 0) -> tuple[Parsed, int]:
    """The record that starts at a place, and the place behind it; its digests are checked."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return Parsed(headers, block), end + 4 + size + 4


class Writer:
    """Collects records into the frames of one bundle."""

    def __init__(self, frame: int = FRAME, level: int = LEVEL) -> None:
        self.frame, self.compressor = frame, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[bytes, int]] = []
        self.plain = bytearray()
        self.index: list[tuple[str, int, int, int]] = []
        self.size = 0

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name, len(self.frames), len(self.plain), len(data)))
        self.plain += data
        self.size += len(data)
        if len(self.plain) >= self.frame:
            self._flush()

    def _flush(self) -> None:
        if self.plain:
            self.frames.append((self.compressor.compress(bytes(self.plain)), len(self.plain)))
            self.plain.clear()

    def close(self) -> bytes:
        self._flush()
        table = zstandard.ZstdCompressor(level=LEVEL).compress("\n".join(f"{n}\t{f}\t{o}\t{s}" for n, f, o, s in self.index).encode())
        sizes = [(len(c), p) for c, p in self.frames] + [(len(table) + 8, 0)]
        seek = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEK)
        return b"".join(
            [*(c for c, _ in self.frames), struct.pack("<II", _SKIP_INDEX, len(table)), table, struct.pack("<II", _SKIP_SEEK, len(seek)), seek]
        )


class Reader:
    """Random and sequential access to a bundle through its footer."""

    def __init__(self, bundle: bytes) -> None:
        count, flags, magic = struct.unpack("<IBI", bundle[-9:])
        if magic != _SEEK or flags:
            raise ValueError("no seek table")
        table = bundle[-9 - 8 * count : -9]
        self.bundle, self.at, place = bundle, [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            self.at.append((place, packed, plain))
            place += packed
        start, packed, _ = self.at.pop()
        rows = zstandard.decompress(bundle[start + 8 : start + packed]).decode()
        self.index = {n: (int(f), int(o), int(s)) for n, f, o, s in (r.split("\t") for r in rows.split("\n") if r)}

    def frame(self, k: int) -> bytes:
        start, packed, plain = self.at[k]
        return zstandard.ZstdDecompressor().decompress(self.bundle[start : start + packed], max_output_size=plain)

    def record_at(self, name: str) -> Parsed:
        frame, offset, size = self.index[name]
        return parse(self.frame(frame)[offset : offset + size])[0]

    def __iter__(self) -> Iterator[tuple[str, Parsed]]:
        last, data = -1, b""
        for name, (frame, offset, size) in self.index.items():
            if frame != last:
                last, data = frame, self.frame(frame)
            yield name, parse(data[offset : offset + size])[0]


def write(pages: DataFrame, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Bundles (bundle_id, n_records, content) of all pages(page_id, url, html), written to the shared folder."""
    rows, buckets = placed(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")))
    payload = F.encode(F.coalesce(F.col("c2"), F.lit("")), "UTF-8").alias("payload")
    digests = rows.select("rid", F.col("c0").alias("page_id"), F.sha1(payload).alias("sha"))
    # a table of its own: a join right above its aggregation could not be split where a payload is hot
    twice = stash(digests.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id")).where("n > 1").select("sha", "first_id"))
    named = digests.join(twice, "sha").select("rid", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, made = TaskContext.get().partitionId(), Writer(frame), 0

        def out() -> pa.RecordBatch:
            nonlocal writer, made
            name = f"bundle-{part:06d}-{made:05d}"
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(writer.index)], pa.int64()), pa.array([writer.close()], pa.binary())], ["bundle_id", "n_records", "content"])
            writer, made = Writer(frame), made + 1
            return row

        for b in batches:
            for rid, page_id, url, payload, ref, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = record_id(page_id, url, rid)  # a row's own, whatever other rows say
                writer.add(name, record(page_id, url, payload, ref, first, name))
                if writer.size >= bundle:
                    yield out()
        if writer.index:
            yield out()

    with in_place(pages.sparkSession):
        typed = rows.select("part", "rid", F.col("c0").alias("page_id"), F.col("c1").alias("url"), payload).join(dealt(named, buckets), ["part", "rid"], "left")
        first = F.col("first_id").isNull() | F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
        out = stash(typed.select("rid", "page_id", "url", "payload", "first_id", first.alias("first")).mapInArrow(run, "bundle_id string, n_records long, content binary"))
    drop(rows, twice)
    return out


def read(bundles: DataFrame) -> DataFrame:
    """Every record of bundles: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, bundle_id."""
    spec = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle_id string"
    number = lambda x: None if x in (None, "none") else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bundle_id, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cols: list[list] = [[] for _ in range(6)]
                for name, r in Reader(content.as_py()):
                    h, kind = r.headers, r.headers["WARC-Type"]
                    sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(r.payload) != sha or len(r.payload) != r.payload_bytes):
                        raise ValueError(f"damaged payload of {name}")
                    for c, v in zip(cols, (number(h["X-Page-ID"]), r.payload_bytes, sha, kind, number(h.get("X-Refers-To-Page-ID")), name), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array([bundle_id] * len(cols[0]), pa.string())],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "bundle_id"],
                )

    return bundles.select("bundle_id", "content").mapInArrow(run, spec)


def export(bundle: bytes, path: str) -> None:
    """Write one bundle as a .warc.zst file."""
    with open(path, "wb") as f:
        f.write(bundle)
