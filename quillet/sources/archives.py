"""Zip and tar archives as rows: a listing for the guards, and the files themselves with safe relative paths.

A zip is listed from the directory at its end, which is read by ranges; a tar is read as a stream. Guards come before a byte is
inflated, and no member is inflated beyond the size that the listing gives, so an archive that would grow beyond its limits is refused in
constant memory. What cannot be read is a row with an issue, as a damaged archive is.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .docx import _files, _selector

SUFFIXES = (".zip", ".tar", ".tar.gz", ".tgz")  # fixed values
SCHEMA = "archive string, name string, size long, is_dir boolean, content binary, issue string"
_DAMAGED = (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, zlib.error, NotImplementedError, RuntimeError, ValueError)


@dataclass(frozen=True)
class Limits:
    """Guards of an archive: members, bytes of all of them, bytes of the archive itself."""

    entries: int = 12_000
    expanded: int = 1 << 30
    packed: int = 256 << 20


def supported(name: str) -> bool:
    return name.lower().endswith(SUFFIXES)


def safe_path(name: str) -> str | None:
    """The normal form of a member's path; null if it leaves the folder."""
    path = posixpath.normpath(name.replace("\\", "/"))
    return None if path.startswith(("/", "../")) or path in ("..", ".") or (len(path) > 1 and path[1] == ":") else path


def _directory(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The members of a zip without links."""
    return [i for i in z.infolist() if (i.external_attr >> 16) & 0o170000 != 0o120000]


def refused(sizes: Iterator[int], packed: int, limits: Limits) -> str | None:
    """The guard that an archive fails, looking at no more members than it takes to tell."""
    if packed > limits.packed:
        return "archive too large"
    total = 0
    for n, size in enumerate(sizes, 1):
        total += size
        if n > limits.entries:
            return "too many entries"
        if total > limits.expanded:
            return "too large"
    return None


class _Bounded(io.RawIOBase):
    """A stream that ends with an error once it has given more than it may; it knows how it ended."""

    def __init__(self, raw, most: int) -> None:
        self.raw, self.left, self.tail, self.over = raw, most, b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.raw.read(len(into))
        self.left, self.over = self.left - len(data), not data
        self.tail = (self.tail + data)[-512:]
        if self.left < 0:
            raise OverflowError
        into[: len(data)] = data
        return len(data)


def members(file, name: str, with_content: bool, limits: Limits = Limits(), only: set[str] | None = None, packed: int | None = None) -> Iterator[tuple]:
    """(name, size, is_dir, content, issue) of the regular members of an open file; links and devices go."""
    if packed is None:
        packed = file.seek(0, io.SEEK_END)
        file.seek(0)
    try:
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(file) as z:
                found = _directory(z)
                if issue := refused((i.file_size for i in found), packed, limits):
                    yield None, None, False, None, issue
                    return
                for i in found:
                    if only is None or i.filename in only:
                        content = issue = None
                        if with_content and not i.is_dir():
                            with z.open(i) as f:
                                content = f.read(i.file_size + 1)
                            if len(content) != i.file_size:
                                content, issue = None, "not of its size"
                        yield i.filename, i.file_size, i.is_dir(), content, issue
            return
        if packed > limits.packed:
            yield None, None, False, None, "archive too large"
            return
        raw = zlib_stream(file) if name.lower().endswith(("gz", "tgz")) else file
        # headers and paddings count as well: half a kilobyte or so for each member
        bounded = _Bounded(raw, limits.expanded + 1536 * (limits.entries + 1))
        with tarfile.open(fileobj=io.BufferedReader(bounded, 1 << 16), mode="r|") as t:
            n = total = 0
            for m in t:
                if not (m.isfile() or m.isdir()):
                    continue
                n, total = n + 1, total + m.size
                if n > limits.entries or total > limits.expanded:
                    yield None, None, False, None, "too many entries" if n > limits.entries else "too large"
                    return
                yield m.name, m.size, m.isdir(), t.extractfile(m).read() if with_content and m.isfile() else None, None
        if bounded.over and bounded.tail.strip(b"\0"):  # no empty block at the end
            yield None, None, False, None, "damaged tar"
    except OverflowError:
        yield None, None, False, None, "too large"
    except _DAMAGED:
        yield None, None, False, None, f"damaged {'zip' if name.lower().endswith('.zip') else 'tar'}"


def zlib_stream(file):
    """A gzip file as a stream."""
    import gzip

    return gzip.GzipFile(fileobj=file)


def listing(files: DataFrame, with_content: bool = False, limits: Limits = Limits()) -> DataFrame:
    """(archive, name, size, is_dir, content, issue) of the members of archive files(path, content). An archive that a guard
    refuses, or that is damaged, has a row without a name behind what could be read of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string())
        names = ["archive", "name", "size", "is_dir", "content", "issue"]
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                found, size = [], 0
                for m in members(io.BytesIO(content.as_py() or b""), path.as_py(), with_content, limits):
                    found.append((path.as_py(), *m))
                    size += len(m[3] or b"")
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return files.where(F.lower("path").rlike(r"\.(zip|tar|tar\.gz|tgz)$")).select("path", "content").mapInArrow(run, SCHEMA)


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(path): the members of an archive, or of all archives in a folder.

    Options: content (true); entries, expanded, packed, the guards; split (64 MiB), the bytes of members of a task. The members of a single zip
    are dealt to tasks by its directory; of a folder each archive is a task.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.content, self.split = options["path"], str(options.get("content", "true")).lower() == "true", int(options.get("split", 64 << 20))
        self.limits = Limits(*(int(options.get(k, v)) for k, v in vars(Limits()).items()))

    def partitions(self) -> list[InputPartition]:
        files, path = _files(self.path)
        if not files.get_file_info(path).is_file:
            found = files.get_file_info(_selector(path, True))
            return [InputPartition((f.path, None)) for f in sorted(found, key=lambda f: f.path) if f.is_file and supported(f.path)]
        if not (self.content and path.lower().endswith(".zip")):
            return [InputPartition((path, None))]
        try:
            with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:  # its end alone
                found = _directory(z)
                if refused((i.file_size for i in found), f.size(), self.limits):
                    return [InputPartition((path, None))]
        except _DAMAGED:
            return [InputPartition((path, None))]
        parts: list[list[str]] = [[]]
        size = 0
        for i in sorted(found, key=lambda i: i.header_offset):
            if parts[-1] and size + i.file_size > self.split:
                parts.append([])
                size = 0
            parts[-1].append(i.filename)
            size += i.file_size
        return [InputPartition((path, tuple(p))) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, only = partition.value
        files, _ = _files(self.path)
        with files.open_input_file(path) as f:
            for m in members(f, path, self.content, self.limits, None if only is None else set(only), f.size()):
                yield (path, *m)
