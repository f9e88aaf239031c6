"""Event logs: NDJSON files, one for each job, as rows in order; as a batch, and as a stream that goes on as files grow."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .docx import _files, _selector

SCHEMA = "time timestamp, type string, state string, stage string, message string, percent double, current int, total int"


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """(job_id, offset, ...) of lines(job_id, offset, line): blank and broken lines go."""
    whole = lines.where(F.trim(line) != "").withColumn("e", F.from_json(line, SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return whole.where("e._bad IS NULL").select("job_id", "offset", "e.*").drop("_bad")


def _job(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def load(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """(job_id, offset, ...) of the events from line `after` on; blank and broken lines go, but count as lines."""
    whole = spark.read.text(path, wholetext=True).select(_job(F.input_file_name()).alias("job_id"), F.posexplode(F.split("value", "\n")).alias("offset", "line"))
    return parsed(whole.where(F.col("offset") >= after))


def append(folder: str, job: str, event: dict) -> None:
    """One event at the end of a job's log: from the driver, for the few that a run has. Where a file system cannot append, the
    log is written anew."""
    import json

    files, top = _files(folder)
    files.create_dir(top)
    path, line = f"{top}/{job}.ndjson", (json.dumps(event, ensure_ascii=False) + "\n").encode()
    try:
        with files.open_append_stream(path) as f:
            f.write(line)
    except NotImplementedError:
        before = files.open_input_file(path).readall() if files.get_file_info(path).is_file else b""
        with files.open_output_stream(path) as f:
            f.write(before + line)


def stream(spark: SparkSession, path: str, pattern: str = "*.ndjson", most_bytes: int = 256 << 20) -> DataFrame:
    """The events of a folder's logs as they grow; `offset` is the byte at which a line begins. A trigger reads `most_bytes`
    at most, which is the back pressure."""
    spark.dataSource.register(LogSource)
    lines = spark.readStream.format("lines").option("pattern", pattern).option("most_bytes", most_bytes).load(path)
    return parsed(lines.select(_job(F.col("path")).alias("job_id"), "offset", "line"))


class LogSource(DataSource):
    """Lines of the files of a folder that are only ever written to at their ends; as a batch and as a stream.

    Options: path, a folder; pattern (*), of file names; most_bytes (256 MiB), of a trigger; split (64 MiB), of a task. A line is of
    the range of bytes that its line break lies in, wherever it begins, so ranges may be cut anywhere and a line that is not
    ended yet is left to a later range; a batch, which has none, takes the last line as it is. A file that has become shorter is a new one.
    """

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Lines(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LineStream(self.options)


class _Lines(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.most, self.split = int(options.get("most_bytes", 256 << 20)), int(options.get("split", 64 << 20))

    def sizes(self) -> dict[str, int]:
        """Bytes of each file, by its path below the folder."""
        import fnmatch

        files, top = _files(self.path)
        found = files.get_file_info(_selector(top, True))
        return {f.path[len(top) + 1 :]: f.size for f in found if f.is_file and fnmatch.fnmatch(posixpath.basename(f.path), self.pattern)}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        out = []
        for name, stop in sorted(end.items()):
            at = start.get(name, 0)
            at = 0 if at > stop else at
            out += [InputPartition((name, a, min(a + self.split, stop), False)) for a in range(at, stop, self.split)]
        return out

    def partitions(self) -> list[InputPartition]:
        sizes = self.sizes()
        cut = [p.value for p in self.ranges({}, sizes)]
        return [InputPartition((name, a, b, b == sizes[name])) for name, a, b, _ in cut]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, start, stop, last = partition.value
        files, top = _files(self.path)
        with files.open_input_file(f"{top}/{name}") as f:
            begin, step = start, 1 << 16
            while begin > 0:  # back to where the line began that goes on at `start`
                low = max(0, begin - step)
                f.seek(low)
                at = f.read(begin - low).rfind(b"\n")
                if at >= 0:
                    begin = low + at + 1
                    break
                begin = low
            f.seek(begin)
            held, left = b"", stop - begin
            while left > 0 and (chunk := f.read(min(1 << 20, left))):
                left -= len(chunk)
                *lines, held = (held + chunk).split(b"\n")
                for line in lines:
                    yield name, begin, line.removesuffix(b"\r").decode("utf-8", "replace")
                    begin += len(line) + 1
            if last and held:
                yield name, begin, held.decode("utf-8", "replace")


class _LineStream(_Lines, DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """What there is, or as much of it as a trigger may read beyond what it read before: files take their turns by name."""
        left, ends = self.most, dict(self.last)
        for name, size in sorted(self.sizes().items()):
            at = ends.get(name, 0)
            at = 0 if at > size else at
            ends[name] = at + min(size - at, max(left, 0))
            left -= ends[name] - at
        self.last = ends
        return ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = {**end, **self.last} if not self.last else self.last
        return self.ranges(start, end)

    def commit(self, end: dict) -> None:
        """Nothing is kept: files are read by place."""
