"""A topic without a broker: a log of messages in a shared folder, as a Spark data source.

``<path>/partition=<p>/<first offset>/<n>-<records>.jsonl`` holds the messages of
one committed write; a line is one message, a JSON array of key and value.  Every
record has a partition and an offset, so dead letters can point at it and a
stream can start at the latest record.

Writing follows Spark's commit protocol for Python data sources: each task writes
one staged file and reports it; the driver's commit moves the whole staged folder
to its offset in one rename, which fails if another writer took the offset, and
is then tried at the next one.  A killed task or job leaves staged files only,
which no reader looks at.  A micro-batch is written once, whatever is replayed.

Only Spark's own channels between the JVM and Python are used; the source opens
no port.  Paths are plain or URIs of a file system that pyarrow knows.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter,
                                    InputPartition, WriterCommitMessage)

NAME = "message_log"
SCHEMA = "partition int, offset bigint, key string, value string"
#: Records that one task reads at most, unless one file has more than that.
RECORDS_PER_TASK = 100_000
BATCH_ROWS = 10_000
_ARROW = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.string()), ("value", pa.string())])


def _open(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _names(fs, folder: str) -> list[str]:
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)))


@dataclass(frozen=True)
class Piece:
    """One file: its records have the offsets first .. first + n - 1."""
    partition: int
    first: int
    n: int
    path: str


def pieces_of(path: str) -> list[Piece]:
    """All committed files, by partition and offset."""
    fs, root = _open(path.rstrip("/"))
    out = []
    for folder in _names(fs, root):
        if not folder.startswith("partition="):
            continue
        for first in _names(fs, f"{root}/{folder}"):
            at = int(first)
            for name in _names(fs, f"{root}/{folder}/{first}"):
                if name.endswith(".jsonl"):
                    n = int(name.removesuffix(".jsonl").rpartition("-")[2])
                    out.append(Piece(int(folder[10:]), at, n, f"{root}/{folder}/{first}/{name}"))
                    at += n
    return sorted(out, key=lambda p: (p.partition, p.first))


def ends_of(path: str) -> dict[str, int]:
    """The offset behind the last record, by partition."""
    return {str(p.partition): p.first + p.n for p in pieces_of(path)}


class Range(InputPartition):
    """Records lo .. hi - 1 of some consecutive files of one partition."""

    def __init__(self, pieces: list[Piece], lo: int, hi: int):
        super().__init__(None)
        self.pieces, self.lo, self.hi = pieces, lo, hi


def ranges(pieces: list[Piece], start: dict[str, int], end: dict[str, int], limit: int = RECORDS_PER_TASK) -> list[Range]:
    """Tasks for the records from ``start`` to ``end`` (offsets by partition): whole small files together, large ones cut."""
    out: list[Range] = []
    for p in pieces:
        lo, hi = max(p.first, start.get(str(p.partition), 0)), min(p.first + p.n, end.get(str(p.partition), 0))
        while lo < hi:
            to = min(hi, lo + limit)
            last = out[-1] if out else None
            if last and last.pieces[-1].partition == p.partition and last.hi == lo and to - last.lo <= limit:
                last.pieces, last.hi = [*last.pieces, p], to
            else:
                out.append(Range([p], lo, to))
            lo = to
    return out


def read_range(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    fs, _ = _open(path)
    for p in part.pieces:
        rows = []
        with fs.open_input_stream(p.path) as stream:
            for k, line in enumerate(_lines(stream)):
                offset = p.first + k
                if offset >= part.hi:
                    break
                if offset >= part.lo:
                    rows.append((p.partition, offset, *json.loads(line)))
                    if len(rows) == BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class LogReader(DataSourceReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def partitions(self):
        return ranges(pieces_of(self.path), {}, ends_of(self.path), self.limit) or [Range([], 0, 0)]

    def read(self, partition):
        yield from read_range(self.path, partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, limit: int, latest: bool):
        self.path, self.limit, self.latest = path, limit, latest

    def initialOffset(self) -> dict:
        return ends_of(self.path) if self.latest else {}

    def latestOffset(self) -> dict:
        return ends_of(self.path)

    def partitions(self, start: dict, end: dict):
        return ranges(pieces_of(self.path), start, end, self.limit)

    def read(self, partition):
        yield from read_range(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class Staged(WriterCommitMessage):
    """A task's file, without its last name: that has the place of the task."""

    def __init__(self, path: str, n: int):
        self.path, self.n = path, n


class _Staging:
    def __init__(self, path: str, partition: int):
        self.path, self.partition = path.rstrip("/"), partition
        self.job = uuid.uuid4().hex

    def _stage(self) -> str:
        return f"{_open(self.path)[1]}/_staged/{self.job}"

    def write(self, iterator) -> Staged:
        fs, _ = _open(self.path)
        fs.create_dir(self._stage(), recursive=True)
        path, n = f"{self._stage()}/{uuid.uuid4().hex}.part", 0
        with fs.open_output_stream(path) as out:
            for row in iterator:
                key = row["key"] if "key" in row else None
                out.write(json.dumps([key, row["value"]], ensure_ascii=False).encode() + b"\n")
                n += 1
        return Staged(path, n)

    def publish(self, messages: list[Staged | None], mark: str | None = None) -> int:
        """Move the staged records behind the last one; returns how many.  ``mark`` names a write that is done once."""
        fs, root = _open(self.path)
        messages = [m for m in messages if m is not None]
        marks = f"{root}/_written"
        if mark is not None and mark in _names(fs, marks):
            return 0
        total = sum(m.n for m in messages)
        if total:
            ready = f"{self._stage()}/ready"
            fs.create_dir(ready, recursive=True)
            for k, m in enumerate(messages):
                if m.n:
                    fs.move(m.path, f"{ready}/{k:06d}-{m.n}.jsonl")
            if mark is not None:                  # travels with the records, so that the move marks the write as well
                with fs.open_output_stream(f"{ready}/{mark}.mark"):
                    pass
            self._move_behind_the_last(fs, root, ready, mark)
        if mark is not None:
            fs.create_dir(marks, recursive=True)
            with fs.open_output_stream(f"{marks}/{mark}"):
                pass
        self.discard()
        return total

    def _move_behind_the_last(self, fs, root: str, ready: str, mark: str | None) -> None:
        folder = f"{root}/partition={self.partition}"
        fs.create_dir(folder, recursive=True)
        while True:
            if mark is not None and any(f"{mark}.mark" in _names(fs, f"{folder}/{d}") for d in _names(fs, folder)[-8:]):
                return                            # moved before, but the driver was lost before it noted so
            target = f"{folder}/{ends_of(self.path).get(str(self.partition), 0):020d}"
            if fs.get_file_info(target).type == pafs.FileType.NotFound:
                try:
                    fs.move(ready, target)
                    return
                except OSError:
                    if fs.get_file_info(target).type == pafs.FileType.NotFound:
                        raise

    def discard(self) -> None:
        fs, _ = _open(self.path)
        if fs.get_file_info(self._stage()).type != pafs.FileType.NotFound:
            fs.delete_dir(self._stage())


class LogWriter(_Staging, DataSourceWriter):
    def __init__(self, path: str, partition: int, mark: str | None = None):
        super().__init__(path, partition)
        self.mark = mark

    def commit(self, messages) -> None:
        self.publish(messages, self.mark)

    def abort(self, messages) -> None:
        self.discard()


class LogStreamWriter(_Staging, DataSourceStreamWriter):
    def __init__(self, path: str, partition: int, writer: str):
        super().__init__(path, partition)
        self.writer = writer

    def commit(self, messages, batchId: int) -> None:
        self.publish(messages, f"{self.writer}-{batchId}")

    def abort(self, messages, batchId: int) -> None:
        self.discard()


class MessageLog(DataSource):
    """Options: ``path``; reading ``startingOffsets`` (earliest or latest), ``recordsPerTask``; writing ``partition``,
    and a name under which something is written once: ``writer`` of a stream (with each batch), ``mark`` of a batch write."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _limit(self) -> int:
        return int(self.options.get("recordsPerTask", RECORDS_PER_TASK))

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["path"], self._limit())

    def streamReader(self, schema) -> DataSourceStreamReader:
        start = self.options.get("startingOffsets", "earliest")
        if start not in ("earliest", "latest"):
            raise ValueError(f"startingOffsets is earliest or latest, not {start}")
        return LogStreamReader(self.options["path"], self._limit(), start == "latest")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a message log is only appended to")
        return LogWriter(self.options["path"], int(self.options.get("partition", 0)), self.options.get("mark"))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return LogStreamWriter(self.options["path"], int(self.options.get("partition", 0)), self.options.get("writer", "stream"))


def publish(messages: DataFrame, path: str, mark: str | None = None, partition: int = 0) -> None:
    """Append ``value`` rows (and ``key``, if there is one) as one commit; a mark that was written before adds nothing."""
    spark = messages.sparkSession
    register_message_log(spark)
    key = "key" if "key" in messages.columns else F.lit(None)
    rows = messages.select((F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), "value")
    w = rows.write.format(NAME).mode("append").options(path=path, partition=partition)
    (w if mark is None else w.option("mark", mark)).save()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All committed records: partition, offset, key, value."""
    register_message_log(spark)
    return spark.read.format(NAME).option("path", path).load()


def register_message_log(spark: SparkSession) -> None:
    """Make ``format("message_log")`` known to the session; the code travels with each job."""
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(MessageLog)
