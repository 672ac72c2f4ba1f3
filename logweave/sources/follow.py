"""A stream over files that grow: what is appended is read on, whatever becomes of a file's name."""

from __future__ import annotations

import hashlib
import posixpath
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logweave.sources.lines import file_lines

SCHEMA = "file string, offset bigint, line string"
#: Bytes at a file's beginning and before a position that tell a file from another one.
HEAD_BYTES = 256
TAIL_BYTES = 1024
READ_BYTES = 1 << 20
SPLIT_BYTES = 64 << 20
BATCH_LINES = 10_000
#: Compressed files among rotated ones were read before they were compressed.
_PACKED = re.compile(r"\.(gz|bz2|xz|zst|Z|zip)$")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:", "", path)
    return fs.FileSystem.from_uri(path)


def _digest(source, start: int, length: int) -> str:
    source.seek(start)
    return hashlib.sha1(source.read(length)).hexdigest()


def _last_end(source, size: int) -> int:
    """The position behind the last line feed in the first ``size`` bytes."""
    at = size
    while at > 0:
        first = max(0, at - READ_BYTES)
        source.seek(first)
        found = source.read(at - first).rfind(b"\n")
        if found >= 0:
            return first + found + 1
        at = first
    return 0


def _record(source, end: int) -> dict:
    """What tells a file that was read up to ``end``: digests of its beginning and of the bytes before ``end``."""
    head = min(HEAD_BYTES, end)
    return {"end": end, "head": _digest(source, 0, head),
            "tail": _digest(source, max(0, end - TAIL_BYTES), min(TAIL_BYTES, end))}


def _matches(store: fs.FileSystem, path: str, size: int, record: dict) -> bool:
    """Whether the file at ``path`` begins with what ``record`` was made of."""
    end = record["end"]
    if size < end:
        return False
    with store.open_input_file(path) as source:
        return _record(source, end) == record


@dataclass
class Stretch(InputPartition):
    """Bytes of one file: lines that begin at ``first`` or behind and before ``last``; ``record`` tells the file."""

    name: str
    begin: int
    first: int
    last: int
    record: dict

    def __init__(self, name: str, begin: int, first: int, last: int, record: dict):
        self.name, self.begin, self.first, self.last, self.record = name, begin, first, last, record


class FollowReader(DataSourceStreamReader):
    """Offsets are snapshots: of each file the end of its last whole line, with digests that tell the file.

    Between two snapshots a file is read on from where a file of the same
    contents ended in the earlier one, under whatever name: renamed and copied
    files go on, truncated and new ones start at the beginning. So no line is
    lost or doubled as long as rotated files stay among those that match the path until they were read.
    """

    def __init__(self, options: dict):
        path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.idle = float(options["idleseconds"]) if "idleseconds" in options else None
        self.lossy = str(options.get("failondataloss", "true")).lower() == "false"
        store, plain = _store(path)
        info = store.get_file_info(plain)
        folder = info.type == fs.FileType.Directory
        self.path = path
        self.folder, self.pattern = (plain, "*") if folder else posixpath.split(plain)
        self.known: dict[str, tuple] = {}

    def _files(self) -> dict[str, fs.FileInfo]:
        store, _ = _store(self.path)
        found = store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return {f.base_name: f for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, self.pattern)
                and not _PACKED.search(f.base_name) and f.base_name[0] not in "._"}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = _store(self.path)
        out = {}
        for name, info in sorted(self._files().items()):
            quiet = self.idle is not None and info.mtime_ns and time.time() - info.mtime_ns / 1e9 >= self.idle
            mark = (info.size, info.mtime_ns, quiet)
            if self.known.get(name, (None,))[0] != mark or not info.mtime_ns:
                try:
                    with store.open_input_file(info.path) as source:
                        size = min(info.size, source.size())
                        end = size if quiet else _last_end(source, size)
                        self.known[name] = mark, _record(source, end)
                except FileNotFoundError:
                    continue  # renamed since it was listed
            if self.known[name][1]["end"]:
                out[name] = self.known[name][1]
        return out

    def _locate(self, name: str, record: dict) -> str:
        """The path of the file that ``record`` was made of, which may have another name by now."""
        store, _ = _store(self.path)
        files = self._files()
        for other in [name, *sorted(files)]:
            if other in files:
                try:
                    if _matches(store, files[other].path, files[other].size, record):
                        return files[other].path
                except FileNotFoundError:
                    continue
        raise FileNotFoundError(f"{name} in {self.folder} was moved or cut before it was read up to byte {record['end']}")

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        store, _ = _store(self.path)
        where, out = {}, []
        for name, record in end.items():
            if start.get(name) != record:
                try:
                    where[name] = self._locate(name, record)
                except FileNotFoundError:
                    if not self.lossy:
                        raise
        starts = {name: self._start(store, name, path, start, end, where) for name, path in where.items()}
        for name, first in starts.items():
            last = end[name]["end"]
            for at in range(first, last, self.split):
                out.append(Stretch(name, first, at, min(at + self.split, last), end[name]))
        return out

    def _start(self, store, name: str, path: str, start: dict, end: dict, where: dict[str, str]) -> int:
        """From where on a file is new."""
        last = end[name]["end"]
        own = start.get(name)
        if own and own["end"] <= last and _matches(store, path, last, own):
            return own["end"]
        # a copy of a file that is still there, called like it and more: its lines are that file's
        for other, r in end.items():
            if other != name and name.startswith(other) and r["end"] >= last:
                if _matches(store, where.get(other) or posixpath.join(self.folder, other), r["end"], end[name]):
                    return last
        # renamed, or copied before it was cut: of several that it may have been, the longest
        before = [r["end"] for other, r in start.items() if other != name and r["end"] <= last
                  and self._moved(store, other, r, start, end, where, name) and _matches(store, path, last, r)]
        return max(before, default=0)

    def _moved(self, store, other: str, record: dict, start: dict, end: dict, where: dict, name: str) -> bool:
        """Whether the file that was ``other`` is no longer it, or ``name`` is called like a copy of it."""
        now = end.get(other)
        if now is None or name.startswith(other):
            return True
        if now == record:
            return False
        path = where.get(other)
        return path is None or now["end"] < record["end"] or not _matches(store, path, now["end"], record)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        path = self._locate(partition.name, partition.record)
        with store.open_input_file(path) as source:
            at = partition.first
            rest = b""
            if at > partition.begin:
                # the line that began before belongs to the stretch before
                at -= 1
                source.seek(at)
                while True:
                    piece = source.read(READ_BYTES)
                    found = piece.find(b"\n")
                    if found >= 0:
                        at += found + 1
                        break
                    at += len(piece)
                    if not piece:
                        return
            source.seek(at)
            end = partition.record["end"]
            offsets: list[int] = []
            lines: list[str] = []
            while at < partition.last:
                piece = source.read(min(READ_BYTES, end - at - len(rest)))
                rest += piece
                whole = rest.split(b"\n")
                rest = whole.pop()
                if not piece and rest:
                    whole, rest = [rest], b""  # an unfinished line of a file that is idle
                for line in whole:
                    if at >= partition.last:
                        break
                    offsets.append(at)
                    lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                    if len(lines) == BATCH_LINES:
                        yield self._batch(partition.name, offsets, lines)
                        offsets, lines = [], []
                if not piece:
                    break
            if lines:
                yield self._batch(partition.name, offsets, lines)

    @staticmethod
    def _batch(name: str, offsets: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.string())],
            names=["file", "offset", "line"])


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files").option("path", folder or pattern)``."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FollowReader:
        return FollowReader({k.lower(): v for k, v in self.options.items()})


def follow_lines(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES,
                 idle_seconds: float | None = None, fail_on_data_loss: bool = True) -> DataFrame:
    """A stream of (file, offset, line): the lines of files that grow, each once.

    ``path`` is a folder or a pattern for names in one folder; it must match
    rotated files too (``app.log*``), compressed ones are left out. A last
    line without a line feed waits for its end; with ``idle_seconds`` it
    counts as a line once its file was not written for so long. Renamed,
    copied and cut, and cut files are told by their contents (see
    :class:`FollowReader`); a restart goes on from the checkpoint. Long files
    are cut into stretches of ``split_bytes`` for several tasks. If a file goes before it was
    read, the query fails, or skips it without ``fail_on_data_loss``.
    """
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("growing_files").option("path", path).option("splitBytes", split_bytes) \
        .option("failOnDataLoss", fail_on_data_loss)
    if idle_seconds is not None:
        reader = reader.option("idleSeconds", idle_seconds)
    return reader.load()


def follow_log_files(spark: SparkSession, path: str, program: str | None = None, *, time_format: str | None = None,
                     start: int = 0, time_length: int | None = None, **options) -> DataFrame:
    """Raw lines of growing log files, like ``read_log_files(stream=True)``, which takes new files only."""
    lines = follow_lines(spark, path, **options)
    named = lines.select(F.lit(program).alias("source") if program else F.col("file").alias("source"),
                         F.current_timestamp().cast("timestamp_ntz").alias("arrival_ts"), "line")
    return file_lines(named, time_format, start, time_length)
