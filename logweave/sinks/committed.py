"""Logs that take each batch once: files of finished batches by manifest, and an ordered buffer of what was not delivered."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from logweave.operators.ordering import number_rows

#: Bits of a position for the row within its batch.
ROW_BITS = 40
CLAIM_ROWS = 100_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:", "", path)
    return fs.FileSystem.from_uri(path)


def _put(store: fs.FileSystem, path: str, value: dict) -> None:
    """Write a small file whole: under another name first."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    other = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(other) as out:
        out.write(json.dumps(value).encode())
    store.move(other, path)


def _get(store: fs.FileSystem, path: str) -> dict | None:
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path) as source:
        return json.loads(source.read())


def _names(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json"))


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has finished, under a name that no other attempt takes; no name without rows."""

    file: str | None
    rows: int


class _Writer:
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(f"{folder}/data", recursive=True)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                out = pq.ParquetWriter(f"{folder}/data/{name}", batch.schema, filesystem=store)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, rows)

    def _commit(self, messages: list, batch: str) -> None:
        """A batch is there once its manifest is; of a batch that runs again the first files stay."""
        store, folder = _store(self.path)
        manifest = f"{folder}/commits/{batch}.json"
        if _get(store, manifest) is not None:
            self._drop(messages)
            return
        made = [m for m in messages if m is not None and m.file]
        _put(store, manifest, {"files": [m.file for m in made], "rows": sum(m.rows for m in made)})

    def _drop(self, messages: list) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{folder}/data/{m.file}")


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        super().__init__(path)
        self.batch = batch

    def commit(self, messages: list) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list) -> None:
        self._drop(messages)


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class CommittedLog(DataSource):
    """``df.write.format("committed_log")`` or ``writeStream``; options ``path`` and, in batches, ``batchId``."""

    @classmethod
    def name(cls) -> str:
        return "committed_log"

    def writer(self, schema: T.StructType, overwrite: bool) -> _BatchWriter:
        options = {k.lower(): v for k, v in self.options.items()}
        given = options.get("batchid")
        return _BatchWriter(options["path"], f"{int(given):012d}" if given is not None else f"x{uuid.uuid4().hex}")

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter({k.lower(): v for k, v in self.options.items()}["path"])


def write_committed(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add ``df`` to a committed log as a batch; a batch that is already there is not written again.

    Tasks write files under names of their own; the batch appears with its
    manifest, so files of lost attempts, and of batches that were stopped in between, are never read.
    """
    df.sparkSession.dataSource.register(CommittedLog)
    out = df.write.format("committed_log").option("path", path).mode("append")
    (out if batch_id is None else out.option("batchId", batch_id)).save()


def read_committed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of all batches that were committed."""
    store, folder = _store(path)
    files = [f for name in _names(store, f"{folder}/commits") for f in _get(store, f"{folder}/commits/{name}")["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/data/{f}" for f in files])


def write_keyed(df: DataFrame, path: str, keys: list[str], batch_id: int) -> None:
    """Add the rows of a batch whose key a committed log does not have yet: a unique key over its life.

    Of rows with one key inside the batch any one is taken (give it unique
    rows to choose); nulls are equal. Keys are unique on both sides of the join, so none is hot, and
    only files whose range of the first key meets the batch's are read. A batch that is already there is
    left as it is; there may be one writer at a time.
    """
    spark = df.sparkSession
    store, folder = _store(path)
    if _get(store, f"{folder}/commits/{batch_id:012d}.json") is not None:
        return
    df = df.dropDuplicates(keys)
    low, high = df.agg(F.min(keys[0]), F.max(keys[0])).first()
    first = F.col(keys[0])
    near = first.isNull() | first.between(F.lit(low), F.lit(high)) if low is not None else first.isNull()
    known = read_committed(spark, path, df.schema).filter(near).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(known[f"_k{i}"])
    write_committed(df.join(known, same, "left_anti"), path, batch_id)


def committed_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``register_sink`` that takes each batch once."""
    return lambda df, batch_id: write_committed(df, path, batch_id)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete files of no committed batch; only while nothing writes. Returns their number."""
    store, folder = _store(path)
    known = {f for name in _names(store, f"{folder}/commits") for f in _get(store, f"{folder}/commits/{name}")["files"]}
    found = store.get_file_info(fs.FileSelector(f"{folder}/data", allow_not_found=True))
    lost = [f.path for f in found if f.base_name not in known]
    for p in lost:
        store.delete_file(p)
    return len(lost)


class SaveBuffer:
    """Records that wait for a sink, in the order in which they came.

    Every record has a position, its batch and its place in that. Delivery
    takes claims: a claim is a stretch of positions, written down before its records
    are handed out and acknowledged after. After a crash the last claim is
    handed out again, the same records under the same number, so a sink that takes a
    number once (:func:`committed_sink`) gets nothing twice, and none is left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.schema = T.StructType([*schema.fields, T.StructField("position", T.LongType())])

    def append(self, df: DataFrame, batch_id: int, ts: str = "ts", seq: str = "seq") -> None:
        """Save a batch in the order of (second, ``seq``); a batch that runs again is not saved twice."""
        numbered = number_rows(df, name="_place", ts=ts, seq=seq)
        made = numbered.withColumn("position", F.lit(batch_id << ROW_BITS).cast("bigint") + F.col("_place"))
        write_committed(made.select(self.schema.names), f"{self.path}/saved", batch_id)

    def records(self) -> DataFrame:
        return read_committed(self.spark, f"{self.path}/saved", self.schema)

    def _marks(self, kind: str, sink: str) -> tuple[fs.FileSystem, str, list[str]]:
        store, folder = _store(self.path)
        place = f"{folder}/{kind}/{sink}"
        return store, place, _names(store, place)

    def waiting(self, sink: str) -> DataFrame:
        """Records that no acknowledged claim of the sink holds."""
        return self.records().filter(F.col("position") > self._acknowledged(sink)[1])

    def _acknowledged(self, sink: str) -> tuple[int, int]:
        """Number and last position of the last claim that was acknowledged."""
        store, place, names = self._marks("acks", sink)
        return (-1, -1) if not names else (int(names[-1][:-5]), _get(store, f"{place}/{names[-1]}")["last"])

    def _claim(self, sink: str, number: int, after: int, rows: int) -> dict | None:
        """The claim of that number, as written down before or made now."""
        store, place, _ = self._marks("claims", sink)
        known = _get(store, f"{place}/{number:012d}.json")
        if known is None:
            first = self.records().select("position").filter(F.col("position") > after).orderBy("position").limit(rows)
            last = first.agg(F.max("position")).first()[0]
            if last is None:
                return None
            known = {"first": after + 1, "last": last}
            _put(store, f"{place}/{number:012d}.json", known)
        return known

    def replay(self, sink: str, fn: Callable[[DataFrame, int], None], rows: int = CLAIM_ROWS) -> int:
        """Hand out all that waits, claim by claim in order; returns the number of claims.

        ``fn`` gets the records of a claim, sorted by position, and the claim's
        number. An error of ``fn`` ends the replay; the next one begins with the same claim.
        """
        done = 0
        number, after = self._acknowledged(sink)
        while (claim := self._claim(sink, number + 1, after, rows)) is not None:
            number, after = number + 1, claim["last"]
            mine = self.records().filter(F.col("position").between(claim["first"], claim["last"]))
            fn(mine.orderBy("position"), number)
            store, place, _ = self._marks("acks", sink)
            _put(store, f"{place}/{number:012d}.json", claim)
            done += 1
        return done
