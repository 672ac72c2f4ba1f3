"""Shared helpers: words of Arrow text columns as numpy arrays, and row keys."""

from __future__ import annotations

import os
import re
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import shared_dir

#: Fixed value: a word is a run of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task turns into numpy arrays at a time.
SLICE_BYTES = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable(df: DataFrame) -> DataFrame:
    """``df`` if it reads rows in the same order each time (a scan with filters), else written first."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    kinds = {re.sub(r"^[\s:+|-]*(\w+).*", r"\1", line) for line in plan.splitlines() if line.strip()}
    if kinds <= {"Project", "Filter", "Relation", "RelationV2", "LogicalRDD", "LocalRelation"}:
        return df
    return written(df, "rows")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a number that tells rows apart even if their ids are null or repeated.

    The number is the row's place in the scan; give it a ``stable`` frame if it is used twice.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def text_slices(batches: Iterator[pa.RecordBatch], column: str,
                most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends, and for each row the number of words before it (one more).

    ``between`` says of each byte whether it stands between words.
    """
    data, offsets = text_buffers(column)
    inside = ~between[data]
    new_row = np.zeros(len(data) + 1, bool)
    new_row[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | new_row[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | new_row[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = False) -> np.ndarray:
    """A 64-bit hash per word, computed for all words of a slice at once."""
    table = _TABLE[_LOWER] if lower else _TABLE
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + SLICE_BYTES, side="right")), first + 1)
        lengths = ends[first:last] - starts[first:last]
        begin = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        powers = np.cumprod(np.full(int(lengths.max()) + 1, _ROOT))
        picked = table[data[np.repeat(starts[first:last], lengths) + at]] * powers[at]
        out[first:last] = np.add.reduceat(picked, begin)
        first = last
    return mix(out)


def rolling(h: np.ndarray, k: int, root: np.uint64 = _ROOT) -> np.ndarray:
    """A hash of each run of ``k`` consecutive entries of ``h``; others come from other odd roots."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= root
        out += h[j:n + j]
    return mix(out)


def inside_rows(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the ``total - k + 1`` runs of ``k`` words lie in one row."""
    n = max(0, total - k + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[:n] == row[k - 1:k - 1 + n]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; cuts its lineage."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_stages(spark: SparkSession, stages: list, sf_dir: str) -> DataFrame:
    """Apply pipeline stages to ``documents``, each on the written result of the one before."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(stages):
            docs = written(docs, name)
    return docs


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for vocabularies and the like."""
    name = "_logweave_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    return sys.modules[name].kept
