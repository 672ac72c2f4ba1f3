"""Hash chains over a stream whose keys lie in the state store: a batch touches the keys of its own logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweave.operators.integrity import keyed_digest, line_digest

_KEY, _LINE = 0, 1
_STATE = "method string, key binary, line_no bigint"
_OUT = "log_id string, line_no bigint, mac binary, last_key binary"


def _extend(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    log = group[0]
    method, key, last = state.get if state.exists else (None, None, None)
    events = pd.concat(list(frames)).sort_values(["kind", "line_no"], kind="stable")
    out = []
    for r in events.itertuples(index=False):
        data = bytes(r.data) if r.data is not None else b""
        if r.kind == _KEY:
            if key is None:
                method, key = r.method, data
            continue
        if key is None:
            raise ValueError(f"log {log!r} has no first key")
        if last is not None and r.line_no <= last:
            raise ValueError(f"line {r.line_no} of log {log!r} comes after line {last}")
        last = int(r.line_no)
        out.append([log, last, line_digest(key, data), None])
        key = keyed_digest(method, key, data)
    state.update((method, key, last))
    if out:
        out[-1][3] = key
    yield pd.DataFrame(out, columns=["log_id", "line_no", "mac", "last_key"])


def chain_stream(lines: DataFrame, first_keys: DataFrame) -> DataFrame:
    """``log_id, line_no, mac, last_key`` of a stream of ``(log_id, line_no, line)``.

    ``first_keys`` is a stream too, of rows as from ``integrity.init_keys``; a log's key
    comes before its lines or in the same batch, and a second one changes nothing. The
    running key, the method and the last line are the state of a log. ``last_key`` is set in the
    last row that a batch has of a log: :func:`latest_keys`.

    Unlike ``jobs.ChainStream`` nothing is rewritten for logs that are silent, so use this for many
    logs, with the RocksDB state store. A log's lines of one batch are sorted in
    memory: bound batches at the source, or split a log that holds most lines
    by ``segments``. A null line counts as an empty one. A line without a first key, or with a number that is
    not beyond the last one of its log, is an error, as a chain cannot take it in.
    """
    none = F.lit(None)
    events = lines.select(
        "log_id", F.lit(_LINE).alias("kind"), F.col("line_no").cast("bigint").alias("line_no"),
        none.cast("string").alias("method"), F.col("line").cast("binary").alias("data")).unionByName(
        first_keys.select("log_id", F.lit(_KEY).alias("kind"), F.lit(-1).cast("bigint").alias("line_no"),
                          "method", F.col("last_key").alias("data")))
    return events.groupBy("log_id").applyInPandasWithState(
        _extend, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def latest_keys(written: DataFrame, first_keys: DataFrame) -> DataFrame:
    """The key table for ``integrity.verify`` from all rows that :func:`chain_stream` has given."""
    last = (written.filter("last_key IS NOT NULL").groupBy("log_id")
            .agg(F.max(F.struct("line_no", "last_key"))["last_key"].alias("_k")))
    return (first_keys.join(last, "log_id", "left")
            .select("log_id", "method", "key0", F.coalesce("_k", "last_key").alias("last_key")))
