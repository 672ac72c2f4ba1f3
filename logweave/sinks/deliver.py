"""Delivery: writers, several sinks per rule, and what could not be delivered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.sinks import render

Sink = Callable[[DataFrame, int], None]
_SINKS: dict[str, Sink] = {}
_FILTERS: dict[str, Callable] = {}
#: Name under which dead letters without a registered sink are kept.
NO_SINK = "no_sink"


def register_sink(name: str, fn: Sink) -> None:
    """``fn(frame, batch_id)`` writes the records of rules whose ``sink`` is ``name``."""
    _SINKS[name] = fn


def forget_sink(name: str) -> None:
    """Take a sink out again."""
    _SINKS.pop(name, None)


def registered() -> list[str]:
    return list(_SINKS)


def register_filter(name: str, fn: Callable) -> None:
    """``fn(column) -> condition`` on the message, by name."""
    _FILTERS[name] = fn


def named_filter(records: DataFrame, name: str, column: str = "msg") -> DataFrame:
    return records.filter(_FILTERS[name](F.col(column)))


def _place(path: str, mode: str, batch_id: int | None) -> tuple[str, str]:
    """Where and how to write: a batch has a folder of its own, which a repeated run replaces."""
    return (path, mode) if batch_id is None else (f"{path}/batch={batch_id}", "overwrite")


def write_files(routed: DataFrame, path: str, mode: str = "append",
                ordered: bool = False, batch_id: int | None = None) -> None:
    """One folder per destination. ``ordered`` sorts by range, without one big task.

    With ``batch_id`` the same batch may be written again without writing lines twice.
    """
    path, mode = _place(path, mode, batch_id)
    lines = render.render_file_lines(routed)
    if ordered:
        order = ["dest", *[c for c in ("ts", "seq") if c in lines.columns]]
        lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("dest", "value").write.mode(mode).partitionBy("dest").text(path)


def write_log_table(routed: DataFrame, path: str, mode: str = "append",
                    batch_id: int | None = None, **kw) -> None:
    """Log table as Parquet, partitioned by date for lookups; ``batch_id`` as for files."""
    path, mode = _place(path, mode, batch_id)
    render.to_log_table(routed, **kw).write.mode(mode).partitionBy("date").parquet(path)


def write_forward(routed: DataFrame, format: str, add_host: bool = False,
                  newline: bool = False, mode: str = "append", batch_id: int | None = None,
                  **options) -> None:
    """Forwarded lines as ``value`` rows of any writer, for example ``kafka`` or ``text``.

    ``batch_id`` is for writers with a ``path``; others append.
    """
    if "path" in options:
        options["path"], mode = _place(options["path"], mode, batch_id)
    (render.render_forward(routed, add_host, newline).select("value")
     .write.format(format).mode(mode).options(**options).save())


def write_jdbc(routed: DataFrame, url: str, table: str, properties: dict | None = None,
               batch_rows: int = 10_000, **kw) -> None:
    """Log table into a database; values are bound, rows go in batches."""
    (render.to_log_table(routed, **kw).write.mode("append")
     .option("batchsize", batch_rows).jdbc(url, table, properties=properties or {}))


def explode_actions(rules: DataFrame, column: str = "actions") -> DataFrame:
    """One row per sink of a rule, in order: ``pos``, ``sink`` and ``dest``."""
    return (rules.select("*", F.posexplode(column).alias("pos", "_a"))
            .drop(column).select("*", "_a.*").drop("_a"))


def deliver(routed: DataFrame, batch_id: int, dead_letter: str | None = None) -> dict[str, str]:
    """Hand each registered sink its records; one failing sink does not stop others.

    What a sink did not take goes to the ``dead_letter`` table, marked with the
    sink and batch, and so do records whose sink is null or not registered
    (under ``NO_SINK``). Without such a table either is an error. Returns the
    errors by sink. The records are computed once for all sinks.
    """
    errors: dict[str, str] = {}
    known = F.coalesce(F.col("sink").isin(list(_SINKS)), F.lit(False)) if _SINKS else F.lit(False)
    routed = routed.persist(StorageLevel.DISK_ONLY)

    def bury(mine: DataFrame, name: str) -> None:
        (mine.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").parquet(f"{dead_letter}/sink_name={name}/batch={batch_id}"))

    try:
        for name, fn in _SINKS.items():
            mine = routed.filter(F.col("sink") == name)
            try:
                fn(mine, batch_id)
            except Exception as e:  # noqa: BLE001 - any sink error must stay local
                errors[name] = str(e)
                if dead_letter is None:
                    raise
                bury(mine, name)
        rest = routed.filter(~known)
        unknown = rest.select("sink").distinct()
        names = [r[0] for r in unknown.limit(20).collect()]
        if names:
            more = unknown.count() - 20 if len(names) == 20 else 0
            errors[NO_SINK] = f"no sink is registered as {', '.join(sorted(map(str, names)))}"
            if more > 0:
                errors[NO_SINK] += f", and {more} more"
            if dead_letter is None:
                raise ValueError(errors[NO_SINK])
            bury(rest, NO_SINK)
    finally:
        routed.unpersist()
    return errors


def undelivered(spark, dead_letter: str) -> DataFrame:
    return spark.read.parquet(dead_letter).drop("sink_name", "batch")


def replay(dead_letter: DataFrame, name: str, ledger: str | None = None) -> int:
    """Deliver the lost records of a sink again; returns how many there were.

    ``ledger`` is a folder in which delivered (sink, batch) pairs are kept:
    records of those are left out, so a second call delivers nothing twice.
    """
    mine = dead_letter.filter(F.col("sink") == name)
    if ledger is not None and "batch_id" in mine.columns:
        done = _ledger(mine.sparkSession, ledger).filter(F.col("sink") == name).select("batch_id")
        # the ledger grows for ever: how it is joined follows from its size
        mine = mine.join(done.distinct(), "batch_id", "left_anti")
    mine = mine.persist(StorageLevel.DISK_ONLY)
    try:
        n = mine.count()
        if n:
            _SINKS[name](mine, -1)
            if ledger is not None:
                mine.select("sink", "batch_id").distinct().write.mode("append").parquet(ledger)
    finally:
        mine.unpersist()
    return n


def _ledger(spark, path: str) -> DataFrame:
    schema = "sink string, batch_id bigint"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was replayed yet
        return spark.createDataFrame([], schema)
