"""What outputs receive: file lines, forwarded lines, log tables, SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import clock, codes, text
from logweave.operators.ordering import number_rows
from logweave.operators.parse import drop_empty


def _pri(df: DataFrame) -> Column:
    return F.col("pri") if "pri" in df.columns else F.col("fac") * 8 + F.col("sev")


def render_file_lines(routed: DataFrame) -> DataFrame:
    """``dest, value``: ``Mon dd HH:MM:SS host message``."""
    line = F.concat(clock.header_time(F.col("ts")), F.lit(" "), F.col("host"), F.lit(" "),
                    F.col("msg"))
    keep = [c for c in ("ts", "seq") if c in routed.columns]
    return drop_empty(routed).select("dest", *keep, line.alias("value"))


def render_forward(routed: DataFrame, add_host: bool = False, newline: bool = False) -> DataFrame:
    """``dest, value``: ``<PRI>Mon dd HH:MM:SS [host ]message``."""
    host = F.concat(F.col("host"), F.lit(" ")) if add_host else F.lit("")
    value = F.concat(F.lit("<"), _pri(routed).cast("string"), F.lit(">"),
                     clock.header_time(F.col("ts")), F.lit(" "), host, F.col("msg"),
                     F.lit("\n" if newline else ""))
    return drop_empty(routed).select("dest", value.alias("value"))


def to_log_table(routed: DataFrame, facility: bool = True, priority: bool = True,
                 number: bool = False, hot_rows: int = 1_000_000, keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``[facility, priority,] date, time, host, message[, seq]``, and columns ``keep`` behind.

    ``number`` adds a dense ``seq`` in time order without a global sort.
    """
    df = routed
    if number:
        df = number_rows(df, name="_no", hot_rows=hot_rows)
    cols = []
    if facility:
        cols.append(codes.facility_name(F.col("fac")).alias("facility"))
    if priority:
        cols.append(codes.severity_name(F.col("sev")).alias("priority"))
    cols += [F.col("ts").cast("date").alias("date"), clock.clock_text(F.col("ts")).alias("time"),
             F.col("host"), F.col("msg").alias("message")]
    if number:
        cols.append(F.col("_no").cast("bigint").alias("seq"))
    return df.select(*cols, *keep)


def to_log_table_ts(routed: DataFrame) -> DataFrame:
    """Rows keyed by (timestamp, host, message), one per key: the earliest by ``seq``.

    Copies are merged map-side first, so a line repeated everywhere is no burden.
    """
    first = F.min(F.struct("seq", "fac", "sev")).alias("_f")
    return (routed.groupBy("ts", "host", "msg").agg(first)
            .select(codes.facility_name(F.col("_f.fac")).alias("facility"),
                    codes.severity_name(F.col("_f.sev")).alias("priority"),
                    F.col("ts").alias("timestamp"), "host", F.col("msg").alias("message")))


def render_sql(log_rows: DataFrame, table: str) -> DataFrame:
    """``value``: an INSERT statement per log-table row, for text exports."""
    cols = log_rows.columns
    quoted = [F.coalesce(F.concat(F.lit("'"), text.sql_escape(F.col(c).cast("string")), F.lit("'")),
                         F.lit("NULL")) for c in cols]
    head = f"INSERT INTO {table} ({', '.join(cols)}) VALUES("
    return log_rows.select(F.concat(F.lit(head), F.concat_ws(", ", *quoted),
                                    F.lit(")")).alias("value"))


def lookup(log_rows: DataFrame, date: str | None = None, time_from: str | None = None,
           time_to: str | None = None, host: str | None = None,
           prefix: str | None = None) -> DataFrame:
    """Log-table rows by date, time of day, host and start of message.

    Plain comparisons only, so they reach the scan as partition and row-group filters.
    """
    df = log_rows
    if date is not None:
        df = df.filter(F.col("date") == F.lit(date).cast("date"))
    if time_from is not None:
        df = df.filter(F.col("time") >= time_from)
    if time_to is not None:
        df = df.filter(F.col("time") < time_to)
    if host is not None:
        df = df.filter(F.col("host") == host)
    if prefix is not None:
        df = df.filter(F.col("message").startswith(prefix))
    return df
