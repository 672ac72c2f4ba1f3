"""Raw lines to log records: one projection, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.functions import clock, codes, text
from logweave.operators.joins import lookup_join
from logweave.operators.once import once


def _has(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def _cut_hosts(lines: DataFrame) -> DataFrame:
    """Add ``_head0``, ``_word`` and ``_rest``: around the host of each line."""
    return (lines.withColumn("_head0", text.dated_head(F.col("line")))
            .withColumn("_tail", text.after(F.col("line"), F.col("_head0")))
            .withColumn("_word", text.first_word(F.col("_tail")))
            .withColumn("_rest", text.after(F.col("_tail"), F.col("_word"))).drop("_tail"))


def split_hosts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take the host from each line: ``(usable, dropped)``.

    The host is the word after the date or, in a line without one, the first
    word. A line with nothing after the host is invalid and goes to ``dropped``.
    """
    others = [c for c in lines.columns if c != "line"]
    cut = once(_cut_hosts(lines), {
        "line": F.concat("_head0", "_rest"), "_whole": F.col("line"),
        "msg_host": text.strip_blanks(F.col("_word")), "_empty": F.col("_rest") == ""}, others)
    usable = cut.filter("NOT _empty").drop("_whole", "_empty")
    return usable, cut.filter("_empty").withColumn("line", F.col("_whole")).select(*lines.columns)


def resolve_peers(lines: DataFrame, hosts: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``peer_host``: the name of the sending address, or the address itself."""
    named = hosts.select(F.col("addr").alias("peer"), F.col("name").alias("_name"))
    return (lookup_join(lines, named, ["peer"], "left",
                        spread=[c for c in ("seq", "line") if c in lines.columns],
                        max_rows=max_rows)
            .withColumn("peer_host", F.coalesce("_name", "peer")).drop("_name"))


def parse_lines(raw: DataFrame, *, default_host: str, ref_ts: Column | str | None = None,
                trust_msg_host: bool = False, strip_domain: bool = False,
                hosts: DataFrame | None = None, network: bool = False,
                strict_bytes: bool = False) -> DataFrame:
    """Log records of a ``raw_lines`` table or stream.

    ``ref_ts`` places times without a year (the arrival time where not given).
    ``trust_msg_host`` takes the host from the line, otherwise it is the name
    of the peer. A row with its own ``pri`` column value uses that instead of
    one in the text. Rows with ``trusted`` (own files) keep their text and
    kernel facility as they are. ``network`` masks bytes that are not
    printable. Times are cut to seconds.
    """
    arrival = F.date_trunc("second", F.col("arrival_ts").cast("timestamp_ntz")).cast("timestamp_ntz") \
        if "arrival_ts" in raw.columns else F.lit(None).cast("timestamp_ntz")
    if ref_ts is None:
        ref = arrival
    elif isinstance(ref_ts, str):
        ref = F.lit(ref_ts).cast("timestamp_ntz")
    else:
        ref = ref_ts
    df = raw
    if network:
        df = df.withColumn("line", text.mask_nonprint(F.col("line")))
    usable = F.lit(True)
    if trust_msg_host:
        df = _cut_hosts(df).withColumn("line", F.concat("_head0", "_rest"))
        host = text.strip_blanks(F.col("_word"))
        usable = F.col("_rest") != ""
    elif hosts is not None:
        df = resolve_peers(df, hosts)
        host = F.col("peer_host")
    else:
        host = _has(df, "peer", None).cast("string")
    if strip_domain:
        host = text.short_host(host)

    line = F.col("line")
    given = _has(df, "pri", None).cast("int")
    kernel = F.coalesce(_has(df, "is_kernel", False), F.lit(False))
    trusted = F.coalesce(_has(df, "trusted", False), F.lit(False))
    stamped = F.coalesce(_has(df, "stamped", True), F.lit(True))
    shown = text.escape_controls(F.col("_body"), strict_bytes) if strict_bytes \
        else text.show_controls(F.col("_flat"))
    # one step per column: each is read by the next ones, none is computed twice
    df = (df.withColumn("_given", given).withColumn("_host", host)
          .withColumn("_digits", F.when(F.col("_given").isNull(), codes.pri_digits(line)))
          .withColumn("_body", codes.after_pri(line, F.col("_digits")))
          .withColumn("_flat", text.flatten_newlines(F.col("_body")))
          .withColumn("_text", F.when(trusted, F.col("_body")).otherwise(shown))
          .withColumn("_fields", clock.header_fields(F.col("_text")))
          .withColumn("_ts", F.when(stamped, clock.header_ts(F.col("_fields"), ref)))
          .withColumn("_pri", F.coalesce("_given", codes.pri_value(F.col("_digits")))))
    dated = F.col("_ts").isNotNull()
    df = (df.withColumn("_pri", F.when(trusted, F.col("_pri")).otherwise(
              codes.guard_kernel(F.col("_pri"), kernel)))
          .withColumn("_msg", F.when(dated, F.substr("_text", F.col("_fields.cut") + 1))
                      .otherwise(F.col("_text"))))
    passed = [_has(df, "seq", None).cast("bigint").alias("seq"), kernel.alias("is_kernel"),
              _has(df, "source", None).cast("string").alias("source")]
    made = once(df, {
        "ts": F.coalesce("_ts", arrival), "fac": codes.facility_of(F.col("_pri")),
        "sev": codes.severity_of(F.col("_pri")), "pri": F.col("_pri"),
        "host": F.coalesce(F.nullif("_host", F.lit("")), F.lit(default_host)),
        "prog": text.program_of(F.col("_msg")), "msg": F.col("_msg"),
        "has_header_ts": dated, "_usable": usable}, passed)
    return (made.filter("_usable") if trust_msg_host else made).select(
        "seq", "ts", "fac", "sev", "pri", "host", "prog", "msg", "is_kernel",
        F.lit(False).alias("is_mark"), "source", "has_header_ts")


def drop_empty(records: DataFrame) -> DataFrame:
    """Records with a message; sinks and filters take no others."""
    return records.filter(F.col("msg") != "")


def name_codes(records: DataFrame) -> DataFrame:
    """Add ``facility`` and ``priority`` names."""
    return (records.withColumn("facility", codes.facility_name(F.col("fac")))
            .withColumn("priority", codes.severity_name(F.col("sev"))))


def log_records_empty(spark) -> DataFrame:
    return spark.createDataFrame([], S.LOG_RECORDS)
