"""Record layouts and code tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Severity names, the first name of a code is the one shown.
SEVERITY_CODES = {
    "emerg": 0, "alert": 1, "crit": 2, "err": 3,
    "warn": 4, "notice": 5, "info": 6, "debug": 7,
}
# Further severity names accepted on input.
SEVERITY_ALIASES = {"panic": 0, "error": 3, "warning": 4}

# Facility numbers (PRI divided by eight).
FACILITY_CODES = {
    "kern": 0, "user": 1, "mail": 2, "daemon": 3, "auth": 4, "syslog": 5,
    "lpr": 6, "news": 7, "uucp": 8, "cron": 9, "authpriv": 10, "ftp": 11,
    "local0": 16, "local1": 17, "local2": 18, "local3": 19,
    "local4": 20, "local5": 21, "local6": 22, "local7": 23,
}
# Further facility names accepted on input; mark is internal.
FACILITY_ALIASES = {"security": 4, "mark": 24}

MARK_FACILITY = 24
USER_NOTICE = 13      # PRI of a line without one
KERN_CRIT = 2         # PRI of a file or BSD kernel line without one
OWN_NAME = "syslogd"  # fixed value: program name in records about ourselves
SYSLOG_ERR = 43       # PRI of an error about ourselves
SYSLOG_INFO = 46      # PRI of a notice about ourselves
MAX_PRI = 1023
# Bytes from which on lines are never collapsed, seconds between
# summaries of repeats, seconds between marks, and their text.
COLLAPSE_BYTES = 120
REPEAT_INTERVALS = (30, 120, 600)
MARK_SECONDS = 20 * 60
MARK_TEXT = "-- MARK --"

RAW_LINES = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("conn_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("arrival_ts", T.TimestampNTZType()),
    T.StructField("peer", T.StringType()),
    T.StructField("is_kernel", T.BooleanType()),
    T.StructField("line", T.StringType()),
])

LOG_RECORDS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("fac", T.IntegerType()),
    T.StructField("sev", T.IntegerType()),
    T.StructField("pri", T.IntegerType()),
    T.StructField("host", T.StringType()),
    T.StructField("prog", T.StringType()),
    T.StructField("msg", T.StringType()),
    T.StructField("is_kernel", T.BooleanType()),
    T.StructField("is_mark", T.BooleanType()),
    T.StructField("source", T.StringType()),
    T.StructField("has_header_ts", T.BooleanType()),
])

RULES = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("selector", T.StringType()),
    T.StructField("program", T.StringType()),
    T.StructField("message_re", T.StringType()),
    T.StructField("host_re", T.StringType()),
    T.StructField("date_re", T.StringType()),
    T.StructField("time_re", T.StringType()),
    T.StructField("inverse", T.BooleanType()),
    T.StructField("dest", T.StringType()),
    T.StructField("sink", T.StringType()),
])

SYMBOLS = T.StructType([
    T.StructField("addr", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("module", T.StringType()),
])

CHAIN_KEYS = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("key0", T.BinaryType()),
    T.StructField("last_key", T.BinaryType()),
])

LINE_MACS = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("mac", T.BinaryType()),
])
