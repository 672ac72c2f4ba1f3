"""Hand-made lines for the edges of parsing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave.functions import text
from logweave.operators.parse import parse_lines, split_hosts

ARRIVAL = "2024-01-01 00:00:00"


def parse(spark, line, kernel=False, peer=None, **kw):
    raw = spark.createDataFrame([(1, line, kernel, peer)],
                                "seq bigint, line string, is_kernel boolean, peer string")
    raw = raw.withColumn("arrival_ts", F.lit(ARRIVAL).cast("timestamp_ntz"))
    got = parse_lines(raw, default_host="local", **kw).collect()
    return got[0] if got else None


@pytest.mark.parametrize("line,fac,sev,msg", [
    ("hello", 1, 5, "hello"),
    ("<>hello", 1, 0, "hello"),
    ("<13hello", 1, 5, "hello"),
    ("<1024>x", 1, 5, "x"),
    ("<3>x", 1, 3, "x"),
    ("<200>x", 25, 0, "x"),
    ("<1023>x", 127, 7, "x"),
    ("<99999999999999999999>x", 1, 5, "x"),
    ("<", 1, 0, ""),
])
def test_pri(spark, line, fac, sev, msg):
    r = parse(spark, line)
    assert (r.fac, r.sev, r.msg) == (fac, sev, msg)


def test_kernel_source_keeps_facility(spark):
    r = parse(spark, "<3>x", kernel=True)
    assert (r.fac, r.sev) == (0, 3)


@pytest.mark.parametrize("line,ts,msg,header", [
    ("<13>Jan  1 00:00", ARRIVAL, "Jan  1 00:00", False),
    ("<13>Nov 24 18:22:48 1986 h m", "1986-11-24 18:22:48", "h m", True),
    ("<13>Nov 24 18:22:48 10.0.0.1 m", "2023-11-24 18:22:48", "10.0.0.1 m", True),
    ("<13>Dec 31 23:59:59 h m", "2023-12-31 23:59:59", "h m", True),
    ("<13>Jan  1 00:00:00 m", "2024-01-01 00:00:00", "m", True),
    ("<13>Foo  1 00:00:00 m", ARRIVAL, "Foo  1 00:00:00 m", False),
    ("<13>Jan 32 00:00:00 m", ARRIVAL, "Jan 32 00:00:00 m", False),
    ("<13>Nov 24 18:22:48 1986h m", "2023-11-24 18:22:48", "1986h m", True),
])
def test_header(spark, line, ts, msg, header):
    r = parse(spark, line)
    assert (str(r.ts), r.msg, r.has_header_ts) == (ts, msg, header)


def test_leap_day_goes_to_a_year_that_has_it(spark):
    assert parse(spark, "Feb 29 10:00:00 m", ref_ts="2025-03-01 00:00:00").ts == \
        dt.datetime(2024, 2, 29, 10)


@pytest.mark.parametrize("line,host,msg", [
    ("<13>Nov 24 08:09:08 h m", "h", "m"),
    ("Nov 24 08:09:08 h.example.com m n", "h.example.com", "m n"),
    ("word rest of it", "word", "rest of it"),
    ("<13>Nov 24 18:22:48 h", None, None),
    ("single", None, None),
])
def test_host_of_message(spark, line, host, msg):
    r = parse(spark, line, trust_msg_host=True)
    assert (r and r.host, r and r.msg) == (host, msg)


def test_split_hosts_reports_dropped_lines(spark):
    lines = spark.createDataFrame([(1, "<13>Nov 24 18:22:48 h"), (2, "<13>Nov 24 18:22:48 h m")],
                                  "seq bigint, line string")
    usable, dropped = split_hosts(lines)
    assert [r.seq for r in usable.collect()] == [2]
    assert [tuple(r) for r in dropped.collect()] == [(1, "<13>Nov 24 18:22:48 h")]


def test_hosts_and_defaults(spark):
    hosts = spark.createDataFrame([("10.0.0.1", "a.example.com")], "addr string, name string")
    assert parse(spark, "x", peer="10.0.0.1", hosts=hosts, strip_domain=True).host == "a"
    assert parse(spark, "x", peer="10.0.0.2", hosts=hosts).host == "10.0.0.2"
    assert parse(spark, "x").host == "local"
    assert parse(spark, "x", peer="").host == "local"


def test_controls(spark):
    df = spark.createDataFrame([("a\tb\nc\x7f\x85é",), ("À",)], "s string")
    got = [r[0] for r in df.select(text.escape_controls(F.col("s"))).collect()]
    assert got == ["a^Ib c\\177\\205é", "À"]
    strict = [bytes(r[0]) for r in df.select(
        text.escape_controls(F.col("s"), True).cast("binary")).collect()]
    assert strict[1] == b"\xc3\\200"


def test_mask_is_per_byte(spark):
    df = spark.createDataFrame([("é\t\nx",)], "s string")
    assert df.select(text.mask_nonprint(F.col("s"))).first()[0] == "XXX\nx"


def test_program(spark):
    assert parse(spark, "<13>su2[1]: x").prog == "su2"
    assert parse(spark, "<13> x").prog == ""


def test_clocks_ahead_stay_in_their_year(spark):
    rows_in = [(0, "2024-06-01 00:00:00", "Jun  1 00:00:01 x"), (1, "2024-06-01 00:00:00", "Jun  2 00:00:01 x"),
               (2, "2023-12-31 23:59:59", "Jan  1 00:00:01 x"), (3, "2024-01-01 00:00:00", "Dec 31 23:59:59 x")]
    df = spark.createDataFrame(rows_in, "seq long, arrival_ts string, line string") \
        .withColumn("arrival_ts", F.col("arrival_ts").cast("timestamp_ntz"))
    got = {r.seq: str(r.ts) for r in parse_lines(df, default_host="l").collect()}
    assert got == {0: "2024-06-01 00:00:01", 1: "2023-06-02 00:00:01", 2: "2024-01-01 00:00:01",
                   3: "2023-12-31 23:59:59"}


def test_long_hosts_and_programs_are_whole(spark):
    df = spark.createDataFrame([(0, "h" * 300 + " " + "p" * 400 + ": x")], "seq long, line string")
    got = parse_lines(df, default_host="l", trust_msg_host=True).first()
    assert got.host == "h" * 300 and got.prog == "p" * 400
