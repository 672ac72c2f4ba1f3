"""Log tables laid out for lookups: the same rows, few of them read."""

import random

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from conftest import rows
from logweave.sinks import deliver, indexed, render

#: With a digit before it, a host between others that is none of them.
_ABSENT = "8" * 63


def read_rows(df):
    """How many rows the scan below a lookup gave after statistics ruled out row groups and pages."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def log(spark, n=120_000):
    """Two days of 400 hosts, one with a third of all lines, messages of 1,000 programs."""
    return spark.range(n).select(
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("id"), F.lit(172800))).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("h"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400)))).alias("host"),
        F.concat(F.lit("p"), F.lpad(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)).cast("string"), 3, "0"),
                 F.lit(": line "), F.sha2(F.col("id").cast("string"), 256)).alias("msg"),
        (F.col("id") % 24).cast("int").alias("fac"), (F.col("id") % 8).cast("int").alias("sev"), F.col("id").alias("seq"))


@pytest.mark.parametrize("axes", [indexed.AXES, ("message", "host")])
def test_lookups_read_little(spark, tmp_path, axes):
    lines = log(spark)
    plain, laid = str(tmp_path / "plain"), str(tmp_path / "laid")
    deliver.write_log_table(lines, plain)
    indexed.write_indexed_log_table(lines, laid, rows_per_file=2_000, page_rows=500, axes=axes)
    total = lines.count()
    asks = {"host": dict(host="h17"), "prefix": dict(prefix="p123"), "both": dict(host="hot", prefix="p5"),
            "day": dict(date="2024-01-01", time_from="06:00:00", time_to="07:00:00", host="h3")}
    share = {}
    for name, ask in asks.items():
        a = render.lookup(spark.read.parquet(plain), **ask)
        b = render.lookup(spark.read.parquet(laid), **ask)
        found = rows(a.withColumn("date", F.col("date").cast("string")))
        assert found and found == rows(b.withColumn("date", F.col("date").cast("string")).select(*a.columns))
        # what the plain table reads of its rows, and what this one does
        share[name] = (read_rows(render.lookup(spark.read.parquet(plain), **ask)) / total,
                       read_rows(render.lookup(spark.read.parquet(laid), **ask)) / total)
    print(axes, share)
    # 60 files a date, one row group each: with k axes a box is 60 ** (-1 / k) wide, a lookup may cut two
    for name in ("host", "prefix"):
        assert share[name][1] < 2 * 60 ** (-1 / len(axes)) < share[name][0], share
    assert share["both"][1] < 0.2 and share["day"][1] < 0.2, share
    # no lookup needs the layout: all rows are there
    assert spark.read.parquet(laid).count() == total


def test_host_filters(spark, tmp_path):
    """Hosts that differ row by row have a Bloom filter, which rules out a host that no row has."""
    lines = log(spark, 20_000).withColumn("host", F.sha2(F.col("seq").cast("string"), 256))
    indexed.write_indexed_log_table(lines, str(tmp_path), rows_per_file=20_000)
    table = spark.read.parquet(str(tmp_path))
    some = table.select("host").first()[0]
    absent = "0" + _ABSENT
    assert table.select(F.min("host")).first()[0] < absent < table.select(F.max("host")).first()[0]
    assert read_rows(render.lookup(table, host=absent)) == 0
    unfiltered = spark.read.option("parquet.filter.bloom.enabled", "false").parquet(str(tmp_path))
    assert read_rows(render.lookup(unfiltered, host=absent)) > 0
    assert render.lookup(table, host=some).count() == 1


def test_hot_host_is_spread(spark, tmp_path):
    lines = log(spark, 40_000).withColumn("host", F.lit("one")).withColumn("msg", F.lit("same"))
    lines = lines.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    indexed.write_indexed_log_table(lines, str(tmp_path), rows_per_file=5_000)
    sizes = [f.count_rows() for f in ds.dataset(str(tmp_path), partitioning="hive").get_fragments()]
    assert sum(sizes) == 40_000 and len(sizes) >= 6 and max(sizes) < 12_000


def test_odd_rows(spark, tmp_path):
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    data = [(None, "a"), ("h", None), (None, None), ("h", ""), ("h", "x" * 300_000), ("h", "é" * 100), ("h", "a"), ("h", "a")]
    lines = spark.createDataFrame(data, "host string, msg string").select(
        ts.alias("ts"), "host", "msg", F.lit(1).alias("fac"), F.lit(2).alias("sev"), F.lit("u").alias("_z"),
        F.lit("t").alias("_tie"))
    indexed.write_indexed_log_table(lines, str(tmp_path / "t"), batch_id=3)
    indexed.write_indexed_log_table(lines, str(tmp_path / "t"), batch_id=3)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert rows(back.select("host", "message")) == sorted(data, key=repr)
    assert rows(render.lookup(back, host="h", prefix="xx").select(F.length("message"))) == [(300_000,)]
    assert back.columns[:5] == ["facility", "priority", "time", "host", "message"]
    indexed.write_indexed_log_table(lines.limit(0), str(tmp_path / "none"), batch_id=0)


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_and_curve(spark, seed):
    r = random.Random(seed)
    bounds = sorted({r.choice("abcdefgh") + r.choice("abé") for _ in range(9)}, key=lambda v: v.encode())
    values = [None, "", "z", *bounds, *(r.choice("abcdefgh") for _ in range(9))]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = [0 if v is None else sum(b.encode() <= v.encode() for b in bounds) for v in values]
    assert [x.r for x in df.select(indexed.rank(F.col("v"), bounds).alias("r")).collect()] == want
    abc = spark.createDataFrame([(5, 0, 31)], "a int, b int, c int")
    place = abc.select(indexed.interleave([F.col("a"), F.col("b"), F.col("c")]).alias("z")).first().z
    bits = [[v >> k & 1 for v in (5, 0, 31)] for k in range(5)]
    assert place == sum(b << (3 * k + a) for k, row in enumerate(bits) for a, b in enumerate(row))
