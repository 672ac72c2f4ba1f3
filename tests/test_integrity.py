"""Hash chains: definition, tampering, streams."""

import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logweave.operators import integrity as I
from logweave.streaming.jobs import ChainStream

METHODS = ["md5", "sha1", "rmd160"]
LIB = {"md5": "md5", "sha1": "sha1", "rmd160": "ripemd160"}


def by_definition(method, a, b):
    """Index by index, as the digest is defined."""
    if not a or not b:
        return hashlib.new(LIB[method], a or b or b"\0").digest()
    s, n = min(len(a), len(b)), max(len(a), len(b))
    size = n // s * s + (s if n % s else 0)
    return hashlib.new(LIB[method], bytes(a[i % len(a)] ^ b[i % len(b)] for i in range(size))).digest()


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("size", [0, 1, 7, 19, 20, 21, 40, 119, 5000])
def test_digest(method, size):
    key, data = bytes(range(20)), bytes(i * 7 % 256 for i in range(size))
    assert I.keyed_digest(method, key, data) == by_definition(method, key, data)
    assert I.keyed_digest(method.upper(), data, key) == by_definition(method, data, key)


def test_unknown_method():
    with pytest.raises(ValueError):
        I.keyed_digest("crc32", b"k", b"d")


@pytest.fixture(scope="module")
def logs(spark):
    lines = spark.createDataFrame(
        [(f"log{i}", n, f"line {n} of {i}" if n % 5 else "") for i in range(6) for n in range(1, 20)],
        "log_id string, line_no bigint, line string")
    seeds = spark.createDataFrame([(f"log{i}", METHODS[i % 3], bytes([i]) * 20) for i in range(6)],
                                  "log_id string, method string, seed binary")
    keys = I.init_keys(seeds)
    made = I.protect(lines, keys).cache()
    return lines, I.last_keys(made, keys).cache(), made.select("log_id", "line_no", "mac")


def verdicts(df):
    return {r.log_id: (r.status, r.bad_line) for r in df.collect()}


def test_intact(logs):
    lines, keys, macs = logs
    assert set(verdicts(I.verify(lines, keys, macs)).values()) == {(0, None)}
    assert set(verdicts(I.verify(lines, keys)).values()) == {(0, None)}


def test_chain_by_hand(logs):
    lines, keys, macs = logs
    got = {r.log_id: bytes(r.last_key) for r in keys.collect()}
    for i in range(6):
        key = by_definition(METHODS[i % 3], b"", bytes([i]) * 20)
        for n in range(1, 20):
            text = (f"line {n} of {i}" if n % 5 else "").encode()
            key = by_definition(METHODS[i % 3], key, text)
        assert got[f"log{i}"] == key


def edit(lines, log, fn):
    mine = lines.filter(F.col("log_id") == log)
    return lines.filter(F.col("log_id") != log).unionByName(fn(mine))


@pytest.mark.parametrize("name,fn,bad", [
    ("byte", lambda d: d.withColumn("line", F.when(F.col("line_no") == 7, F.concat("line", F.lit("x")))
                                    .otherwise(F.col("line"))), 7),
    ("last line gone", lambda d: d.filter("line_no < 19"), None),
    ("middle gone", lambda d: d.filter("line_no <> 9")
        .withColumn("line_no", F.expr("line_no - int(line_no > 9)")), 9),
    ("swap", lambda d: d.withColumn("line_no", F.expr(
        "CASE line_no WHEN 11 THEN 12 WHEN 12 THEN 11 ELSE line_no END")), 11),
    ("added", lambda d: d.unionByName(d.filter("line_no = 19").withColumn("line_no", F.lit(20).cast("bigint"))), 20),
])
def test_tampering(logs, name, fn, bad):
    lines, keys, macs = logs
    for log in ("log0", "log1", "log2"):
        changed = edit(lines, log, fn)
        got = verdicts(I.verify(changed, keys, macs))
        assert got.pop(log) == (1, bad)
        assert set(got.values()) == {(0, None)}
        assert verdicts(I.verify(changed, keys))[log] == (1, None)
    if bad:
        found = I.first_corrupt_line(edit(lines, "log4", fn), keys, macs).collect()
        assert [(r.log_id, r.bad_line) for r in found] == [("log4", bad)]


def test_broken_keys(logs):
    lines, keys, macs = logs
    short = keys.withColumn("last_key", F.when(F.col("log_id") == "log0", F.lit(b"abc"))
                            .otherwise(F.col("last_key"))).filter("log_id <> 'log1'")
    got = verdicts(I.verify(lines, short, macs))
    assert got["log0"] == (1, None) and got["log1"] == (1, None) and got["log2"] == (0, None)


def test_small_batches_carry_the_key(spark, logs):
    lines, keys, macs = logs
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert set(verdicts(I.verify(lines, keys, macs)).values()) == {(0, None)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_stream_of_batches(spark, logs, tmp_path):
    lines, keys, macs = logs
    first = keys.withColumn("last_key", F.col("key0"))
    got = []
    chain = ChainStream(spark, str(tmp_path), first, lambda df, _: got.extend(
        (r.log_id, r.line_no, bytes(r.mac)) for r in df.collect()))
    chain.process(lines.filter("line_no <= 8"), 0)
    chain.process(lines.filter("line_no > 8 AND log_id <> 'log3'"), 1)
    chain.process(lines.filter("line_no > 8 AND log_id = 'log3'"), 2)
    assert sorted(got) == sorted((r.log_id, r.line_no, bytes(r.mac)) for r in macs.collect())
    end = {r.log_id: bytes(r.last_key) for r in chain.keys.at(2).collect()}
    assert end == {r.log_id: bytes(r.last_key) for r in keys.collect()}


def test_segments_split_a_log(spark, logs):
    lines, _, _ = logs
    cut = I.segments(lines, 7)
    seeds = cut.select("log_id").distinct().withColumn("method", F.lit("sha1")) \
        .withColumn("seed", F.encode("log_id", "UTF-8"))
    keys = I.init_keys(seeds)
    made = I.protect(cut, keys).cache()
    last = I.last_keys(made, keys)
    macs = made.select("log_id", "line_no", "mac")
    assert made.groupBy("log_id").count().agg(F.max("count")).first()[0] == 7
    got = verdicts(I.verify(cut.filter("log_id <> 'log2|1'"), last, macs))
    assert got.pop("log2|1") == (1, None) and set(got.values()) == {(0, None)}


def test_null_lines_count_as_empty(spark):
    from logweave.operators import integrity
    seeds = spark.createDataFrame([("a", "sha1", bytearray(b"seed"))], "log_id string, method string, seed binary")
    keys = integrity.init_keys(seeds)
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "y")], "log_id string, line_no bigint, line string")
    made = integrity.protect(lines, keys)
    empty = integrity.protect(lines.fillna(""), keys)
    assert rows(made.select("line_no", "mac")) == rows(empty.select("line_no", "mac"))
    known = integrity.last_keys(made, keys)
    macs = made.select("log_id", "line_no", "mac")
    assert integrity.verify(lines, known, macs).first().status == integrity.verify(lines.fillna(""), known, macs).first().status
    gone = macs.withColumn("mac", F.when(F.col("line_no") != 2, F.col("mac")))
    assert integrity.verify(lines, known, gone).first().bad_line == 2


@pytest.mark.parametrize("every", [1, 4, 7, 100])
def test_parts_of_a_chain_give_the_same_verdicts(spark, logs, every):
    lines, keys, macs = logs
    made = I.protect(lines, keys)
    marks = I.checkpoint_keys(made, every).cache()
    cases = {
        "intact": lines, "changed": edit(lines, "log1", lambda d: d.withColumn("line", F.when(F.col("line_no") == 9, "no").otherwise(F.col("line")))),
        "end cut": lines.filter("log_id <> 'log2' OR line_no < 18"), "part cut": lines.filter("log_id <> 'log3' OR line_no NOT BETWEEN 5 AND 8"),
        "one cut": lines.filter("log_id <> 'log0' OR line_no <> 8"), "first cut": lines.filter("log_id <> 'log4' OR line_no > 7"),
        "all cut": lines.filter("log_id <> 'log5'"), "more": lines.union(spark.createDataFrame([("log1", 20, "x"), ("log2", 400, "y"), ("none", 1, "z")], lines.schema)),
    }
    joined = None
    for case, df in cases.items():  # all cases in one job, as logs of their own
        one = df.withColumn("log_id", F.concat("log_id", F.lit(f"/{case}")))
        joined = one if joined is None else joined.union(one)
    names = spark.createDataFrame([(c,) for c in cases], "case string")

    def spread(df):
        return df.crossJoin(names).withColumn("log_id", F.concat("log_id", F.lit("/"), "case")).drop("case")
    broken = spread(keys).withColumn("key0", F.when(F.col("log_id") != "log5/intact", F.col("key0")))
    for digests in (spread(macs), None):
        want = sorted(map(tuple, I.verify(joined, broken, digests).collect()))
        got = sorted(map(tuple, I.verify_parts(joined, broken, spread(marks), every, digests).collect()))
        assert got == want
