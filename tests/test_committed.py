"""Committed logs and save buffers through lost tasks, stopped batches and crashes."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logweave.sinks import committed as C
from logweave.sinks import deliver

SCHEMA = "seq bigint, ts timestamp_ntz, msg string"


def frame(spark, first, last):
    return spark.range(first, last, 1, 4).selectExpr(
        "id AS seq", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "concat('m', id) AS msg")


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_batches_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert C.read_committed(spark, path, SCHEMA).collect() == []
    C.write_committed(frame(spark, 0, 10), path, 0)
    C.write_committed(frame(spark, 0, 10), path, 0)
    C.write_committed(frame(spark, 10, 15), path, 1)
    C.write_committed(frame(spark, 0, 0), path, 2)
    C.write_committed(frame(spark, 15, 17), path)
    assert seqs(C.read_committed(spark, path, SCHEMA)) == list(range(17))
    assert rows(C.read_committed(spark, path, SCHEMA).filter("seq = 3")) == rows(frame(spark, 3, 4))
    assert C.sweep(spark, path) == 0


def test_a_task_that_dies_after_writing(spark, tmp_path):
    path = str(tmp_path / "log")
    C.write_committed(frame(spark, 0, 4), path, 0)
    dies = F.udf(lambda x: x if x != 9 else os._exit(1), "long")
    with pytest.raises(Exception):
        C.write_committed(frame(spark, 4, 12).withColumn("seq", dies("seq")).select("seq", "ts", "msg"), path, 1)
    assert seqs(C.read_committed(spark, path, SCHEMA)) == list(range(4))
    C.write_committed(frame(spark, 4, 12), path, 1)
    assert seqs(C.read_committed(spark, path, SCHEMA)) == list(range(12))
    C.sweep(spark, path)
    assert C.sweep(spark, path) == 0 and seqs(C.read_committed(spark, path, SCHEMA)) == list(range(12))


def test_stream_stopped_between_write_and_commit(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(3):
        frame(spark, 10 * i, 10 * i + 10).write.parquet(str(tmp_path / "in" / f"{i}"))
    spark.dataSource.register(C.CommittedLog)

    def run():
        live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in" / "*"))
        (live.writeStream.format("committed_log").option("path", path).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start().awaitTermination())
    os.makedirs(path)
    (tmp_path / "log" / "commits").write_text("in the way")  # files are written, the manifest cannot be
    with pytest.raises(Exception):
        run()
    os.remove(path + "/commits")
    run()
    run()
    assert seqs(C.read_committed(spark, path, SCHEMA)) == list(range(30))


def test_buffer_in_order_through_crashes(spark, tmp_path):
    buffer = C.SaveBuffer(spark, str(tmp_path / "b"), SCHEMA)
    out = str(tmp_path / "out")
    assert buffer.replay("far", C.committed_sink(out)) == 0
    buffer.append(frame(spark, 0, 25), 0)
    buffer.append(frame(spark, 0, 25), 0)
    buffer.append(frame(spark, 25, 40), 3)
    handed, crash = [], {1: "before", 3: "after"}

    def sink(df, number):
        mode = crash.pop(number, None)
        if mode == "before":
            raise OSError("down")
        handed.append((number, [r.seq for r in df.collect()]))
        C.write_committed(df, out, number)
        if mode == "after":  # delivered, but not acknowledged
            raise OSError("killed")
    for _ in range(2):
        with pytest.raises(OSError):
            C.SaveBuffer(spark, str(tmp_path / "b"), SCHEMA).replay("far", sink, rows=10)
    assert buffer.waiting("far").count() == 10
    buffer.append(frame(spark, 40, 45), 4)
    assert C.SaveBuffer(spark, str(tmp_path / "b"), SCHEMA).replay("far", sink, rows=10) == 2
    assert [n for n, _ in handed] == [0, 1, 2, 3, 3, 4]
    assert handed[3] == handed[4] and sum((s for n, s in dict(handed).items()), []) == list(range(45))
    got = C.read_committed(spark, out, buffer.schema)
    assert seqs(got) == list(range(45)) and got.filter("position IS NULL").count() == 0
    assert buffer.waiting("far").count() == 0 and buffer.waiting("near").count() == 45


def test_as_a_registered_sink(spark, tmp_path):
    df = frame(spark, 0, 5).withColumn("sink", F.lit("kept"))
    deliver.register_sink("kept", C.committed_sink(str(tmp_path / "log")))
    try:
        for batch in (0, 0, 1):
            deliver.deliver(df, batch)
    finally:
        deliver._SINKS.clear()
    assert seqs(C.read_committed(spark, str(tmp_path / "log"), SCHEMA)) == sorted([*range(5)] * 2)


def test_many_unknown_sinks_are_counted(spark, tmp_path):
    df = spark.range(30).selectExpr("concat('s', id) AS sink", "id AS seq")
    errors = deliver.deliver(df, 0, str(tmp_path / "dead"))
    assert errors[deliver.NO_SINK].endswith(", and 10 more")


def test_a_key_over_the_life_of_a_table(spark, tmp_path):
    path, schema = str(tmp_path / "k"), "ts timestamp_ntz, host string, msg string, n int"

    def batch(*given):
        return spark.createDataFrame([(h, m, n) for h, m, n in given], "host string, msg string, n int").select(
            (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("n") % 2)).alias("ts"), "host", "msg", "n")
    keys = ["ts", "host", "msg"]
    C.write_keyed(batch(("a", "x", 0), (None, "x", 0), ("a", None, 1), ("a", "x", 0)), path, keys, 0)
    C.write_keyed(batch(("a", "x", 0), (None, "x", 2), ("a", "x", 1), ("b", "x", 0)), path, keys, 1)
    C.write_keyed(batch(("c", "x", 0)), path, keys, 1)  # runs again: what it wrote stays
    C.write_keyed(batch(), path, keys, 2)
    got = C.read_committed(spark, path, schema).select("host", "msg", "n")
    assert rows(got) == sorted([("a", "x", 0), (None, "x", 0), ("a", None, 1), ("a", "x", 1), ("b", "x", 0)], key=repr)
