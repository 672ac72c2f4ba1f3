"""Recorded datagrams: each once over restarts, numbered over recorders, damaged lines kept."""

import json
from base64 import b64encode

import pytest
from pyspark.sql import functions as F

from conftest import rows
from logweave.operators import parse
from logweave.sources import lines as src
from logweave.sources import recorded


def line(partition, offset, data, peer="10.0.0.1", time="2024-03-01T00:00:00.000005"):
    return json.dumps({"partition": partition, "offset": offset, "time": time, "peer": peer,
                       "data": b64encode(data).decode()})


class Run:
    """A stream that starts anew for every step and knows its checkpoint only."""

    def __init__(self, spark, path, cp):
        self.spark, self.path, self.cp, self.got = spark, path, cp, []

    def step(self):
        def take(df, _):
            self.got += df.select("seq", "peer", "line", "damaged").collect()
        (recorded.follow_datagrams(self.spark, self.path, partitions=4, split_bytes=300).writeStream.foreachBatch(take)
         .option("checkpointLocation", self.cp).trigger(availableNow=True).start().awaitTermination())
        return sorted(r.line for r in self.got)


def test_each_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = Run(spark, str(folder), str(tmp_path / "cp"))
    want = []
    for step in range(3):
        for recorder in range(3):
            with open(folder / f"r{recorder}.jsonl", "a") as f:
                for k in range(10):
                    text = f"<13>p: r{recorder} {step} {k}"
                    want.append(text)
                    f.write(line(recorder, step * 10 + k, text.encode()) + "\n")
        assert run.step() == sorted(want)
        # stopped in the middle of a line: it waits
        with open(folder / "r0.jsonl", "a") as f:
            f.write(line(3, step, b"cut")[:30])
        assert run.step() == sorted(want)
        with open(folder / "r0.jsonl", "a") as f:
            f.write(line(3, step, b"cut")[30:] + "\n")
        want.append("cut")
    assert run.step() == sorted(want)
    seqs = [r.seq for r in run.got]
    assert len(set(seqs)) == len(want) and not any(r.damaged for r in run.got)
    for recorder in range(3):
        mine = [r.line for r in sorted(run.got, key=lambda r: r.seq) if r.seq % 4 == recorder]
        assert mine == [f"<13>p: r{recorder} {s} {k}" for s in range(3) for k in range(10)]


def test_any_bytes_and_damaged_lines(spark):
    good = [(0, 0, b"a\nb\x00\xc3\xa9"), (1, 7, b""), (3, 2, b"x" * 200_000)]
    bad = ["", "nonsense", '{"partition": 1}', line(4, 0, b"far"), line(-1, 0, b"low"), line(0, -1, b"low"),
           line(0, 1 << 62, b"far"), '{"partition":1,"offset":2,"data":"%%%"}', '[1]']
    data = [(line(p, o, d),) for p, o, d in good] + [(b,) for b in bad] + [(None,)]
    got = recorded.read_datagrams(spark.createDataFrame(data, "line string"), partitions=4)
    assert rows(got.filter("NOT damaged").select("seq", "peer", F.col("line").cast("binary"))) == sorted(
        [(o * 4 + p, "10.0.0.1", bytearray(d)) for p, o, d in good], key=repr)
    assert sorted(r.line or "" for r in got.filter("damaged").collect()) == sorted([*bad, ""])
    assert got.filter("damaged AND (seq IS NOT NULL OR peer IS NOT NULL OR arrival_ts IS NULL)").count() == 0
    assert recorded.read_datagrams(spark.createDataFrame([], "line string")).count() == 0


def test_round_trip_and_parse(spark):
    df = spark.range(50).selectExpr(
        "CAST(id % 3 AS int) AS partition", "id AS offset", "TIMESTAMP_NTZ '2024-03-01 00:00:00.123456' AS time",
        "concat('10.0.0.', id) AS peer", "CAST(concat('<', id, '>prog: m', id) AS binary) AS data", "'x' AS line")
    back = recorded.read_datagrams(recorded.record_datagrams(df).withColumnRenamed("value", "line"))
    assert back.select("arrival_ts").distinct().first()[0].microsecond == 123456
    parsed = parse.parse_lines(back, default_host="log", network=True)
    assert rows(parsed.select("msg", "prog")) == sorted([(f"prog: m{i}", "prog") for i in range(50)], key=repr)
    assert parsed.select("seq").distinct().count() == 50
    # a frame of one topic with partitions: the same places
    kafka = df.select(F.col("data").alias("value"), "partition", "offset", "peer")
    assert {r.seq for r in src.from_stream(kafka, partitions=3).collect()} == {i * 3 + i % 3 for i in range(50)}
    with pytest.raises(Exception, match="partition"):
        src.from_stream(kafka, partitions=2).collect()
