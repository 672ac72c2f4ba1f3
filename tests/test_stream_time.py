"""Clock of a stream: wrong times, idle streams, changed rules."""

import time

import pytest
from pyspark.sql import functions as F

from logweave.operators import collapse, parse, route, rules
from logweave.streaming.jobs import LogStream, _version

RULES = ("rule_id string, selector string, program string, message_re string, host_re string, date_re string, "
         "time_re string, inverse boolean, dest string, sink string")


def table(spark, given):
    return spark.createDataFrame([(r, s, None, m, h, None, None, False, "d", "s") for r, s, m, h in given], RULES)


@pytest.fixture
def make(spark, tmp_path):
    given = [("a", "*.*;mark.*", None, None)]
    seen = {}

    def build(**options):
        stream = LogStream(spark, lambda s: table(s, given), str(tmp_path / "state"), dict(default_host="l", ref_ts="2024-06-01 12:00:00"),
                           on_written=lambda d, i: seen.update({i: sorted((str(r["at"]), str(r.ts), r.msg, r.n) for r in d.collect())}),
                           late_dir=str(tmp_path / "late"), **options)
        return stream, seen, given
    return build


def batch(spark, *lines, arrival="2024-06-01 10:00:00", beat=None):
    df = spark.createDataFrame([(i, f"<13>{t}", arrival) for i, t in enumerate(lines)], "seq bigint, line string, a string") \
        .withColumn("arrival_ts", F.col("a").cast("timestamp_ntz")).drop("a")
    beats = spark.createDataFrame([(beat,)] if beat else [], "b string").select(F.col("b").cast("timestamp").alias("_beat"))
    return df.unionByName(beats, allowMissingColumns=True)


def test_a_line_of_2099_changes_no_other(spark, make):
    stream, seen, _ = make()
    stream.process(batch(spark, "Jun  1 10:00:00 one", "Jun  1 10:00:01 2099 wild", "Jun  1 10:00:01 two", "Jun  1 10:00:03 three"), 0)
    assert ("2024-06-01 10:00:03", "2099-06-01 10:00:01", "wild", 0) in seen[0]
    stream.process(batch(spark, "Jun  1 10:00:04 four", "Jun  1 10:00:05 2099 wild", "Jun  1 10:00:06 five"), 1)
    got = [x for i in (0, 1) for x in seen[i] if x[2] != "wild"]
    assert [(a[11:], t[11:], m) for a, t, m, _ in got] == [
        ("10:00:00", "10:00:00", "one"), ("10:00:01", "10:00:01", "two"), ("10:00:03", "10:00:03", "three"),
        ("10:00:04", "10:00:04", "four"), ("10:00:06", "10:00:06", "five")]
    late = stream.late_lines().collect()
    assert sorted((r.msg, str(r.ts)) for r in late) == [("wild", "2099-06-01 10:00:01"), ("wild", "2099-06-01 10:00:05")]
    assert stream.diagnostics(1).first().msg == "syslogd: 1 lines came late"


def test_only_wild_lines(spark, make):
    stream, seen, _ = make()
    stream.process(batch(spark, "Jun  1 10:00:01 2099 wild"), 0)
    assert seen[0] == [("2024-06-01 10:00:00", "2099-06-01 10:00:01", "wild", 0)]
    stream.process(batch(spark, "Jun  1 10:00:01 fine"), 1)
    assert seen[1] == [("2024-06-01 10:00:01", "2024-06-01 10:00:01", "fine", 0)]


def test_late_lines_keep_their_time(spark, make):
    stream, seen, _ = make(lateness=10)
    stream.process(batch(spark, "Jun  1 10:00:00 one", "Jun  1 10:00:40 two"), 0)
    stream.process(batch(spark, "Jun  1 10:00:35 a little late", "Jun  1 10:00:05 very late", "Jun  1 10:00:50 three"), 1)
    assert seen[1] == [("2024-06-01 10:00:40", "2024-06-01 10:00:05", "very late", 0),
                       ("2024-06-01 10:00:40", "2024-06-01 10:00:35", "a little late", 0),
                       ("2024-06-01 10:00:50", "2024-06-01 10:00:50", "three", 0)]
    assert [(r.msg, str(r.ts), r.rule_id) for r in stream.late_lines().collect()] == [("very late", "2024-06-01 10:00:05", "a")]
    stream.process(batch(spark, "Jun  1 10:00:05 very late", "Jun  1 10:00:50 three"), 1)  # runs again
    assert stream.late_lines().count() == 1


def test_idle_stream_writes_what_is_due(spark, make):
    lines = ["Jun  1 10:00:00 same", "Jun  1 10:00:10 same", "Jun  1 10:00:20 same"]
    stream, seen, _ = make(mark_interval=600, idle_delay=0)
    stream.process(batch(spark, *lines, beat="2024-06-01 10:00:25"), 0)
    assert seen[0] == [("2024-06-01 10:00:00", "2024-06-01 10:00:00", "same", 0)]
    stream.process(batch(spark, beat="2024-06-01 10:00:30"), 1)
    assert seen[1] == []
    stream.process(batch(spark, beat="2024-06-01 10:00:36"), 2)
    assert seen[2] == [("2024-06-01 10:00:30", "2024-06-01 10:00:20", "last message repeated 2 times", 2)]
    stream.process(batch(spark, beat="2024-06-01 10:11:00"), 3)
    assert seen[3] == [("2024-06-01 10:10:00", "2024-06-01 10:10:00", "-- MARK --", None)]
    stream.process(batch(spark, "Jun  1 10:11:10 other", beat="2024-06-01 10:11:12"), 4)
    assert seen[4] == [("2024-06-01 10:11:10", "2024-06-01 10:11:10", "other", 0)]
    assert stream.diagnostics(4).count() == 0
    raw = batch(spark, *lines, "Jun  1 10:11:10 other").drop("_beat")
    routed = route.route(parse.parse_lines(raw, default_host="l", ref_ts="2024-06-01 12:00:00"), rules.compile_masks(table(spark, [("a", "*.*", None, None)])))
    want = sorted((str(r["at"]), str(r.ts), r.msg, r.n) for r in collapse.collapse_emit(routed).collect())
    assert sorted(x for i in seen for x in seen[i] if "MARK" not in x[2]) == want


def test_delay_of_idle_time(spark, make):
    stream, seen, _ = make(idle_delay=60)
    stream.process(batch(spark, "Jun  1 10:00:00 same", "Jun  1 10:00:01 same", beat="2024-06-01 10:00:01"), 0)
    stream.process(batch(spark, beat="2024-06-01 10:01:00"), 1)
    assert seen[1] == []
    # a line on its way comes within the delay and is not late
    stream.process(batch(spark, "Jun  1 10:00:20 same", beat="2024-06-01 10:01:05"), 2)
    stream.process(batch(spark, beat="2024-06-01 10:03:00"), 3)
    assert seen[3] == [("2024-06-01 10:00:30", "2024-06-01 10:00:20", "last message repeated 2 times", 2)]
    assert stream.diagnostics(2).count() == 0


def test_beats_run_batches_without_lines(spark, make, tmp_path):
    stream, seen, _ = make(heartbeat=True, mark_interval=2, idle_delay=0)
    batch(spark, "Jun  1 10:00:00 one").drop("_beat").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("seq bigint, line string, arrival_ts timestamp_ntz").parquet(str(tmp_path / "in"))
    query = stream.start(live, str(tmp_path / "cp"), processingTime="1 second")
    end = time.time() + 120
    while time.time() < end and query.isActive and not any("MARK" in x[2] for i in seen for x in seen[i]):
        time.sleep(0.5)
    query.stop()
    assert any("MARK" in x[2] for i in seen for x in seen[i]), query.exception()


def test_version_of_rules(spark):
    same = [("a", "*.*", "x", None), ("b", "*.*", None, None)]
    assert _version(table(spark, same)) == _version(table(spark, same[::-1]))
    others = [[("a", "*.*", None, "x"), same[1]], [*same, same[0], same[0]], [same[0]], [*same, same[1], same[1]], []]
    assert len({_version(table(spark, x)) for x in [same, *others]}) == 6
