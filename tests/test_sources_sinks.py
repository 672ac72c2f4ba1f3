"""Sources, sinks, reassembly, symbols, notification and the whole stream."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logweave.operators import collapse, diagnostics, filters, notify, parse, reassemble, route, rules, symbols
from logweave.operators.joins import fits_broadcast, lookup_join
from logweave.operators.ordering import number_rows
from logweave.plans import fixtures as X
from logweave.plans.queries import REGISTRY
from logweave.sinks import deliver, render
from logweave.sources import lines as src
from logweave.streaming.jobs import LineStream, LogStream


def test_read_files_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("<12>one\ntwo\n")
    (tmp_path / "in" / "b.log").write_text("three\n")
    kw = dict(program="app", arrival_ts="2024-01-01 00:00:00")
    raw = src.read_log_files(spark, str(tmp_path / "in"), **kw)
    got = parse.parse_lines(raw, default_host="local").select("pri", "msg", "prog")
    want = [(12, "app:one", "app"), (2, "app:three", "app"), (2, "app:two", "app")]
    assert rows(got) == want
    live = src.read_log_files(spark, str(tmp_path / "in"), stream=True, **kw)
    q = (parse.parse_lines(live, default_host="local").select("pri", "msg", "prog")
         .writeStream.format("memory").queryName("files").option(
             "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.table("files")) == want
    named = src.read_log_files(spark, str(tmp_path / "in")).select("line").collect()
    assert all("/in/" in r.line for r in named)


def test_custom_time(spark):
    df = spark.createDataFrame([("app", 1, "[2024/01/02-03:04:05] hi"), ("app", 2, "no time here, none")],
                               "source string, seq bigint, line string")
    df = df.withColumn("arrival_ts", F.lit("2024-05-01 00:00:00").cast("timestamp_ntz"))
    got = parse.parse_lines(src.file_lines(df, "yyyy/MM/dd-HH:mm:ss", 1), default_host="l")
    assert [(str(r.ts), r.msg) for r in got.orderBy("seq").collect()] == [
        ("2024-01-02 03:04:05", "app:[] hi"), ("2024-05-01 00:00:00", "app:no time here, none")]


def test_kernel_styles(spark):
    df = spark.createDataFrame([(1, "<3>a"), (2, "b"), (3, "<13>c"), (4, "<2048>d")],
                               "seq bigint, line string")

    def got(style):
        made = parse.parse_lines(src.kernel_lines(df, style, "/bsd"), default_host="l")
        return [(r.pri, r.msg) for r in made.orderBy("seq").collect()]
    assert got("linux") == [(3, "kernel: a"), (4, "kernel: b"), (4, "kernel: <13>c"), (4, "kernel: <2048>d")]
    assert got("bsd") == [(3, "/bsd: a"), (2, "/bsd: b"), (13, "/bsd: c"), (2, "/bsd: d")]


def test_registered_source(spark):
    src.register_source("one", lambda s: s.createDataFrame([("x",)], "line string"))
    assert src.open_source(spark, "one").first().line == "x"


def cut(rnd, text):
    at = sorted(rnd.sample(range(len(text) + 1), min(len(text), rnd.randint(0, 12))))
    return [text[a:b] for a, b in zip([0] + at, at + [len(text)])]


@pytest.fixture(scope="module")
def chunked(spark):
    rnd = random.Random(3)
    texts = {f"c{i}": "".join(rnd.choice(["a", "é", "\n", "\r\n", "long piece "])
                              for _ in range(rnd.randint(1, 60))) for i in range(20)}
    data = [(c, n, p) for c, t in texts.items() for n, p in enumerate(cut(rnd, t))]
    want = sorted((c, n, x) for c, t in texts.items()
                  for n, x in enumerate(p.removesuffix("\r") for p in t.split("\n")) if x)
    return spark.createDataFrame(data, "conn_id string, seq bigint, chunk string"), want


@pytest.mark.parametrize("block", [10_000, 3])
def test_reassembly_any_cuts(chunked, block):
    df, want = chunked
    assert sorted(map(tuple, reassemble.reassemble_lines(df, block=block).collect())) == want


def test_reassembly_stream(spark, chunked, tmp_path):
    df, want = chunked
    got = []
    stream = LineStream(spark, str(tmp_path), lambda d, _: got.extend(map(tuple, d.collect())), block=2)
    for i, part in enumerate(("seq < 2", "seq BETWEEN 2 AND 5", "seq > 5")):
        stream.process(df.filter(part), i)
    got += [tuple(r) for r in stream.close(2).collect()]
    assert sorted(got) == want


def test_symbols(spark):
    table = spark.createDataFrame([("C0100000", "start", "core"), ("c0100004", "go", "net")],
                                  "addr string, name string, module string")
    df = spark.createDataFrame([
        (1, "oops at [<c0100000>] and [<deadbeef>] [<c0100004>]"), (2, "plain"),
        (3, "[<c0100004>][<C0100000>] end"), (4, "[<zz>] none")], "seq bigint, line string")
    want = [(1, "oops at  [<C0100000> core.start ] and [<deadbeef>] [<c0100004>]"), (2, "plain"),
            (3, " [<c0100004> net.go ] [<C0100000> core.start ] end"), (4, "[<zz>] none")]
    for limit in (10**6, 0):
        assert rows(symbols.translate_symbols(df, table, max_rows=limit)) == want


def test_notify(spark):
    sessions = spark.createDataFrame([("root", "tty1"), ("root", "ftp9"), ("eric", "tty2"),
                                      ("ann", "uucp1"), ("ann", "tty3")], "user string, terminal string")
    alerts = spark.createDataFrame([(1, "root,eric,root"), (2, "*"), (3, "nobody, ann")],
                                   "id int, users string")
    want = [(1, "tty1"), (1, "tty2"), (2, "tty1"), (2, "tty2"), (2, "tty3"), (3, "tty3")]
    for limit in (10**6, 0):
        got = notify.notify_fanout(alerts, sessions, max_rows=limit).select("id", "terminal")
        assert rows(got) == want
    assert rows(notify.notify_fanout(alerts, sessions, max_users=1).filter("id = 1")
                .select("terminal")) == [("tty1",)]


def test_notify_many_sessions(spark):
    """Sessions beyond the bound: alerts are broadcast, and no task gets all sessions for everyone."""
    sessions = spark.range(300).selectExpr("concat('u', id % 100) AS user", "concat('tty', id) AS terminal")
    alerts = spark.createDataFrame([(1, "*"), (2, "u1,u2,u1"), (3, "u1 *"), (4, "*"), (5, None), (6, "")],
                                   "id int, users string")
    want = rows(notify.notify_fanout(alerts, sessions))
    assert len(want) == 2 * 300 + 6 + 3
    for limit in (0, 2, 10, 599):
        assert rows(notify.notify_fanout(alerts, sessions, max_rows=limit)) == want
    plan = notify.notify_fanout(alerts, sessions, max_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    asked = notify.addressees(alerts).groupBy("users").count()
    assert rows(asked) == [("*", 2), ("u1", 2), ("u2", 1)]
    told = notify.notify_fanout(asked, sessions).groupBy("terminal").agg(F.sum("count"))
    assert rows(told) == rows(notify.notify_fanout(alerts, sessions).groupBy("terminal").count())


def test_notify_query_fans_out_names_once(spark, tmp_path):
    """A row per terminal leaves the join, however many alerts go to everyone."""
    spark.range(20_000).selectExpr("id AS event_id", "id AS user_id", "'error' AS event_type", "100D AS value",
                                   "TIMESTAMP '2024-01-01 00:00:00' AS ts", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5_000).selectExpr("id AS c_custkey", "concat('c', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    df = REGISTRY["notify_fanout"](spark, str(tmp_path))
    got = df.agg(F.count("*"), F.min("n"), F.max("n"), F.max("seq_sum")).first()
    assert tuple(got) == (3_000, 20_000, 20_000, 20_000 * 19_999 // 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("HashAggregate(keys=[users")  # the aggregate is below the join


def test_lookup_join_paths(spark):
    big = spark.range(100).withColumn("k", F.col("id") % 3)
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    assert fits_broadcast(dim) and not fits_broadcast(dim, max_rows=1)
    assert not fits_broadcast(dim, max_bytes=5)
    for how in ("inner", "left"):
        assert rows(lookup_join(big, dim, ["k"], how).select("id", "v")) == \
            rows(lookup_join(big, dim, ["k"], how, max_rows=1, salts=3).select("id", "v"))


@pytest.mark.parametrize("hot,block", [(10**6, 10**6), (4, 3)])
def test_number_rows(spark, sf, hot, block):
    df = X.records(spark, sf).select("seq", "ts")
    got = [r.row_no for r in number_rows(df, hot_rows=hot, block=block).orderBy("ts", "seq").collect()]
    assert got == list(range(1, len(got) + 1))


def test_write_and_look_up(spark, sf, tmp_path):
    routed = route.route(X.records(spark, sf), X.compiled(spark)).filter("rule_id IN ('whole', 'groups')")
    deliver.write_files(routed, str(tmp_path / "files"), ordered=True)
    text = spark.read.text(str(tmp_path / "files"))
    assert rows(text.select("dest", "value")) == rows(render.render_file_lines(routed).select("dest", "value"))
    deliver.write_log_table(routed, str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    found = render.lookup(table, date="2024-01-10", host="h1")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(host,h1)" in plan
    assert rows(found.select("message")) == rows(
        routed.filter("date(ts) = '2024-01-10' AND host = 'h1'").select("msg"))


def test_delivery_survives_a_bad_sink(spark, tmp_path):
    df = spark.createDataFrame([("good", "a", 1), ("bad", "b", 2), ("bad", "c", 3)],
                               "sink string, msg string, seq bigint")
    got, broken = [], [True]

    def bad(frame, batch_id):
        if broken[0]:
            raise OSError("down")
        got.extend(r.msg for r in frame.collect())
    deliver.register_sink("bad", bad)
    deliver.register_sink("good", lambda frame, _: got.extend(r.msg for r in frame.collect()))
    try:
        letters = str(tmp_path / "dead")
        assert list(deliver.deliver(df, 5, letters)) == ["bad"] and got == ["a"]
        lost = deliver.undelivered(spark, letters)
        assert lost.count() == 2
        broken[0] = False
        assert deliver.replay(lost, "bad") == 2 and sorted(got) == ["a", "b", "c"]
    finally:
        deliver._SINKS.clear()


def test_forward_and_notice(spark, sf, tmp_path):
    routed = route.route(X.records(spark, sf), X.compiled(spark)).filter("rule_id = 'whole'")
    deliver.write_forward(routed, "text", path=str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out"))) == rows(
        render.render_forward(routed).select("value"))
    got = diagnostics.notice(spark, "restart", "2024-01-01 00:00:00").first()
    assert (got.pri, got.msg, got.fac, got.sev) == (46, "syslogd: restart", 5, 6)


def test_actions_in_order(spark):
    df = spark.createDataFrame([("r", [("file", "/var/log/a"), ("table", "db")])],
                               "rule_id string, actions array<struct<sink:string,dest:string>>")
    assert rows(deliver.explode_actions(df).select("pos", "sink", "dest")) == [
        (0, "file", "/var/log/a"), (1, "table", "db")]


def test_named_filter(spark):
    deliver.register_filter("short", lambda c: F.length(c) < 3)
    df = spark.createDataFrame([("ab",), ("abc",)], "msg string")
    assert rows(deliver.named_filter(df, "short")) == [("ab",)]


def stream_events(spark, sf):
    lines = X.raw_lines(spark, sf)
    return lines.withColumn("line", F.regexp_replace("line", r"\[[0-9]+\]: k .*", "")) \
        .withColumn("line", F.regexp_replace("line", r" h[0-9]+\.", " h."))


def test_whole_stream_equals_batch(spark, sf, tmp_path):
    options = dict(default_host="l", ref_ts=X.REF_TS, trust_msg_host=True, strip_domain=True)
    raw = stream_events(spark, sf)
    ids = ["general", "loud", "hole", "no_digits", "guarded"]

    def load(s):
        return X.rules(s).filter(F.col("rule_id").isin(ids))

    days = raw.withColumn("day", F.dayofmonth("arrival_ts")).repartition(1).sortWithinPartitions("seq")
    for i, (a, b) in enumerate(((1, 9), (10, 11), (12, 31))):
        days.filter(F.col("day").between(a, b)).drop("day").write.parquet(str(tmp_path / "in" / f"{i}"))
    live = (spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1)
            .parquet(str(tmp_path / "in" / "*")))
    got = []
    stream = LogStream(spark, load, str(tmp_path / "state"), options,
                       on_written=lambda d, i: got.extend(
                           (r.rule_id, str(r.at), str(r.ts), r.msg, r.n, r.dest) for r in d.collect()))
    stream.start(live, str(tmp_path / "cp")).awaitTermination()
    last = 2
    got += [(r.rule_id, str(r.at), str(r.ts), r.msg, r.n, None) for r in stream.close(last).collect()]
    table = load(spark)
    routed = filters.apply_filters(route.route(parse.parse_lines(raw, **options),
                                               rules.compile_masks(table)), table)
    want = [(r.rule_id, str(r.at), str(r.ts), r.msg, r.n) for r in collapse.collapse_emit(routed).collect()]
    assert sorted(g[:5] for g in got) == sorted(want)
    assert {g[5] for g in got if g[0] == "general"} <= {"general.log", None}
    assert stream.diagnostics(last).count() == 0


def test_reload_marks_and_late_lines(spark, tmp_path):
    table = [("a", "*.*;mark.*")]

    def load(s):
        return s.createDataFrame([(i, sel, None, None, None, None, None, False, "d", "s")
                                  for i, sel in table],
                                 "rule_id string, selector string, program string, message_re string, "
                                 "host_re string, date_re string, time_re string, inverse boolean, "
                                 "dest string, sink string")

    def batch(*at):
        df = spark.createDataFrame([(i, f"<13>Jan  1 {t} same") for i, t in enumerate(at)],
                                   "seq bigint, line string")
        return df.withColumn("arrival_ts", F.lit("2024-06-01").cast("timestamp_ntz"))
    seen = {}
    stream = LogStream(spark, load, str(tmp_path), dict(default_host="l"), mark_interval=1200,
                       on_written=lambda d, i: seen.update({i: sorted(
                           (str(r["at"])[11:], r.msg, r.n) for r in d.collect())}))
    stream.process(batch("00:00:00", "00:00:05"), 0)
    assert seen[0] == [("00:00:00", "same", 0)]
    stream.process(batch("00:00:02", "01:01:00"), 1)  # one late, then long silence
    assert ("00:00:30", "last message repeated 2 times", 2) in seen[1]
    assert ("01:01:00", "same", 1) in seen[1]
    assert [x for x in seen[1] if x[1] == "-- MARK --"] == [
        ("00:20:00", "-- MARK --", None), ("00:40:00", "-- MARK --", None),
        ("01:00:00", "-- MARK --", None)]
    assert stream.diagnostics(1).first().msg == "syslogd: 1 lines came late"
    stream.process(batch("01:01:10"), 2)
    assert seen[2] == []
    table.append(("b", "kern.*"))
    stream.process(batch("01:01:20"), 3)  # rules changed: the run is closed, a new one starts
    assert seen[3] == [("01:01:10", "same", 1), ("01:01:20", "same", 0)]


def test_records_without_a_registered_sink_are_kept(spark, tmp_path):
    df = spark.createDataFrame([("good", "a"), ("nobody", "b"), (None, "c")], "sink string, msg string")
    got = []
    deliver.register_sink("good", lambda frame, _: got.extend(r.msg for r in frame.collect()))
    letters = str(tmp_path / "letters")
    try:
        assert list(deliver.deliver(df, 1, letters)) == [deliver.NO_SINK] and got == ["a"]
        assert rows(deliver.undelivered(spark, letters).select("msg")) == [("b",), ("c",)]
        with pytest.raises(ValueError):
            deliver.deliver(df, 2)
        deliver.register_sink("nobody", lambda frame, _: got.extend(r.msg for r in frame.collect()))
        ledger = str(tmp_path / "ledger")
        assert deliver.replay(deliver.undelivered(spark, letters), "nobody", ledger) == 1
        assert deliver.replay(deliver.undelivered(spark, letters), "nobody", ledger) == 0
        assert got == ["a", "a", "b"]
    finally:
        deliver._SINKS.clear()


def test_sql_keeps_nulls(spark):
    df = spark.createDataFrame([(None, "x")], "host string, message string")
    assert rows(render.render_sql(df, "t")) == [("INSERT INTO t (host, message) VALUES(NULL, 'x')",)]


def test_symbols_of_lines_without_a_key(spark):
    df = spark.createDataFrame([(None, "a [<1>]"), (None, "a [<1>]"), (3, "b [<2>]"), (3, "c [<1>]")],
                               "seq long, line string")
    table = spark.createDataFrame([("1", "m", "f")], "addr string, module string, name string")
    assert rows(symbols.translate_symbols(df, table)) == sorted(
        [(None, "a  [<1> m.f ]"), (None, "a  [<1> m.f ]"), (3, "b [<2>]"), (3, "c  [<1> m.f ]")], key=repr)


def test_kafka_rows_of_several_partitions_have_numbers_of_their_own(spark):
    df = spark.range(6).selectExpr("current_timestamp() AS timestamp", "id div 3 * 5000 AS partition",
                                   "id % 3 AS offset", "'x' AS value")
    assert len({r.seq for r in src.from_stream(df).collect()}) == 6


def test_time_length_is_asked_for(spark):
    df = spark.createDataFrame([("s", "x")], "source string, line string")
    with pytest.raises(ValueError):
        src.file_lines(df, "MMM d HH:mm")


def test_a_batch_written_again_replaces_its_lines(spark, tmp_path):
    df = spark.createDataFrame([("d", "a"), ("d", "b")], "dest string, msg string").selectExpr(
        "dest", "msg", "'h' AS host", "timestamp_ntz '2024-01-01' AS ts", "1 AS fac", "2 AS sev")
    for batch in (0, 1, 1):
        deliver.write_files(df, str(tmp_path / "f"), batch_id=batch)
        deliver.write_log_table(df, str(tmp_path / "t"), batch_id=batch)
        deliver.write_forward(df, "text", path=str(tmp_path / "w"), batch_id=batch)
    assert spark.read.text(str(tmp_path / "f")).count() == 4
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert spark.read.text(str(tmp_path / "w")).count() == 4
