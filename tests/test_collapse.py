"""Repeat timelines, chunk independence and the same results from a stream."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logweave.functions.clock import epoch_seconds, from_epoch
from logweave.operators import collapse, marks, rules

LINE = ("line", "h")


def frame(spark, events):
    """``(rule, second, seq, host, msg)`` rows as routed records."""
    df = spark.createDataFrame(events, "rule_id string, s bigint, seq bigint, host string, msg string")
    return (df.withColumn("ts", from_epoch(F.col("s"))).drop("s")
            .withColumn("fac", F.lit(1)).withColumn("sev", (F.col("seq") % 8).cast("int"))
            .withColumn("is_mark", F.lit(False)))


def emitted(df):
    return sorted((r.rule_id, r.a, r.t, r.msg, r.n) for r in df.select(
        "rule_id", epoch_seconds(F.col("at")).alias("a"), epoch_seconds(F.col("ts")).alias("t"),
        "msg", "n").collect())


def timeline(spark, events):
    ev = [("r", s, i, h, m) for i, (s, m, h) in enumerate(events)]
    return [x[1:] for x in emitted(collapse.collapse_emit(frame(spark, ev)))]


def at(*seconds):
    return [(s, *LINE) for s in seconds]


@pytest.mark.parametrize("events,want", [
    (at(0, 10) + [(12, "other", "h")],
     [(0, 0, "line", 0), (12, 10, "line", 1), (12, 12, "other", 0)]),
    (at(0, 10, 20) + [(25, "other", "h")],
     [(0, 0, "line", 0), (25, 20, "last message repeated 2 times", 2), (25, 25, "other", 0)]),
    (at(0, 10, 20), [(0, 0, "line", 0), (30, 20, "last message repeated 2 times", 2)]),
    (at(0, 40), [(0, 0, "line", 0), (40, 40, "line", 1)]),
    ([(0, "x" * 120, "h"), (1, "x" * 120, "h")],
     [(0, 0, "x" * 120, 0), (1, 1, "x" * 120, 0)]),
    ([(0, "x" * 119, "h"), (1, "x" * 119, "h")],
     [(0, 0, "x" * 119, 0), (30, 1, "x" * 119, 1)]),
    ([(0, "line", "h"), (1, "line", "g")], [(0, 0, "line", 0), (1, 1, "line", 0)]),
])
def test_timelines(spark, events, want):
    assert timeline(spark, events) == want


def simulate(events, flush_end=True):
    """One rule, event by event: an own little daemon with a deadline timer."""
    out, prev, lw, step, p, last = [], None, 0, 0, 0, 0
    gaps = (30, 120, 600)

    def say(when, stamp, n):
        out.append((when, stamp, prev[0] if n < 2 else f"last message repeated {n} times", n))

    for s, msg, host in events:
        if p and lw + gaps[step] <= s:
            due = lw + gaps[step]
            say(due, last, p)
            lw, step, p = due, min(step + 1, 2), 0
        if (msg, host) == prev and len(msg) < 120:
            p, last = p + 1, s
            if s > lw + gaps[step]:
                say(s, s, p)
                lw, step, p = s, min(step + 1, 2), 0
        else:
            if p:
                say(min(s, lw + gaps[step]), last, p)
            prev, lw, step, p, last = (msg, host), s, 0, 0, s
            say(s, s, 0)
    if p and flush_end:
        say(lw + gaps[step], last, p)
    return out


def make_events(seed, n=400, names=2, scale=40):
    rnd = random.Random(seed)
    s, out = rnd.randint(0, 3 * 86400), []
    for _ in range(n):
        s += rnd.choice([0, 0, 1, rnd.randint(0, scale), rnd.randint(0, 10 * scale), 7200
                         if rnd.random() < .02 else 3])
        out.append((s, rnd.choice("abc"[:names]) if rnd.random() < .4 else "a", "h"))
    return out


@pytest.fixture(scope="module")
def many():
    return {f"r{i}": make_events(i, scale=20 * (i + 1)) for i in range(6)}


def as_rows(many):
    return [(r, s, i, h, m) for r, ev in many.items() for i, (s, m, h) in enumerate(ev)]


@pytest.mark.parametrize("hot,block", [(10**6, 10**6), (50, 10), (3, 2), (0, 1)])
def test_random_runs_any_chunks(spark, many, hot, block):
    want = sorted((r, *x) for r, ev in many.items() for x in simulate(ev))
    got = collapse.collapse_emit(frame(spark, as_rows(many)), hot_rows=hot, block=block)
    assert emitted(got) == want


@pytest.mark.parametrize("hot,block", [(10**6, 10**6), (3, 2)])
def test_summaries_count_every_line(spark, many, hot, block):
    got = collapse.collapse_runs(frame(spark, as_rows(many)), hot_rows=hot, block=block).collect()
    assert sum(r.n for r in got) == sum(len(e) for e in many.values())
    for rule, ev in many.items():
        starts = [i for i, (_, m, h) in enumerate(ev) if i == 0 or (m, h) != ev[i - 1][1:]]
        mine = sorted((r.first_seq, r.n) for r in got if r.rule_id == rule)
        ends = starts[1:] + [len(ev)]
        assert mine == [(a, b - a) for a, b in zip(starts, ends)]


def test_off_switch_and_marks(spark):
    ev = [("r", s, i, "h", "m") for i, s in enumerate((0, 1, 2))]
    assert len(emitted(collapse.collapse_emit(frame(spark, ev), collapse=False))) == 3
    df = frame(spark, ev).withColumn("is_mark", F.col("seq") == 1)
    got = sorted((r.first_seq, r.n) for r in collapse.collapse_runs(df).collect())
    assert got == [(0, 1), (1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_batches_equals_batch(spark, many, seed):
    rnd = random.Random(seed)
    all_rows = sorted(as_rows(many), key=lambda x: x[1])
    cuts = sorted(rnd.sample(range(1, len(all_rows)), 3))
    state = spark.createDataFrame([], collapse.STATE_SCHEMA)
    got, clock = [], 0
    for a, b in zip([0] + cuts, cuts + [len(all_rows)]):
        part = all_rows[a:b]
        clock = max(clock, max(x[1] for x in part))
        written, state = collapse.collapse_step(frame(spark, part), state, clock, hot_rows=100)
        got += emitted(written)
        state = state.checkpoint()
    got += emitted(collapse.close_state(state))
    assert sorted(got) == sorted((r, *x) for r, ev in many.items() for x in simulate(ev))


def test_gaps(spark):
    ev = [("r", s, i, "h", "m") for i, s in enumerate((0, 5, 99, 200, 300, 1000))]
    got = collapse.output_gaps(frame(spark, ev), 100)
    assert sorted(r.seconds for r in got.collect()) == [100, 101, 700]


def test_marks_only_when_idle(spark):
    compiled = rules.compile_masks(spark.createDataFrame(
        [("a", "mark.*"), ("b", "*.*")], "rule_id string, selector string"))
    written = frame(spark, [("a", s, i, "h", "m") for i, s in enumerate((600, 601, 2400))])
    got = marks.marks(written.withColumn("at", F.col("ts")), compiled, "1970-01-01 00:00:00",
                      "1970-01-01 01:00:00")
    # 1200: last write 599 s before, 2400: written now, 3600: 1200 s before
    assert rows(got.select("rule_id", epoch_seconds(F.col("ts")))) == [("a", 0), ("a", 3600)]


def test_interleaved_sources_leave_few_edges(spark):
    """500 files with a line per second each: numbers far apart, chunks filled all the same."""
    lines = spark.range(120_000).selectExpr(
        "'r' AS rule_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id div 500) AS ts",
        "(id % 500) * 8589934592 + id div 500 AS seq", "'h' AS host", "concat('m', id % 7) AS msg")
    for hot, most in ((1000, 0.01), (100, 0.05)):
        runs = collapse._local_runs(collapse._lines(lines, hot, hot, True))
        edges = runs.filter("is_first OR is_last").count()
        assert edges <= most * 120_000
    assert collapse.collapse_runs(lines, hot_rows=100, block=100).agg({"n": "sum"}).first()[0] == 120_000


def test_edges_are_joined_inside_larger_chunks(spark):
    """Tiny chunks give the runs of large ones, and a handful of pieces is left for the window over a rule."""
    rnd = random.Random(5)
    lines, s = [], 0
    for i in range(1500):
        s += rnd.choice([0, 0, 0, 1, 40, 3000])
        lines.append((rnd.choice("ab"), s, i, rnd.choice(["h", "h", "h", None]), "m" * rnd.choice([1, 1, 1, 1, 2, 130])))
    df = frame(spark, lines).withColumn("is_mark", F.col("seq") % 50 == 0)
    df = df.withColumn("ts", F.when(F.col("seq") % 97 > 0, F.col("ts"))).cache()
    want = rows(collapse.collapse_runs(df))
    for hot, block, edge in ((3, 2, 10**6), (3, 2, 20), (5, 3, 7), (3, 2, 4)):
        assert rows(collapse.collapse_runs(df, hot_rows=hot, block=block, edge_rows=edge)) == want
    whole = rows(collapse.collapse_runs(df, collapse=False))
    assert len(whole) == 1500 and rows(collapse.collapse_runs(df, hot_rows=3, block=2, collapse=False)) == whole
    runs = collapse._local_runs(collapse._lines(df, 3, 2, True)).filter("is_first OR is_last")
    joined = collapse._joined_edges(runs, collapse.count_hours(df, ["rule_id"]), True, 10**6, 10**6)
    days = df.select("rule_id", F.to_date("ts")).distinct().count()
    assert runs.count() > 500 and joined.filter("is_first OR is_last").count() <= 2 * days


def test_many_edges_of_one_rule_end_soon(spark):
    import time

    lines = spark.range(80_000).selectExpr(
        "'r' AS rule_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id AS seq",
        "'h' AS host", "concat('m', id div 3) AS msg")
    start = time.time()
    assert collapse.collapse_emit(lines, hot_rows=2, block=2).count() >= 80_000 / 3
    assert time.time() - start < 60
