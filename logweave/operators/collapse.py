"""Repeat collapse: runs of identical lines on one output.

A line repeats the one before it on the same rule when message and host are
equal (severity does not count), it is shorter than 120 bytes and no mark.
Input is a routed table with ``rule_id, ts, seq, host, msg, fac, sev,
is_mark``. The order is ``(second, seq)``; ``seq`` is unique within a rule.

The rows are shuffled once, by rule and bounded chunk (see ``ordering``), and
sorted once. A run strictly inside a chunk is complete there. The first and
the last run of a chunk may go on in its neighbours; these edge runs, two per
chunk at most, are joined together in a second, small step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.functions.clock import epoch_seconds, from_epoch
from logweave.operators.ordering import BLOCK, CHUNK, HOT_ROWS, add_chunks, count_hours, in_chunk
from logweave.schema import REPEAT_INTERVALS
from logweave.session import freeze

KEYS = ["rule_id"]


def _lines(routed: DataFrame, hot_rows: int, block: int, collapse: bool, hours: DataFrame | None = None) -> DataFrame:
    """Lines in chunks with ``_new`` (starts a run), ``_pos`` and neighbours."""
    df = routed
    for name, default in (("is_mark", F.lit(False)), ("fac", F.lit(None).cast("int")),
                          ("sev", F.lit(None).cast("int"))):
        if name not in df.columns:
            df = df.withColumn(name, default)
    slim = df.select("rule_id", "ts", "seq", "fac", "sev", "host", "msg", "is_mark")
    w = in_chunk(KEYS)
    repeats = (F.lag("msg").over(w) == F.col("msg")) & (F.lag("host").over(w) == F.col("host"))
    return (add_chunks(slim, KEYS, hot_rows=hot_rows, block=block, hours=hours)
            .withColumn("_new", ~F.coalesce(repeats & _may_repeat(collapse), F.lit(False)))
            .withColumn("_pos", F.row_number().over(w))
            .withColumn("_prev_ts", F.lag("ts").over(w))
            .withColumn("_at_end", F.lead("seq").over(w).isNull()))


def _may_repeat(collapse: bool = True) -> Column:
    """Can this line count as a repeat of the one before it at all?"""
    return (F.lit(collapse) & (F.octet_length("msg") < S.COLLAPSE_BYTES)
            & ~F.coalesce("is_mark", F.lit(False)))


def _local_runs(lines: DataFrame) -> DataFrame:
    """Runs inside chunks: first record, ``n``, ``last_ts``, ``is_first``, ``is_last``.

    Of each run only its first line is kept, and of each chunk its last line;
    the distance to the next kept line gives the length. No aggregation.
    """
    w = in_chunk(KEYS)
    kept = lines.filter("_new OR _at_end")
    step = F.lead("_pos").over(w) - F.col("_pos")
    follows = F.lead("_new").over(w)
    ahead = (kept.withColumn("_step", step).withColumn("_follows", follows)
             .withColumn("_next_ts", F.lead("ts").over(w))
             .withColumn("_next_prev", F.lead("_prev_ts").over(w)))
    last = F.when(F.col("_step").isNull(), F.col("ts")) \
        .when(F.col("_follows"), F.col("_next_prev")).otherwise(F.col("_next_ts"))
    n = F.when(F.col("_step").isNull(), 1).when(F.col("_follows"), F.col("_step")) \
        .otherwise(F.col("_step") + 1)
    return (ahead.filter("_new").select(
        "rule_id", *CHUNK, "_sec", "seq", "ts", "fac", "sev", "host", "msg", "is_mark",
        n.cast("bigint").alias("n"), last.alias("last_ts"),
        (F.col("_pos") == 1).alias("is_first"),
        (~F.coalesce("_follows", F.lit(False))).alias("is_last")))


def _joined_edges(edges: DataFrame, hours: DataFrame, collapse: bool, hot_rows: int, block: int) -> DataFrame:
    """Edge runs of small chunks joined inside larger ones, of ``hot_rows`` and ``block`` lines.

    What comes out has the columns of :func:`_local_runs` and is the same kind of thing: two rows
    per large chunk may go on in its neighbours, the others are complete.
    """
    w = in_chunk(KEYS)
    same = ((F.lag("msg").over(w) == F.col("msg")) & (F.lag("host").over(w) == F.col("host"))
            & F.col("is_first") & _may_repeat(collapse))
    head = F.struct("_sec", "seq", "ts", "fac", "sev", "host", "msg", "is_mark", "is_first")
    pieces = (add_chunks(edges.drop("_sec", *CHUNK), KEYS, hot_rows=hot_rows, block=block, hours=hours)
              .withColumn("_brk", ~F.coalesce(same, F.lit(False))).withColumn("_opens", F.row_number().over(w) == 1)
              .withColumn("_at_end", F.lead(F.lit(1)).over(w).isNull())
              .withColumn("_gid", F.sum(F.col("_brk").cast("bigint")).over(
                  w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return (pieces.groupBy(*KEYS, *CHUNK, "_gid")
            .agg(F.min(head).alias("h"), F.sum("n").alias("n"), F.max(F.struct("_sec", "seq", "last_ts")).alias("t"),
                 F.bool_or("_opens").alias("_opens"), F.bool_or("_at_end").alias("is_last"))
            .select("rule_id", *CHUNK, *[f"h.{c}" for c in ("_sec", "seq", "ts", "fac", "sev", "host", "msg", "is_mark")],
                    "n", "t.last_ts", (F.col("_opens") & F.col("h.is_first")).alias("is_first"), "is_last"))


def _number_edges(edges: DataFrame, collapse: bool) -> DataFrame:
    """Edge runs with ``_gid``: pieces of one run share it. ``_brk`` starts a new one.

    Only the first run of a chunk can continue the piece before it, which is
    the last run of the chunk before. The window sees two rows per chunk.
    """
    w = Window.partitionBy("rule_id").orderBy("_sec", "seq")
    same = ((F.lag("msg").over(w) == F.col("msg")) & (F.lag("host").over(w) == F.col("host"))
            & F.col("is_first") & _may_repeat(collapse))
    return (edges.withColumn("_brk", ~F.coalesce(same, F.lit(False)))
            .withColumn("_gid", F.sum(F.col("_brk").cast("int")).over(
                w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))


def collapse_runs(routed: DataFrame, hot_rows: int = HOT_ROWS, block: int = BLOCK,
                  collapse: bool = True, edge_rows: int = HOT_ROWS) -> DataFrame:
    """One summary row per run: its first record, ``n`` lines, first and last time.

    ``(rule_id, first_seq)`` identifies a run.

    Chunks smaller than the usual ones have as many edge runs as there are lines, so these are first
    joined inside chunks of the usual size (``edge_rows``); two per such chunk are left for the window over a rule.
    """
    small = hot_rows < edge_rows or block < edge_rows
    hours = count_hours(routed, KEYS) if small else None
    runs = _local_runs(_lines(routed, hot_rows, block, collapse, hours))
    cols = ["rule_id", F.col("seq").alias("first_seq"), "host", "msg", "fac", "sev", "n",
            F.col("ts").alias("first_ts"), "last_ts"]
    inner = runs.filter("NOT is_first AND NOT is_last").select(*cols)
    edges = runs.filter("is_first OR is_last")
    if small:
        edges = _joined_edges(edges, hours, collapse, edge_rows, edge_rows)
        inner = inner.unionByName(edges.filter("NOT is_first AND NOT is_last").select(*cols))
        edges = edges.filter("is_first OR is_last")
    pieces = _number_edges(edges, collapse)
    head = F.struct("_sec", "seq", "ts", "host", "msg", "fac", "sev")
    whole = (pieces.groupBy("rule_id", "_gid")
             .agg(F.min(head).alias("h"), F.sum("n").alias("n"),
                  F.max(F.struct("_sec", "seq", "last_ts")).alias("t"))
             .select("rule_id", "h.seq", "h.host", "h.msg", "h.fac", "h.sev", "n", "h.ts",
                     "t.last_ts").select(*cols))
    return inner.unionByName(whole)


# --- timed emission -------------------------------------------------------

# Timer state: lw = second of the last write, step = back-off step,
# p = pending repeats, last = second of the last repeat, out = what was written.
_OUT = "array<struct<at:bigint,stamp:bigint,n:bigint>>"


def _interval(step: Column) -> Column:
    a, b, c = REPEAT_INTERVALS
    return F.when(step == 0, a).when(step == 1, b).otherwise(c).cast("bigint")


def _state(lw, step, p, last, out) -> Column:
    return F.struct(lw.cast("bigint").alias("lw"), step.cast("int").alias("step"),
                    p.cast("bigint").alias("p"), last.cast("bigint").alias("last"),
                    out.cast(_OUT).alias("out"))


def _written(at: Column, stamp: Column, n: Column) -> Column:
    return F.array(F.struct(at.cast("bigint").alias("at"), stamp.cast("bigint").alias("stamp"),
                            n.cast("bigint").alias("n")))


def _arrivals(times: Column, skip_first: Column) -> Column:
    """Arrivals of a run as ``(t, k)``: at most three per second.

    After two arrivals within one second no flush can follow in that second,
    so the others are counted together.
    """
    first = times[0]["sec"]

    def spread(x: Column) -> Column:
        c = x["c"] - F.when(skip_first & (x["sec"] == first), 1).otherwise(0)
        one = F.struct(x["sec"].alias("t"), F.lit(1).cast("bigint").alias("k"))
        rest = F.struct(x["sec"].alias("t"), (c - 2).alias("k"))
        return F.slice(F.array(one, one, rest), F.lit(1), F.least(c, F.lit(3)).cast("int"))

    return F.flatten(F.transform(times, spread))


def _fold(start: Column, arrivals: Column) -> Column:
    """The repeat timer over the arrivals of one run, deadline before arrival."""
    def step(s: Column, a: Column) -> Column:
        due = s["lw"] + _interval(s["step"])
        flush = (s["p"] > 0) & (due <= a["t"])
        nxt = F.least(s["step"] + 1, F.lit(2))
        u = _state(F.when(flush, due).otherwise(s["lw"]), F.when(flush, nxt).otherwise(s["step"]),
                   F.when(flush, a["k"]).otherwise(s["p"] + a["k"]), a["t"],
                   F.when(flush, F.concat(s["out"], _written(due, s["last"], s["p"])))
                   .otherwise(s["out"]))

        def arrive(u: Column) -> Column:
            late = a["t"] > u["lw"] + _interval(u["step"])
            return _state(F.when(late, a["t"]).otherwise(u["lw"]),
                          F.when(late, F.least(u["step"] + 1, F.lit(2))).otherwise(u["step"]),
                          F.when(late, F.lit(0)).otherwise(u["p"]), a["t"],
                          F.when(late, F.concat(u["out"], _written(a["t"], a["t"], u["p"])))
                          .otherwise(u["out"]))
        # a one-element transform binds u once, so the fold stays linear
        return F.transform(F.array(u), arrive)[0]

    return F.aggregate(arrivals, start, step)


def _fresh(first: Column) -> Column:
    zero = F.lit(0)
    return _state(first, zero, zero, first, _written(first, first, zero))


def _closing(s: Column, nxt: Column) -> Column:
    """Pending repeats go out at the deadline or when the next run begins."""
    due = s["lw"] + _interval(s["step"])
    at = F.least(due, F.coalesce(nxt, due))
    return F.when(s["p"] > 0, F.concat(s["out"], _written(at, s["last"], s["p"]))) \
        .otherwise(s["out"])


class RepeatTimer:
    """The same timer, one arrival at a time; for runs that cross chunks."""

    def __init__(self, lw: int, step: int = 0, p: int = 0, last: int | None = None):
        self.lw, self.step, self.p, self.last = lw, step, p, lw if last is None else last

    def _due(self) -> int:
        return self.lw + REPEAT_INTERVALS[self.step]

    def _wrote(self, at: int) -> None:
        self.lw, self.step = at, min(self.step + 1, 2)

    def arrive(self, t: int, k: int, out: list) -> None:
        """``k`` arrivals in second ``t``."""
        for part in [1] * min(k, 2) + ([k - 2] if k > 2 else []):
            if self.p and self._due() <= t:
                due = self._due()
                out.append((due, self.last, self.p))
                self._wrote(due)
                self.p = 0
            self.p += part
            self.last = t
            if t > self._due():
                out.append((t, t, self.p))
                self._wrote(t)
                self.p = 0

    def overdue(self, clock: int, out: list) -> None:
        """Write pending repeats whose deadline is not after ``clock``."""
        if self.p and self._due() <= clock:
            due = self._due()
            out.append((due, self.last, self.p))
            self._wrote(due)
            self.p = 0

    def close(self, nxt: int | None, out: list) -> None:
        if self.p:
            out.append((min(self._due(), self._due() if nxt is None else nxt), self.last, self.p))
            self.p = 0


_EMITTED = ["rule_id", "run", "fac", "sev", "host", "msg", "at", "stamp", "n"]
_EMITTED_SCHEMA = ("rule_id string, run bigint, fac int, sev int, host string, msg string, "
                   "at bigint, stamp bigint, n bigint")


def _fold_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Carry the timer over the pieces of each run; rows come sorted by time."""
    run = timer = None
    about: tuple = ()
    nxt = None

    def frame(rows):
        pdf = pd.DataFrame(rows, columns=_EMITTED)
        return pdf.astype({"fac": "Int32", "sev": "Int32"})

    def finish() -> list:
        out: list[tuple] = []
        timer.close(nxt, out)
        return [(*about, *o) for o in out]

    for pdf in batches:
        rows: list[tuple] = []
        for r in pdf.itertuples(index=False):
            out: list[tuple] = []
            skip = 0
            if (r.rule_id, r.gid) != run:
                if timer is not None:
                    rows += finish()
                run = (r.rule_id, r.gid)
                fac, sev = (None if pd.isna(x) else int(x) for x in (r.fac, r.sev))
                about = (r.rule_id, r.seq, fac, sev, r.host, r.msg)
                first = int(r.secs[0])
                timer = RepeatTimer(first)
                out.append((first, first, 0))
                skip = 1
            for t, c in zip(r.secs, r.counts):
                if c > skip:
                    timer.arrive(int(t), int(c) - skip, out)
                skip = 0
            nxt = None if pd.isna(r.nxt) else int(r.nxt)
            rows += [(*about, *o) for o in out]
        yield frame(rows)
    if timer is not None:
        yield frame(finish())


def repeat_text(n: Column, msg: Column) -> Column:
    """Text of a written record: the line, or the summary of several repeats.

    The summary's words are fixed values: readers of logs look for them.
    """
    return F.when(n > 1, F.concat(F.lit("last message repeated "), n.cast("string"),
                                  F.lit(" times"))).otherwise(msg)


def _timed_runs(lines: DataFrame) -> DataFrame:
    """Runs inside chunks with ``times``, their seconds with counts, in order.

    Counting per second comes first, so a run has at most a day of seconds.
    """
    w = in_chunk(KEYS)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.struct("_sec", "seq", "fac", "sev", "host", "msg", "is_mark")
    by_run = ["rule_id", *CHUNK, "_start"]
    return (lines.withColumn("_start", F.max(F.when(F.col("_new"), F.col("_pos"))).over(upto))
            .groupBy(*by_run, "_sec")
            .agg(F.count(F.lit(1)).alias("_c"), F.min(head).alias("_h"),
                 F.max(F.col("_at_end").cast("int")).alias("_e"),
                 F.max(F.when(F.col("_next_new"), F.col("_next_sec"))).alias("_n"))
            .groupBy(*by_run)
            .agg(F.min("_h").alias("h"), F.max("_e").alias("_e"), F.max("_n").alias("nxt"),
                 F.sort_array(F.collect_list(F.struct(
                     F.col("_sec").alias("sec"), F.col("_c").alias("c")))).alias("times"))
            .select("rule_id", "h.*", "times", "nxt", (F.col("_start") == 1).alias("is_first"),
                    (F.col("_e") == 1).alias("is_last")))


def _emission_parts(lines: DataFrame, collapse: bool) -> tuple[DataFrame, DataFrame]:
    """What inner runs write, and the pieces of edge runs still to be folded."""
    w = in_chunk(KEYS)
    lines = (lines.withColumn("_next_new", F.lead("_new").over(w))
             .withColumn("_next_sec", F.lead("_sec").over(w)))
    alone = F.col("_new") & F.coalesce("_next_new", F.lit(False)) & (F.col("_pos") > 1)
    zero = F.lit(0).cast("bigint")
    single = lines.filter(alone).select(
        "rule_id", F.col("seq").alias("run"), "fac", "sev", "host", "msg",
        F.col("_sec").alias("at"), F.col("_sec").alias("stamp"), zero.alias("n"))

    runs = _timed_runs(lines.filter(~alone))
    state = _fold(_fresh(F.col("_sec")), _arrivals(F.col("times"), F.lit(True)))
    folded = F.transform(F.array(state), lambda s: _closing(s, F.col("nxt")))[0]
    inner = (runs.filter("NOT is_first AND NOT is_last")
             .select("rule_id", F.col("seq").alias("run"), "fac", "sev", "host", "msg",
                     F.explode(folded).alias("_w"))
             .select("rule_id", "run", "fac", "sev", "host", "msg", "_w.*"))

    # from the last piece to the first, so that the frame only grows
    order = Window.partitionBy("rule_id").orderBy(F.desc("_sec"), F.desc("seq"))
    pieces = _number_edges(runs.filter("is_first OR is_last"), collapse)
    starts = F.when(F.col("_brk"), F.col("_sec"))
    # a last run ends where the next piece starts, unless that one continues it
    after = F.last(starts, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = (pieces.withColumn("_after", after)
             .select("rule_id", F.col("_gid").cast("bigint").alias("gid"), "_sec", "seq",
                     "fac", "sev", "host", "msg", F.col("times.sec").alias("secs"),
                     F.col("times.c").alias("counts"), F.coalesce("nxt", "_after").alias("nxt")))
    return single.unionByName(inner), outer


def _by_run(pieces: DataFrame) -> DataFrame:
    return (pieces.repartition("rule_id", "gid")
            .sortWithinPartitions("rule_id", "gid", "_sec", "seq"))


def _shown(written: DataFrame) -> DataFrame:
    return written.select("rule_id", "run", from_epoch(F.col("at")).alias("at"),
                          from_epoch(F.col("stamp")).alias("ts"), "fac", "sev", "host",
                          repeat_text(F.col("n"), F.col("msg")).alias("msg"), "n")


def collapse_emit(routed: DataFrame, hot_rows: int = HOT_ROWS, block: int = BLOCK,
                  collapse: bool = True) -> DataFrame:
    """The records each output writes, with repeats summed up and timed.

    ``at`` is when a record is written, ``ts`` the time it shows, ``n`` the
    repeats it stands for (0 for the first line of a run), ``run`` the ``seq``
    of the run's first line. A line without repeats is written at once. Runs
    inside a chunk are folded in place. The pieces of a run over several
    chunks are streamed in order through a task that carries four numbers.
    """
    done, pieces = _emission_parts(_lines(routed, hot_rows, block, collapse), collapse)
    outer = _by_run(pieces).mapInPandas(_fold_pieces, _EMITTED_SCHEMA)
    return _shown(done.unionByName(outer))


# --- the same, batch after batch of a stream --------------------------------

STATE_SCHEMA = ("rule_id string, run bigint, fac int, sev int, host string, msg string, "
                "sec bigint, lw bigint, step int, p bigint, last bigint")
CARRY_SEQ = -1


def _open_folder(clock: int):
    """Fold pieces that may begin with carried state and may stay open."""
    cols = ["kind", *_EMITTED, "lw", "step", "p", "last"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = timer = None
        about: tuple = ()
        nxt = None

        def finish() -> list:
            out: list[tuple] = []
            if nxt is not None:
                timer.close(nxt, out)
                return [("w", *about, *o, 0, 0, 0, 0) for o in out]
            timer.overdue(clock, out)
            rows = [("w", *about, *o, 0, 0, 0, 0) for o in out]
            return rows + [("s", *about, 0, 0, 0, timer.lw, timer.step, timer.p, timer.last)]

        for pdf in batches:
            rows: list[tuple] = []
            for r in pdf.itertuples(index=False):
                out: list[tuple] = []
                skip = 0
                if (r.rule_id, r.gid) != run:
                    if timer is not None:
                        rows += finish()
                    run = (r.rule_id, r.gid)
                    carried = not pd.isna(r.lw)
                    fac, sev = (None if pd.isna(x) else int(x) for x in (r.fac, r.sev))
                    about = (r.rule_id, int(r.run), fac, sev, r.host, r.msg)
                    skip = 1
                    if carried:
                        timer = RepeatTimer(int(r.lw), int(r.step), int(r.p), int(r.last))
                    else:
                        timer = RepeatTimer(int(r.secs[0]))
                        out.append((int(r.secs[0]), int(r.secs[0]), 0))
                for t, c in zip(r.secs, r.counts):
                    if c > skip:
                        timer.arrive(int(t), int(c) - skip, out)
                    skip = 0
                nxt = None if pd.isna(r.nxt) else int(r.nxt)
                rows += [("w", *about, *o, 0, 0, 0, 0) for o in out]
            yield pd.DataFrame(rows, columns=cols).astype({"fac": "Int32", "sev": "Int32"})
        if timer is not None:
            yield pd.DataFrame(finish(), columns=cols).astype({"fac": "Int32", "sev": "Int32"})

    return fold


def collapse_step(routed: DataFrame, state: DataFrame, clock: int, hot_rows: int = HOT_ROWS,
                  block: int = BLOCK, collapse: bool = True, batch_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One batch of a stream: ``(written, new state)``.

    ``batch_id`` makes the numbers of runs differ from those of other batches,
    whose lines are numbered from the start again.

    ``state`` is the open run of each rule (``STATE_SCHEMA``). It goes in as a
    first line of its rule, so runs continue over batches exactly as they do
    over chunks. ``clock`` is the latest second seen; pending repeats whose
    deadline has passed by then are written. Lines must not be earlier than
    the clock of the batch before.
    """
    carried = state.select("rule_id", from_epoch(F.col("sec")).alias("ts"),
                           F.lit(CARRY_SEQ).cast("bigint").alias("seq"), "fac", "sev", "host",
                           "msg", F.lit(False).alias("is_mark"))
    both = routed.select(*carried.columns).unionByName(carried)
    done, pieces = _emission_parts(_lines(both, hot_rows, block, collapse), collapse)
    timers = state.select("rule_id", F.lit(CARRY_SEQ).cast("bigint").alias("seq"), "run", "lw",
                          "step", "p", "last")
    # both sides are small: two pieces per chunk, a state row per rule
    def run_of(seq: str) -> Column:
        return F.col(seq) if batch_id is None else F.xxhash64(F.lit(batch_id), F.col(seq))

    known = (pieces.join(timers, ["rule_id", "seq"], "left")
             .withColumn("run", F.coalesce("run", run_of("seq"))))
    done = done.withColumn("run", run_of("run"))
    schema = f"kind string, {_EMITTED_SCHEMA}, lw bigint, step int, p bigint, last bigint"
    folded = freeze(_by_run(known).mapInPandas(_open_folder(clock), schema))
    written = done.unionByName(folded.filter("kind = 'w'").select(*_EMITTED))
    opened = folded.filter("kind = 's'").select(
        "rule_id", "run", "fac", "sev", "host", "msg",
        F.greatest("last", "lw").alias("sec"), "lw", "step", "p", "last")
    return _shown(written), opened


def close_state(state: DataFrame, at: int | None = None) -> DataFrame:
    """Write out pending repeats: at their deadline, or by ``at`` on a reload."""
    due = F.col("lw") + _interval(F.col("step"))
    when = due if at is None else F.least(due, F.lit(at).cast("bigint"))
    return _shown(state.filter("p > 0").select(
        "rule_id", "run", "fac", "sev", "host", "msg", when.alias("at"),
        F.col("last").alias("stamp"), F.col("p").alias("n")))


def output_gaps(routed: DataFrame, min_gap: int) -> DataFrame:
    """Silent stretches of ``min_gap`` seconds or more per rule.

    Inside a slot of ``min_gap`` seconds no gap is that long, so first and
    last second per slot suffice; they are combined before the shuffle.
    """
    sec = epoch_seconds(F.col("ts"))
    slots = (routed.withColumn("_sec", sec).withColumn("_slot", F.floor(F.col("_sec") / min_gap))
             .groupBy("rule_id", "_slot").agg(F.min("_sec").alias("_a"), F.max("_sec").alias("_b")))
    before = F.lag("_b").over(Window.partitionBy("rule_id").orderBy("_slot"))
    return (slots.withColumn("_p", before).filter(F.col("_a") - F.col("_p") >= min_gap)
            .select("rule_id", from_epoch(F.col("_p")).alias("silent_from"),
                    from_epoch(F.col("_a")).alias("silent_to"),
                    (F.col("_a") - F.col("_p")).cast("bigint").alias("seconds")))
