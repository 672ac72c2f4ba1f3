"""Streams: parse, route, filter, collapse and deliver, batch after batch.

Every micro-batch runs the batch operators; what has to outlive it (open runs,
partial lines, chain keys) is a small table per batch. An output that owns the
whole stream is therefore spread over tasks inside a batch like anywhere else,
which a state store keyed by output could not do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave import schema as S
from logweave.functions.clock import epoch_seconds, from_epoch
from logweave.operators import collapse, diagnostics, filters, integrity, marks, parse, route, rules
from logweave.operators.joins import lookup_join
from logweave.operators.ordering import BLOCK, HOT_ROWS
from logweave.operators.reassemble import join_pieces, numbered_pieces
from logweave.sinks import deliver
from logweave.sources.lines import with_seq
from logweave.streaming.state import BatchState

# clock: the latest second, base: the same without idle time, wall: the beat when lines last came
_CLOCK = "clock bigint, version bigint, late bigint, base bigint, wall bigint"
_BEAT = "_beat"


def _version(rules: DataFrame) -> int:
    """A number that changes with any rule, with its place in a column, and with how often it stands there."""
    each = F.xxhash64(F.to_json(F.struct(*rules.columns))).cast("decimal(38,0)")
    row = rules.agg(F.sum(each).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return (int(row["s"] or 0) * 31 + row["n"]) % (1 << 62)


@dataclass
class LogStream:
    """Settings of one stream. ``load_rules`` is called for every batch, so a
    changed rule table takes effect with the next batch; open runs are then
    written out and start anew.

    Lines are written in the order of a clock, the latest time seen. A time more than ``ahead`` seconds
    after the latest arrival of its batch does not move the clock, and a line
    whose time is behind the clock is written now; both show the time they came with.
    Those wrong by more than ``lateness`` seconds are also written, as records of their rules, to a folder of
    their own (``late_dir``) and counted (:meth:`diagnostics`).

    With ``heartbeat`` a beat a second comes with the lines, so batches run on without them: while
    none come, the clock goes on as time passes, ``idle_delay`` seconds behind it, and
    summaries and marks are written when they are due.
    """

    spark: SparkSession
    load_rules: Callable[[SparkSession], DataFrame]
    state_dir: str
    parse_options: dict = field(default_factory=dict)
    dead_letter: str | None = None
    mark_interval: int | None = None
    collapse: bool = True
    hot_rows: int = HOT_ROWS
    block: int = BLOCK
    on_written: Callable[[DataFrame, int], None] | None = None
    ahead: int = 3600
    lateness: int = 0
    late_dir: str | None = None
    heartbeat: bool = False
    idle_delay: int = 5

    def __post_init__(self):
        self.runs = BatchState(self.spark, f"{self.state_dir}/runs", collapse.STATE_SCHEMA)
        self.clocks = BatchState(self.spark, f"{self.state_dir}/clock", _CLOCK)

    def start(self, raw: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        if self.heartbeat:
            beats = (raw.sparkSession.readStream.format("rate").option("rowsPerSecond", 1)
                     .option("numPartitions", 1).load().select(F.col("timestamp").alias(_BEAT)))
            raw = raw.unionByName(beats, allowMissingColumns=True)
        return (raw.writeStream.foreachBatch(self.process)
                .option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self.spark = self.runs.spark = self.clocks.spark = batch.sparkSession
        table = self.load_rules(self.spark)
        version = _version(table)
        beat = None
        if _BEAT in batch.columns:
            beat = batch.agg(F.max(F.unix_seconds(F.col(_BEAT).cast("timestamp")))).first()[0]
            batch = batch.filter(F.col(_BEAT).isNull()).drop(_BEAT)
        compiled = rules.compile_masks(table)
        lines = with_seq(batch)
        records = parse.drop_empty(parse.parse_lines(lines, **self.parse_options))
        own = self._own_records(lines, table, version, batch_id)
        if own is not None:
            records = records.unionByName(own, allowMissingColumns=True)
        routed = filters.apply_filters(route.route(records, compiled), table)
        routed = routed.persist(StorageLevel.DISK_ONLY)
        try:
            self._write(routed, table, compiled, version, batch_id, self._latest(lines), beat)
        finally:
            routed.unpersist()

    def _latest(self, lines: DataFrame) -> int | None:
        """The last second that a line of a batch may be of."""
        if "arrival_ts" not in lines.columns:
            return None
        came = lines.agg(F.max(epoch_seconds(F.col("arrival_ts").cast("timestamp_ntz")))).first()[0]
        return None if came is None else came + self.ahead

    def _own_records(self, lines: DataFrame, table: DataFrame, version: int, batch_id: int) -> DataFrame | None:
        """Skipped lines and, when they come into force, rejected rules, as records about ourselves."""
        host = self.parse_options.get("default_host", "localhost")
        found = []
        before = self.clocks.before(batch_id).first()
        if before is None or before["version"] != version:
            # numbers below those of lines, a time that a repeated batch finds again
            at = from_epoch(F.lit(before["clock"] if before else 0))
            bad = diagnostics.rule_errors(table, at, host, -F.xxhash64("rule_id").bitwiseAND((1 << 40) - 1) - 2)
            if before is None and "arrival_ts" in lines.columns:
                first = lines.agg(F.min("arrival_ts").cast("timestamp_ntz")).first()[0]
                bad = bad.withColumn("ts", F.lit(first).cast("timestamp_ntz"))
            found.append(bad)
        if self.parse_options.get("trust_msg_host"):
            _, dropped = parse.split_hosts(lines)
            at = F.col("arrival_ts") if "arrival_ts" in lines.columns else F.current_timestamp()
            found.append(diagnostics.line_errors(dropped, F.date_trunc("second", at), host, F.col("seq")))
        out = None
        for part in found:
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, routed, table, compiled, version, batch_id, latest, beat) -> None:
        before = self.clocks.before(batch_id).first()
        clock0 = before["clock"] if before else None
        state = self.runs.before(batch_id)
        reloaded = before is not None and before["version"] != version
        sec = epoch_seconds(F.col("ts"))
        wild = sec > F.lit(latest).cast("bigint") if latest is not None else F.lit(False)
        behind = F.coalesce(sec < F.lit(clock0).cast("bigint"), F.lit(False))
        wrong = wild | F.coalesce(sec < F.lit(clock0).cast("bigint") - self.lateness, F.lit(False))
        seen = routed.agg(F.max(F.when(~wild, sec)).alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"),
                          F.count_if(wild | behind).alias("moved")).first()
        only_wild = latest - self.ahead if seen["m"] is None and seen["n"] else None
        clock = max(x for x in (clock0, seen["m"], only_wild, 0) if x is not None)
        base, wall = clock, beat
        if not seen["n"] and before is not None:
            base, wall = before["base"], before["wall"] if before["wall"] is not None else beat
            if beat is not None and base is not None and wall is not None:
                clock = max(clock, base + beat - wall - self.idle_delay)
        if self.late_dir:
            routed.filter(wrong).write.mode("overwrite").parquet(f"{self.late_dir}/batch={batch_id}")
        moved = None
        if seen["moved"]:
            # such a line is kept, in the order of arrival, and shows its own time
            moved = routed.filter(wild | behind).select(
                "rule_id", F.xxhash64(F.lit(batch_id), "seq").alias("run"), F.col("ts").alias("_own"))
            routed = routed.withColumn("ts", F.when(wild, from_epoch(F.lit(clock))).when(
                behind, from_epoch(F.lit(clock0))).otherwise(F.col("ts")))
        parts = []
        if reloaded:
            parts.append(collapse.close_state(state, clock0))
            state = self.spark.createDataFrame([], collapse.STATE_SCHEMA)
        written, opened = collapse.collapse_step(routed, state, clock, self.hot_rows, self.block,
                                                 self.collapse, batch_id)
        self.runs.write(opened, batch_id)
        if moved is not None:
            own = lookup_join(written, moved, ["rule_id", "run"], "left", ["rule_id", "at", "run"])
            written = own.withColumn("ts", F.when(F.col("n") == 0, F.coalesce("_own", "ts")).otherwise(
                F.col("ts"))).drop("_own")
        written = written.persist(StorageLevel.DISK_ONLY)
        try:
            parts.append(written)
            if self.mark_interval and clock0 is not None:
                parts.append(self._marks(written, state, compiled, clock0, clock))
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p, allowMissingColumns=True)
            where = table.select("rule_id", "dest", "sink")
            out = lookup_join(out, where, ["rule_id"], "left", ["rule_id", "at", "run"])
            self.clocks.write(self.spark.createDataFrame(
                [(clock, version, seen["wrong"] or 0, base, wall)], _CLOCK), batch_id)
            if self.on_written:
                self.on_written(out, batch_id)
            # ``on_written`` alone may take the records; sinks, once there are any, must take all
            if deliver.registered() or self.dead_letter or not self.on_written:
                deliver.deliver(out, batch_id, self.dead_letter)
        finally:
            written.unpersist()

    def _marks(self, written, state, compiled, clock0, clock) -> DataFrame:
        step = self.mark_interval
        first = (clock0 // step + 1) * step
        none = self.spark.createDataFrame([], "rule_id string, at timestamp_ntz")
        last = state.select("rule_id", from_epoch(F.col("lw")).alias("at"))
        busy = none.unionByName(last).unionByName(written.select("rule_id", "at"))
        if first > clock:
            return none
        start, end = (datetime.fromtimestamp(x, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
                      for x in (first, clock))
        due = marks.marks(busy, compiled, start, end, interval=step)
        return due.select("rule_id", F.col("ts").alias("at"), "ts", "fac", "sev", "host", "msg")

    def late_lines(self) -> DataFrame:
        """All lines that came late or with a time to come, with their own times (``late_dir``)."""
        return self.spark.read.parquet(self.late_dir).drop("batch")

    def diagnostics(self, batch_id: int) -> DataFrame:
        """Late lines of a batch, as a record about ourselves."""
        late = self.clocks.at(batch_id).filter("late > 0")
        text = F.concat(F.col("late").cast("string"), F.lit(" lines came late"))
        return diagnostics.as_records(late, text, from_epoch(F.col("clock")), S.SYSLOG_INFO)

    def close(self, last_batch: int) -> DataFrame:
        """What is still pending after the last batch."""
        return collapse.close_state(self.runs.at(last_batch))


@dataclass
class LineStream:
    """Chunks of connections to lines; partial lines wait for the next batch."""

    spark: SparkSession
    state_dir: str
    on_lines: Callable[[DataFrame, int], None]
    block: int = 100_000

    def __post_init__(self):
        self.tails = BatchState(self.spark, f"{self.state_dir}/tails",
                                "conn_id string, tail string, lines bigint")

    def process(self, chunks: DataFrame, batch_id: int) -> None:
        self.tails.spark = chunks.sparkSession
        state = self.tails.before(batch_id)
        carried = state.select("conn_id", F.lit(-1).cast("bigint").alias("seq"),
                               F.col("tail").alias("chunk"))
        both = chunks.select(F.col("conn_id").cast("string").alias("conn_id"),
                             F.col("seq").cast("bigint").alias("seq"), "chunk").unionByName(carried)
        pieces = numbered_pieces(both, block=self.block)
        ends = pieces.groupBy("conn_id").agg(F.max("line_no").alias("_end"))
        known = (join_pieces(pieces).join(ends, "conn_id", "inner")
                 .join(state.select("conn_id", F.col("lines").alias("_had")), "conn_id", "left")
                 .withColumn("_had", F.coalesce("_had", F.lit(0).cast("bigint")))
                 .persist(StorageLevel.DISK_ONLY))
        try:
            self.tails.write(known.filter("line_no = _end").select(
                "conn_id", F.col("line").alias("tail"),
                (F.col("_had") + F.col("_end")).alias("lines")), batch_id)
            lines = known.filter("line_no < _end").select(
                "conn_id", (F.col("line_no") + F.col("_had")).alias("line_no"),
                F.regexp_replace("line", "\\r$", "").alias("line")).filter("line <> ''")
            self.on_lines(lines, batch_id)
        finally:
            known.unpersist()

    def close(self, last_batch: int) -> DataFrame:
        """Connections are closed: partial lines count as lines."""
        return self.tails.at(last_batch).select(
            "conn_id", F.col("lines").alias("line_no"),
            F.regexp_replace("tail", "\\r$", "").alias("line")).filter("line <> ''")


@dataclass
class ChainStream:
    """Hash chains over a stream of ``(log_id, line_no, line)``."""

    spark: SparkSession
    state_dir: str
    first_keys: DataFrame
    on_macs: Callable[[DataFrame, int], None]

    def __post_init__(self):
        self.keys = BatchState(self.spark, f"{self.state_dir}/keys",
                               "log_id string, method string, key0 binary, last_key binary")

    def process(self, lines: DataFrame, batch_id: int) -> None:
        self.keys.spark = lines.sparkSession
        keys = self.first_keys if batch_id == 0 else self.keys.before(batch_id)
        # the running key takes the place of the first one inside a batch
        now = keys.join(lines.select("log_id").distinct(), "log_id", "left_semi")
        made = integrity.protect(lines, now.withColumn("key0", F.col("last_key")))
        made = made.persist(StorageLevel.DISK_ONLY)
        try:
            self.keys.write(integrity.last_keys(made, keys), batch_id)
            self.on_macs(made.select("log_id", "line_no", "mac"), batch_id)
        finally:
            made.unpersist()
