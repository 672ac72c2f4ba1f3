"""Heartbeat records for outputs that have been idle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.functions.clock import epoch_seconds, from_epoch
from logweave.operators.rules import mark_rules


def marks(written: DataFrame, compiled: DataFrame, start: str, end: str,
          interval: int = S.MARK_SECONDS, local_host: str = "localhost",
          at: str = "at") -> DataFrame:
    """Mark records at ``start``, ``start + interval``, … up to ``end``.

    A rule that selects marks gets one unless it wrote a record less than half
    an interval before. ``written`` has ``rule_id`` and the time of writing. It
    is reduced to the distinct (rule, tick) pairs it suppresses before any
    shuffle, then anti-joined on that pair.
    """
    first, final = (epoch_seconds(F.lit(x).cast("timestamp_ntz")) for x in (start, end))
    ticks = (mark_rules(compiled).select("rule_id", *[c for c in ("dest", "sink")
                                                      if c in compiled.columns])
             .withColumn("tick", F.explode(F.sequence(
                 F.lit(0).cast("bigint"), F.floor((final - first) / interval))))
             .withColumn("_at", first + F.col("tick") * interval))
    # a record keeps the next tick silent if it is less than half an interval before it
    since = epoch_seconds(F.col(at)) - first
    tick = F.ceil(since / interval)
    busy = (written.select("rule_id", tick.cast("bigint").alias("tick"), since.alias("_since"))
            .filter(2 * (F.col("tick") * interval - F.col("_since")) < interval)
            .select("rule_id", "tick").distinct())
    info = 6
    return (ticks.join(busy, ["rule_id", "tick"], "left_anti")
            .select("rule_id", *[c for c in ("dest", "sink") if c in ticks.columns],
                    from_epoch(F.col("_at")).alias("ts"),
                    F.lit(S.MARK_FACILITY).alias("fac"), F.lit(info).alias("sev"),
                    F.lit(local_host).alias("host"), F.lit(S.MARK_TEXT).alias("msg"),
                    F.lit(True).alias("is_mark")))
