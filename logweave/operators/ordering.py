"""Ordered work on groups of any size.

Many jobs need the previous line of an output, or a running number, while one
output may hold most of the data. A window over the output alone would put it
into one task. Here every group is cut into chunks that are contiguous in the
order ``(second, seq)`` and bounded in size; windows run inside chunks, and
only a row or two per chunk are looked at across chunks.

A chunk is a day of a group. A day with more than ``hot_rows`` rows is cut into
hours, such an hour into seconds, and such a second at quantiles of its
sequence numbers, into parts of about ``block`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.clock import epoch_seconds
from logweave.operators.joins import lookup_join
from logweave.session import freeze

HOT_ROWS = 1_000_000
BLOCK = 1_000_000
CHUNK = ("_day", "_hour", "_slot", "_block")


def _timed(df: DataFrame, ts: str) -> DataFrame:
    return (df.withColumn("_sec", epoch_seconds(F.col(ts)))
            .withColumn("_h", F.floor(F.col("_sec") / 3600)))


def count_hours(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows per group and hour, ``(keys, _h, count)``, as :func:`add_chunks` takes them."""
    return freeze(_timed(df, ts).groupBy(*keys, "_h").count())


def _hot_hours(hours: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Hours of days that are too large, and whether the hour is so itself."""
    per_day = Window.partitionBy(*keys, F.floor(F.col("_h") / 24))
    return (hours.withColumn("_d", F.sum("count").over(per_day))
            .filter(F.col("_d") > hot_rows)
            .select(*keys, "_h", (F.col("count") > hot_rows).alias("_hot")))


def add_chunks(df: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str = "seq",
               hot_rows: int = HOT_ROWS, block: int = BLOCK,
               hours: DataFrame | None = None) -> DataFrame:
    """Add ``_sec`` and the chunk columns.

    Costs one counting pass over the input, combined map-side to a row per task
    and hour, unless ``hours`` (keys, ``_h``, ``count``) is already known.
    """
    keys = list(keys)
    timed = _timed(df, ts)
    if hours is None:
        hours = timed.groupBy(*keys, "_h").count()
    hot = freeze(_hot_hours(hours, keys, hot_rows))
    whole = F.lit(-1).cast("bigint")
    if hot.isEmpty():
        by_hour: Column = F.lit(False)
        by_second: Column = F.lit(False)
        block_of: Column = whole
    else:
        timed = lookup_join(timed, hot, [*keys, "_h"], "left", spread=[seq])
        by_hour = F.col("_hot").isNotNull()
        by_second = F.coalesce("_hot", F.lit(False))
        cuts = freeze(_cut_seconds(timed.filter("_hot"), keys, seq, hot_rows, block))
        block_of = whole
        if not cuts.isEmpty():
            timed = lookup_join(timed, cuts, [*keys, "_sec"], "left", spread=[seq])
            block_of = F.when(F.col("_cuts").isNotNull() & by_second, F.size(F.filter(
                "_cuts", lambda c: c <= F.col(seq))).cast("bigint")).otherwise(whole)
    return (timed.withColumn("_block", block_of)
            .withColumn("_day", F.floor(F.col("_h") / 24))
            .withColumn("_hour", F.when(by_hour, F.col("_h")).otherwise(whole))
            .withColumn("_slot", F.when(by_second, F.col("_sec")).otherwise(whole))
            .drop("_hot", "_h", "_cuts"))


def _cut_seconds(rows: DataFrame, keys: Sequence[str], seq: str, hot_rows: int, block: int) -> DataFrame:
    """Seconds with more than ``hot_rows`` rows, and the numbers that cut them into parts of about ``block``.

    The cuts are quantiles of the numbers that occur, so parts are filled
    whatever gaps the numbers have.
    """
    counted = rows.groupBy(*keys, "_sec").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    large = freeze(counted)
    if large.isEmpty():
        return large.select(*keys, "_sec", F.array().cast("array<bigint>").alias("_cuts"))
    inside = lookup_join(rows, large.select(*keys, "_sec"), [*keys, "_sec"], "inner", spread=[seq])
    share = [i / 100 for i in range(1, 100)]
    spots = inside.groupBy(*keys, "_sec").agg(F.percentile_approx(seq, share, 10_000).alias("_p"))
    parts = F.least(F.ceil(F.col("_n") / block), F.lit(100))
    places = F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1)).cast("int"))
    picked = F.transform(places, lambda i: F.get("_p", F.floor(i * 100 / parts).cast("int") - 1).cast("bigint"))
    return spots.join(large, [*keys, "_sec"]).select(*keys, "_sec", F.array_distinct(picked).alias("_cuts"))


def in_chunk(keys: Sequence[str], seq: str = "seq"):
    """Window over one chunk of a group, in order."""
    return Window.partitionBy(*keys, *CHUNK).orderBy("_sec", seq)


def across_chunks(keys: Sequence[str]):
    """Window over the chunks of a group, in order; for summary rows only."""
    return Window.partitionBy(*keys).orderBy(*CHUNK)


def join_chunks(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring chunk summaries back to the rows, which are already clustered by chunk."""
    return rows.join(summary, [*keys, *CHUNK], "inner")


def number_rows(df: DataFrame, keys: Sequence[str] = (), name: str = "row_no",
                ts: str = "ts", seq: str = "seq", hot_rows: int = HOT_ROWS,
                block: int = BLOCK) -> DataFrame:
    """Dense row numbers 1, 2, … in the order ``(second, seq)`` within ``keys``.

    Counts per chunk give offsets, ``row_number`` runs inside chunks: there is
    no global sort, also when there are no keys. The counts come from the
    hours counted anyway; only where a day is too large are its rows counted
    by chunk.
    """
    keys = list(keys)
    group = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    hours = count_hours(base, group, ts)
    chunked = add_chunks(base, group, ts, seq, hot_rows, block, hours)
    whole = F.lit(-1).cast("bigint")
    days = (hours.groupBy(*group, F.floor(F.col("_h") / 24).alias("_day"))
            .agg(F.sum("count").alias("count")))
    large = freeze(days.filter(F.col("count") > hot_rows))
    sizes = days.filter(F.col("count") <= hot_rows).select(
        *group, "_day", *[whole.alias(c) for c in CHUNK[1:]], "count")
    if not large.isEmpty():
        sizes = sizes.unionByName(chunked.filter("_hour <> -1").groupBy(*group, *CHUNK).count())
    before = across_chunks(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
               .drop("count"))
    numbered = chunked.withColumn("_in", F.row_number().over(in_chunk(group, seq)))
    return (join_chunks(numbered, offsets, group)
            .withColumn(name, F.col("_in") + F.col("_before"))
            .drop("_all", "_in", "_before", "_sec", *CHUNK))


def running_total(df: DataFrame, keys: Sequence[str], value: Column, name: str,
                  seq: str = "seq", block: int = 100_000) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a group (exclusive), by ``seq``.

    Blocks of sequence numbers take the place of time chunks.
    """
    keys = list(keys)
    rows = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(seq) / block))
    inner = (Window.partitionBy(*keys, "_block").orderBy(seq)
             .rowsBetween(Window.unboundedPreceding, -1))
    outer = (Window.partitionBy(*keys).orderBy("_block")
             .rowsBetween(Window.unboundedPreceding, -1))
    sums = (rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_s"))
            .withColumn("_before", F.coalesce(F.sum("_s").over(outer), F.lit(0))).drop("_s"))
    zero = F.lit(0)
    return (rows.withColumn("_in", F.coalesce(F.sum("_v").over(inner), zero))
            .join(sums, [*keys, "_block"], "inner")
            .withColumn(name, (F.col("_in") + F.col("_before")).cast("bigint"))
            .drop("_v", "_in", "_before", "_block"))


def carry_forward(df: DataFrame, keys: Sequence[str], column: str, name: str,
                  seq: str, block: int = 10_000) -> DataFrame:
    """Last non-null ``column`` at or before each row of a group, by ``seq``."""
    keys = list(keys)
    rows = df.withColumn("_block", F.floor(F.col(seq) / block))
    inner = (Window.partitionBy(*keys, "_block").orderBy(seq)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outer = (Window.partitionBy(*keys).orderBy("_block")
             .rowsBetween(Window.unboundedPreceding, -1))
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(seq), F.col(column).alias("_x")))
    ends = (rows.groupBy(*keys, "_block").agg(F.max(known).alias("_end"))
            .withColumn("_before", F.last("_end", ignorenulls=True).over(outer)["_x"])
            .drop("_end"))
    return (rows.withColumn("_in", F.last(column, ignorenulls=True).over(inner))
            .join(ends, [*keys, "_block"], "inner")
            .withColumn(name, F.coalesce("_in", "_before"))
            .drop("_in", "_before", "_block"))
