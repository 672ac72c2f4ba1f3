"""Log tables laid out so that lookups by host, start of message and time read little.

Inside a date, rows lie along a space-filling curve over the ranks of host,
message and time, so a file or row group holds a small box of all three and
its statistics rule it out for most lookups. Hosts have Bloom filters besides.
:func:`render.lookup` reads these tables like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.once import once
from logweave.sinks import render

#: Columns of a log table that make up the curve, from the lowest bit on. A lookup by one of k columns
#: reads about the k-th root of the row groups of a date; leave out what is never asked for.
AXES = ("time", "message", "host")
#: Bits of each axis: a date is cut into at most 2 ** (BITS * axes) boxes.
BITS = 5
#: Expected rows of the sample from which ranks are made; decides the layout only, never the rows.
SAMPLE_ROWS = 16_384
#: Characters of a value that count for its rank and for statistics.
PREFIX = 64
ROWS_PER_FILE = 1_000_000
GROUP_BYTES = 16 << 20
#: Rows of a page: inside a row group, pages are ruled out by their statistics.
PAGE_ROWS = 2_000


def rank(value: Column, bounds: Sequence[str]) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``; 0 for null. A search by halves."""
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(bounds[middle]), search(low, middle)).otherwise(search(middle + 1, high))
    return F.when(value.isNull(), F.lit(0)).otherwise(search(0, len(bounds)))


def interleave(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """The place on the curve: the bits of all ranks in turn."""
    place = F.lit(0)
    for bit in range(bits):
        for axis, r in enumerate(ranks):
            one = F.shiftright(r, bit).bitwiseAND(F.lit(1))
            place = place.bitwiseOR(F.shiftleft(one, bit * len(ranks) + axis))
    return place


def _quantiles(values: list[str], parts: int) -> list[str]:
    """At most ``parts`` - 1 different values that cut the sorted ``values`` into equal parts."""
    values = sorted(values, key=lambda v: v.encode("utf-8", "replace"))
    cuts = [values[len(values) * k // parts] for k in range(1, parts)] if values else []
    return list(dict.fromkeys(cuts))


def clustered(log_rows: DataFrame, files: int, bounds: dict[str, list[str]], tie: str) -> DataFrame:
    """``log_rows`` in ``files`` ranges of (date, place on the curve), sorted inside.

    Ranges are cut within equal places too, down to ``tie``, so that a
    host or message with most of the rows is spread over files.
    """
    ranks = {f"_r{k}": rank(F.substring(c, 1, PREFIX), cuts) for k, (c, cuts) in enumerate(bounds.items())}
    placed = once(log_rows, ranks, log_rows.columns)
    placed = placed.withColumn("_z", interleave([F.col(name) for name in ranks]))
    order = ["date", "_z", "host", "message", "time", tie]
    return placed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_z", *ranks)


def write_indexed_log_table(routed: DataFrame, path: str, mode: str = "append", batch_id: int | None = None,
                            rows_per_file: int = ROWS_PER_FILE, group_bytes: int = GROUP_BYTES,
                            page_rows: int = PAGE_ROWS, sample_rows: int = SAMPLE_ROWS,
                            axes: Sequence[str] = AXES, **kw) -> None:
    """Log table as Parquet by date, for lookups by host, start of message and time.

    Like ``deliver.write_log_table``, whose rows it writes, with one shuffle
    by ranges more and two light passes before it (a count and a sample of
    about ``sample_rows`` rows, which comes to the driver). With ``batch_id`` a batch has a folder of its
    own, which a repeated run replaces. Null hosts and messages come first; equal
    rows are all kept; an empty table gives an empty folder. ``kw`` goes to ``render.to_log_table``.
    """
    where = path if batch_id is None else f"{path}/batch={batch_id}"
    # rows that are equal in a log table are told apart by what they were before
    tie = F.col("seq") if "seq" in routed.columns else F.xxhash64(*routed.columns)
    name = "_tie"
    rows = render.to_log_table(routed.withColumn(name, tie.cast("bigint")), keep=(name,), **kw)
    n = rows.count()
    seen = (rows.select(*[F.substring(c, 1, PREFIX).alias(c) for c in axes])
            .sample(min(1.0, sample_rows / max(n, 1)), seed=7).limit(4 * sample_rows).collect())
    bounds = {c: _quantiles([r[c] for r in seen if r[c] is not None], 1 << BITS) for c in axes}
    files = max(1, math.ceil(n / rows_per_file))
    (clustered(rows, files, bounds, name).drop(name).write
     .mode(mode if batch_id is None else "overwrite").partitionBy("date")
     .option("parquet.block.size", group_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .option("parquet.statistics.truncate.length", PREFIX)
     .option("parquet.columnindex.truncate.length", PREFIX)
     .option("parquet.bloom.filter.enabled#host", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true")
     .parquet(where))
