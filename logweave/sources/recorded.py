"""Recorded datagrams as a stream: one JSON object a line in files that grow, each with its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.follow import follow_lines
from logweave.sources.lines import MOST_PARTITIONS, place

#: Fixed values of the record: who recorded it and as which of its datagrams, when, from whom, what (base64).
RECORD = "partition int, offset bigint, time timestamp_ntz, peer string, data binary"
_FORMAT = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def record_datagrams(datagrams: DataFrame) -> DataFrame:
    """``value``: datagrams (partition, offset, time, peer, data) as lines for :func:`follow_datagrams`.

    Data may hold any bytes, line feeds too. What is null is left out.
    """
    kinds = [part.split() for part in RECORD.split(", ")]
    return datagrams.select(F.to_json(F.struct(*[F.col(n).cast(t).alias(n) for n, t in kinds]), _FORMAT).alias("value"))


def read_datagrams(lines: DataFrame, source: str = "net", partitions: int = MOST_PARTITIONS) -> DataFrame:
    """Raw lines from recorded lines, batch or stream: ``source, arrival_ts, peer, line, seq, damaged``.

    ``seq`` is made of the place (:func:`lines.place`): no two datagrams of different places share
    one, and it grows within a recorder. A line that is no record, or one
    without a place among ``partitions`` recorders, is not lost: it is ``damaged``, comes as it
    stands, without peer and ``seq``. A datagram without data is empty, one
    without time is stamped now.
    """
    read = F.from_json("line", RECORD + ", _bad string", {**_FORMAT, "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.select(F.col("line").alias("_line"), read.alias("_r"))
    seq = place(F.col("_r.partition"), F.col("_r.offset"), partitions)
    good = F.col("_r._bad").isNull() & seq.isNotNull()
    return parsed.select(
        F.lit(source).alias("source"),
        F.coalesce(F.when(good, F.col("_r.time")), F.current_timestamp().cast("timestamp_ntz")).alias("arrival_ts"),
        F.when(good, F.col("_r.peer")).alias("peer"),
        F.when(good, F.coalesce(F.col("_r.data").cast("string"), F.lit(""))).otherwise(F.col("_line")).alias("line"),
        F.when(good, seq).alias("seq"), (~good).alias("damaged"))


def follow_datagrams(spark: SparkSession, path: str, source: str = "net", partitions: int = MOST_PARTITIONS,
                     **options) -> DataFrame:
    """A stream of the datagrams that recorders append to files; nothing listens here.

    Files, rotation and restarts are those of :func:`follow.follow_lines`, whose
    ``options`` these are: each recorded line comes once, one half written waits
    for its end, and long files are cut into stretches for several tasks.
    """
    return read_datagrams(follow_lines(spark, path, **options), source, partitions)
