"""Sources of raw lines. All return frames for :func:`operators.parse.parse_lines`.

Columns a source may add to ``raw_lines``: ``pri`` (PRI known from outside the
text), ``trusted`` (own file or kernel: no escaping, kernel facility kept) and
``stamped`` (false when the line carries no header time by construction).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.functions import clock, codes, text


#: Partitions that fit beside an offset unless told otherwise.
MOST_PARTITIONS = 65_536


def place(partition: Column, offset: Column, partitions: int = MOST_PARTITIONS) -> Column:
    """One number for an offset in one of ``partitions``: unique over them, growing within each; else null."""
    fits = partition.between(0, partitions - 1) & offset.between(0, (1 << 63) // partitions - 1)
    return F.when(fits, offset.cast("bigint") * partitions + partition)


def read_log_files(spark: SparkSession, path, program: str | None = None, *,
                   time_format: str | None = None, start: int = 0,
                   time_length: int | None = None, stream: bool = False,
                   arrival_ts: str | None = None, max_files_per_trigger: int = 1000) -> DataFrame:
    """Lines of log files, batch or stream; ``path`` may be a folder or pattern.

    ``program`` names the lines, otherwise the file path does. ``seq`` grows
    within a file and is unique within one read; a stream gets it batch by batch.
    """
    if stream:
        raw = (spark.readStream.format("text")
               .option("maxFilesPerTrigger", max_files_per_trigger).load(path))
    else:
        raw = spark.read.text(path)
    name = F.lit(program) if program else F.col("_metadata.file_path")
    arrival = F.lit(arrival_ts).cast("timestamp_ntz") if arrival_ts \
        else F.col("_metadata.file_modification_time").cast("timestamp_ntz")
    lines = raw.select(name.alias("source"), arrival.alias("arrival_ts"),
                       F.col("value").alias("line"))
    if not stream:
        lines = with_seq(lines)
    return file_lines(lines, time_format, start, time_length)


def with_seq(lines: DataFrame) -> DataFrame:
    """Number the rows of a batch in reading order, where there is no ``seq`` yet."""
    if "seq" in lines.columns:
        return lines
    return lines.withColumn("seq", F.monotonically_increasing_id())


def file_lines(lines: DataFrame, time_format: str | None = None, start: int = 0,
               time_length: int | None = None) -> DataFrame:
    """File lines ``(source, line, …)`` prefixed ``source:``, with their PRI.

    With ``time_format`` (a Spark pattern) the time at character ``start`` is
    cut out and put in front as a standard header; a line without a valid time
    there is stamped on arrival.
    """
    line = F.col("line")
    if time_format is None:
        return (lines.withColumn("pri", codes.decode_pri(line, S.KERN_CRIT))
                .withColumn("pri", F.when(F.startswith(line, F.lit("<")), F.col("pri"))
                            .otherwise(S.KERN_CRIT))
                .withColumn("line", F.concat("source", F.lit(":"), codes.strip_pri(line)))
                .withColumn("trusted", F.lit(True)).withColumn("stamped", F.lit(False)))
    if time_length is None and re.search(r"['zZVOXEaGQ\[]|M{3}", time_format):
        raise ValueError("time_length is needed: texts of this format may differ in length from it")
    size = time_length or len(time_format)
    found = F.try_to_timestamp(F.substring(line, start + 1, size),
                               F.lit(time_format)).cast("timestamp_ntz")
    rest = F.concat(F.substring(line, 1, start), F.substr(line, F.lit(start + size + 1)))
    named = F.concat("source", F.lit(":"), F.when(F.col("_t").isNull(), line).otherwise(rest))
    return (lines.withColumn("_t", found)
            .withColumn("line", F.when(F.col("_t").isNull(), named).otherwise(
                F.concat(clock.header_time(F.col("_t")), F.lit(" "), named)))
            .withColumn("pri", F.lit(S.KERN_CRIT)).withColumn("trusted", F.lit(True))
            .withColumn("stamped", F.col("_t").isNotNull()).drop("_t"))


def kernel_lines(lines: DataFrame, style: str = "linux", kernel_name: str = "/kernel") -> DataFrame:
    """Kernel log lines; always stamped on arrival.

    ``linux``: a one-digit ``<n>``, otherwise warning, text ``kernel: …``.
    ``bsd``: any PRI, otherwise kern.crit, text ``<kernel_name>: …``.
    """
    line = F.col("line")
    if style == "linux":
        level = F.regexp_extract(line, "^<([0-9])>", 1)
        pri = F.when(level == "", F.lit(4)).otherwise(level.try_cast("int"))
        body, head = F.regexp_replace(line, "^<[0-9]>", ""), "kernel: "
    elif style == "bsd":
        pri = F.when(F.startswith(line, F.lit("<")),
                     codes.decode_pri(line, S.KERN_CRIT)).otherwise(S.KERN_CRIT)
        body, head = codes.strip_pri(line), kernel_name + ": "
    else:
        raise ValueError(f"unknown kernel style {style!r}")
    return (lines.withColumn("pri", pri).withColumn("line", F.concat(F.lit(head), body))
            .withColumn("is_kernel", F.lit(True)).withColumn("trusted", F.lit(True))
            .withColumn("stamped", F.lit(False)))


def device_lines(lines: DataFrame) -> DataFrame:
    """Device lines whose PRI came separately: a ``<n>`` in the text goes."""
    return lines.withColumn("line", codes.strip_device_head(F.col("line")))


def from_stream(df: DataFrame, value: str = "value", peer: str | None = "peer",
                source: str = "stream", partitions: int | None = None) -> DataFrame:
    """One datagram, one record: any frame with a value and, maybe, a peer.

    Kafka's ``value`` and ``timestamp`` are taken as they are. An ``offset`` is
    the ``seq`` where there are no partitions; offsets of several partitions or
    topics repeat, so there a batch numbers its rows itself, as it does
    without an offset: the reader keeps a partition's rows in order. With
    ``partitions``, for a frame of one topic, ``seq`` is made of offset and
    partition, in batches and streams alike (:func:`place`); a row without
    such a place is an error.
    """
    arrival = F.col("timestamp") if "timestamp" in df.columns else F.current_timestamp()
    given = F.col(peer) if peer and peer in df.columns else F.lit(None)
    cols = [F.lit(source).alias("source"), arrival.cast("timestamp_ntz").alias("arrival_ts"),
            given.cast("string").alias("peer"), F.col(value).cast("string").alias("line")]
    if partitions is not None:
        wrong = F.raise_error(F.lit(f"a row has no offset in a partition below {partitions}")).cast("bigint")
        cols.append(F.coalesce(place(F.col("partition"), F.col("offset"), partitions), wrong).alias("seq"))
    elif "offset" in df.columns and "partition" not in df.columns:
        cols.append(F.col("offset").cast("bigint").alias("seq"))
    made = df.select(*cols)
    return made if df.isStreaming else with_seq(made)


def merge_sources(*frames: DataFrame) -> DataFrame:
    """All sources as one; missing columns are null, ``seq`` stays unique and ordered."""
    count = len(frames)
    spaced = [f.withColumn("seq", F.col("seq") * count + i) if "seq" in f.columns else f
              for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), spaced)


_SOURCES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_source(name: str, fn: Callable[[SparkSession], DataFrame]) -> None:
    """Add a source of raw lines under a name."""
    _SOURCES[name] = fn


def open_source(spark: SparkSession, name: str) -> DataFrame:
    return _SOURCES[name](spark)
