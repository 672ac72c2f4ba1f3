"""Keyed hash chains over logs: protect, verify, find the first bad line.

For each line of a log, in order, the key becomes the digest of the key and
the line; only the first and the last key are kept. The chain of one log is
sequential by its purpose, so the logs are what runs in parallel. Keys, stored
digests and lines are sorted together and streamed through the task, which
carries one key: a log of any length takes constant memory. Choose ``log_id``
fine enough (:func:`chain_id`: destination, host and day) to spread the work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import clock

# Digest names of the chain and of the digest library.
METHODS = {"md5": "md5", "rmd160": "ripemd160", "sha1": "sha1"}
DEFAULT_METHOD = "sha1"


def _hasher(method: str):
    name = METHODS.get((method or DEFAULT_METHOD).lower())
    if name is None:
        raise ValueError(f"unknown digest method {method!r}, use one of {sorted(METHODS)}")
    try:
        hashlib.new(name)
    except ValueError as e:
        raise RuntimeError(f"this Python has no {name}; the chain cannot be computed") from e
    return lambda data: hashlib.new(name, data).digest()


def keyed_digest(method: str, key: bytes, data: bytes) -> bytes:
    """Digest of the XOR of ``key`` and ``data``.

    The shorter one is repeated over the length of the longer one rounded up
    to a multiple of the shorter, and the longer one wraps around likewise.
    """
    h = _hasher(method)
    if not key or not data:
        return h(key or data or b"\0")
    small, large = sorted((len(key), len(data)))
    size = -(-large // small) * small
    a, b = ((x * -(-size // len(x)))[:size] for x in (key, data))
    return h((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(size, "big"))


def line_digest(key: bytes, data: bytes) -> bytes:
    """Digest stored per line to find the corrupted one."""
    return keyed_digest("rmd160", keyed_digest("sha1", key, data), data)


def chain_id(*parts: Column) -> Column:
    """Name of a chain from its parts, for example destination, host and day."""
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def segments(lines: DataFrame, every: int) -> DataFrame:
    """Cut each log into chains of ``every`` lines: ``log_id`` gets ``|0``, ``|1``, ….

    One log that holds most lines would otherwise be one sequential task. Each
    segment has its own row in the key table, so a missing segment is found
    like a missing line.
    """
    part = F.floor(F.col("line_no") / every)
    return lines.withColumn("log_id", chain_id(F.col("log_id"), part))


def chain_lines(routed: DataFrame) -> DataFrame:
    """Lines as protected: ``Mon dd HH:MM:SS host message``."""
    return routed.withColumn("line", F.concat(
        clock.header_time(F.col("ts")), F.lit(" "), F.col("host"), F.lit(" "), F.col("msg")))


def init_keys(logs: DataFrame, seed: str = "seed") -> DataFrame:
    """First keys: the digest of each log's seed, by its method.

    ``logs`` is ``(log_id, method, seed)``. The seed is a column (twenty random
    bytes in use) so that runs can be repeated.
    """
    @F.pandas_udf("binary")
    def first_key(method: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([keyed_digest(m, b"", bytes(d)) for m, d in zip(method, data)])

    method = F.lower(F.coalesce(F.col("method"), F.lit(DEFAULT_METHOD)))
    return (logs.select("log_id", method.alias("method"), F.col(seed).alias("_seed"))
            .withColumn("key0", first_key("method", "_seed"))
            .select("log_id", "method", "key0", F.col("key0").alias("last_key")))


_KEY, _MAC, _LINE = 0, 1, 2


def _events(lines: DataFrame, keys: DataFrame, macs: DataFrame | None = None) -> DataFrame:
    """Keys, stored digests and lines of each log in one sorted table."""
    none = F.lit(None).cast("binary")
    table = keys.select("log_id", F.lit(-1).cast("bigint").alias("line_no"), F.lit(_KEY).alias("kind"),
                        "method", F.col("key0").alias("data"), F.col("last_key").alias("last_key"))
    text = F.col("line").cast("binary")
    table = table.unionByName(lines.select(
        "log_id", F.col("line_no").cast("bigint").alias("line_no"), F.lit(_LINE).alias("kind"),
        F.lit(None).cast("string").alias("method"), text.alias("data"), none.alias("last_key")))
    if macs is not None:
        table = table.unionByName(macs.select(
            "log_id", F.col("line_no").cast("bigint").alias("line_no"), F.lit(_MAC).alias("kind"),
            F.lit(None).cast("string").alias("method"), F.col("mac").alias("data"),
            none.alias("last_key")))
    return (table.repartition("log_id")
            .sortWithinPartitions("log_id", "line_no", "kind"))


def _protect_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    log, method, key = None, None, None
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.kind == _KEY:
                log, method, key = r.log_id, r.method, bytes(r.data)
                continue
            if r.log_id != log:
                raise ValueError(f"log {r.log_id!r} has no first key")
            data = bytes(r.data) if r.data is not None else b""
            inner = keyed_digest("sha1", key, data)
            mac = keyed_digest("rmd160", inner, data)
            key = keyed_digest(method, key, data)
            out.append((r.log_id, r.line_no, mac, key, inner))
        yield pd.DataFrame(out, columns=["log_id", "line_no", "mac", "key", "inner"])


def protect(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """``(log_id, line_no, mac, key, inner)``: digest and running key after each line.

    ``lines`` is ``(log_id, line_no, line)``, ``keys`` as from
    :func:`init_keys`. Store ``mac``; of ``key`` keep :func:`last_keys` only.
    ``inner`` is the keyed sha1 that ``mac`` is made from; it is not stored.
    A null line counts as an empty one, here and in :func:`verify`; a null digest never fits.
    """
    return _events(lines, keys).drop("last_key").mapInPandas(
        _protect_batches, "log_id string, line_no bigint, mac binary, key binary, inner binary")


def last_keys(protected: DataFrame, keys: DataFrame) -> DataFrame:
    """The key table after protecting: last key per log, combined map-side."""
    last = (protected.groupBy("log_id")
            .agg(F.max(F.struct("line_no", "key")).alias("_l"))
            .select("log_id", F.col("_l.key").alias("_k")))
    return (keys.join(last, "log_id", "left")
            .select("log_id", "method", "key0",
                    F.coalesce("_k", "last_key").alias("last_key")))


_VERDICT = "log_id string, status int, bad_line bigint, lines bigint"


def _verifier(with_macs: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log = method = key = last = mac = None
        bad, count, broken = None, 0, False

        def verdict():
            ok = not broken and bad is None and key == last
            return (log, 0 if ok else 1, bad, count)

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.log_id != log:
                    if log is not None:
                        out.append(verdict())
                    log, method, key, last, mac = r.log_id, None, None, None, None
                    bad, count, broken = None, 0, r.kind != _KEY
                if r.kind == _KEY:
                    method = r.method
                    key = bytes(r.data) if r.data is not None else b""
                    last = bytes(r.last_key) if r.last_key is not None else b""
                    broken = not key or not last or len(key) != len(last)
                elif r.kind == _MAC:
                    mac = (r.line_no, bytes(r.data) if r.data is not None else None)
                else:
                    count += 1
                    if broken or bad is not None:
                        continue
                    data = bytes(r.data) if r.data is not None else b""
                    if with_macs and (mac is None or mac[0] != r.line_no
                                      or mac[1] != line_digest(key, data)):
                        bad = int(r.line_no)
                        continue
                    key = keyed_digest(method, key, data)
            yield _frame(out)
        if log is not None:
            yield _frame([verdict()])

    def _frame(rows):
        pdf = pd.DataFrame(rows, columns=["log_id", "status", "bad_line", "lines"])
        return pdf.astype({"bad_line": "Int64", "status": "int32", "lines": "int64"})

    return run


def verify(lines: DataFrame, keys: DataFrame, macs: DataFrame | None = None) -> DataFrame:
    """One verdict per log: ``status`` 0 for intact, 1 for corrupted.

    With the stored digests ``bad_line`` names the first line that differs; it
    stays null when only the end is missing. Broken or missing keys count as
    corrupted.
    """
    return _events(lines, keys, macs).mapInPandas(_verifier(macs is not None), _VERDICT)


def first_corrupt_line(lines: DataFrame, keys: DataFrame, macs: DataFrame) -> DataFrame:
    """First corrupted line of each log that has one."""
    return verify(lines, keys, macs).filter("bad_line IS NOT NULL").select("log_id", "bad_line")


def _part(line_no: str, every: int):
    return F.floor((F.col(line_no) - 1) / every).cast("bigint")


def checkpoint_keys(protected: DataFrame, every: int) -> DataFrame:
    """``(log_id, part, key)``: the running key after each part of ``every`` line numbers that has lines.

    With them a chain can be verified in parts (:func:`verify_parts`). Whoever holds such a key can forge
    what follows it, so keep them where first and last keys are kept, not beside the log.
    """
    last = F.max(F.struct("line_no", "key")).alias("_l")
    return (protected.withColumn("part", _part("line_no", every)).groupBy("log_id", "part").agg(last)
            .select("log_id", "part", F.col("_l.key").alias("key")))


def verify_parts(lines: DataFrame, keys: DataFrame, checkpoints: DataFrame, every: int,
                 macs: DataFrame | None = None) -> DataFrame:
    """The verdicts of :func:`verify`, with the parts of each chain verified side by side.

    A part begins with the key that the part before it ended with, and must end
    with its own; the last one must end with the last key. A log is as good as its first bad
    part. If that names no line, lines are missing at its end, and the first
    line after it is the first that does not fit. ``every`` is that of the checkpoints.
    """
    name = F.to_json(F.struct("log_id", "part"))
    order = Window.partitionBy("log_id").orderBy("part")
    sealed = F.length("key0") > 0
    whole = keys.withColumn("_whole", F.coalesce(sealed & (F.length("key0") == F.length("last_key")), F.lit(False)))
    # a row per part of a log, some for each task's worth of lines
    given = (checkpoints.withColumn("_before", F.lag("key").over(order)).withColumn("_next", F.lead("part").over(order))
             .join(whole, "log_id")
             .select(name.alias("_sid"), "method", F.coalesce("_before", "key0").alias("key0"),
                     F.when(F.col("_next").isNull(), F.col("last_key")).otherwise(F.col("key")).alias("last_key")))
    # without any part the chain is empty: its last key is its first one
    none = whole.join(checkpoints.select("log_id").distinct(), "log_id", "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    given = given.unionByName(none.select(name.alias("_sid"), "method", "key0", "last_key")).withColumnRenamed("_sid", "log_id")
    cut = lines.withColumn("part", _part("line_no", every))
    digests = None
    if macs is not None:
        digests = macs.withColumn("part", _part("line_no", every)).select(name.alias("log_id"), "line_no", "mac").join(
            given.select("log_id"), "log_id", "left_semi")
    found = verify(cut.select(name.alias("log_id"), "line_no", "line"), given, digests)
    ident = F.from_json("log_id", "log_id string, part bigint")
    firsts = cut.groupBy("log_id", "part").agg(F.min("line_no").alias("_first"))
    parts = (found.select(ident["log_id"].alias("log_id"), ident["part"].alias("part"), "status", "bad_line", "lines")
             .join(firsts, ["log_id", "part"], "left"))
    known = given.select(ident["log_id"].alias("log_id"), ident["part"].alias("part"), F.lit(True).alias("_known"))
    parts = parts.join(known, ["log_id", "part"], "left")
    bad = F.min(F.when(F.col("status") != 0, F.struct("part", "bad_line", "_first", "_known"))).alias("_b")
    logs = parts.groupBy("log_id").agg(F.sum("lines").alias("lines"), bad)
    after = (parts.join(logs.select("log_id", F.col("_b.part").alias("_p")), "log_id").filter("part > _p")
             .groupBy("log_id").agg(F.min("_first").alias("_after")))
    stray = F.when(F.col("_b._known").isNull(), F.col("_b._first"))  # lines where the chain has none
    first_bad = F.coalesce("_b.bad_line", stray, "_after") if macs is not None else F.lit(None).cast("bigint")
    sound = whole.select("log_id", "_whole")
    return (logs.join(after, "log_id", "left").join(sound, "log_id", "left")
            .select("log_id", F.when(F.coalesce("_whole", F.lit(False)) & F.col("_b").isNull(), 0).otherwise(1).alias("status"),
                    F.when(F.coalesce("_whole", F.lit(False)), first_bad).alias("bad_line"), "lines"))
