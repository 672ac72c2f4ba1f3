"""Routing: every record to every rule that takes it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, SALTS, fits_broadcast
from logweave.operators.rules import DEAD_MASK
from logweave.session import freeze

_TARGET = ("rule_id", "dest", "sink")


def rule_index(compiled: DataFrame) -> DataFrame:
    """One row per rule, facility and severity it takes: the rules turned around."""
    cols = [c for c in _TARGET if c in compiled.columns]
    sevs = F.filter(F.sequence(F.lit(0), F.lit(7)),
                    lambda s: F.col("mask").bitwiseAND(
                        F.call_function("shiftleft", F.lit(1), s)) != 0)
    return (compiled.select("program", *cols, F.posexplode("masks").alias("fac", "mask"))
            .filter(F.col("mask") != DEAD_MASK)
            .select("fac", F.explode(sevs).alias("sev"), "program", *cols))


def _candidates(records: DataFrame, index: DataFrame, keys: list[str], name: str) -> DataFrame:
    cols = [c for c in index.columns if c not in ("fac", "sev", "program")]
    lists = (index.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias(name)))
    if "program" in keys:
        lists = lists.withColumnRenamed("program", "prog")
        keys = ["fac", "sev", "prog"]
    return records.join(F.broadcast(lists), keys, "left")


def _matched(records: DataFrame, index: DataFrame) -> tuple[DataFrame, list[str]]:
    """Records with ``_hits``, the list of rules taking each of them."""
    cols = [c for c in index.columns if c not in ("fac", "sev", "program")]
    no_hits = F.array().cast(index.select(F.array(F.struct(*cols))).schema[0].dataType)
    hits = [no_hits]
    for part, keys, name in ((index.filter("program IS NULL"), ["fac", "sev"], "_any"),
                             (index.filter("program IS NOT NULL"), ["fac", "sev", "program"],
                              "_own")):
        if not part.isEmpty():
            records = _candidates(records, part, keys, name)
            hits.append(F.coalesce(F.col(name), no_hits))
    return records.withColumn("_hits", F.concat(*hits)).drop("_any", "_own"), cols


def _spread(records: DataFrame) -> list[str]:
    """Columns whose hash tells records apart, for salting."""
    return [c for c in ("source", "seq", "host", "msg") if c in records.columns] or records.columns


def route(records: DataFrame, compiled: DataFrame, max_rows: int = BROADCAST_ROWS,
          max_bytes: int = BROADCAST_BYTES, salts: int = SALTS, few_records: bool = False) -> DataFrame:
    """Records with ``rule_id``, ``dest`` and ``sink`` of each rule that takes them.

    The rules, turned around into lists per (facility, severity) and per
    (facility, severity, program), are broadcast when measured to be small: no
    record is compared with a rule it cannot match and records are not
    shuffled. A larger rule set is joined by a shuffle on (facility, severity,
    program or none) and a salt, since a few of these keys may hold most records.
    With ``few_records`` the records are measured first and, if they are small,
    broadcast to the rules, which then are neither written nor shuffled.
    """
    few = few_records and fits_broadcast(records, max_rows, max_bytes)
    index = rule_index(compiled) if few else freeze(rule_index(compiled))
    if not few and fits_broadcast(index, max_rows, max_bytes):
        found, cols = _matched(records, index)
        return (found.withColumn("_hit", F.explode("_hits"))
                .select(*records.columns, *[F.col(f"_hit.{c}").alias(c) for c in cols]))
    # a rule with a program and one without have different keys, so a record asks for both
    own = F.concat(F.lit("="), F.col("prog"))
    left = records.withColumn("_key", F.explode(F.array_compact(F.array(F.lit(""), own))))
    right = (index.withColumn("_rkey", F.coalesce(F.concat(F.lit("="), "program"), F.lit("")))
             .withColumnsRenamed({"fac": "_fac", "sev": "_sev"}).drop("program"))
    on = (left["fac"] == right["_fac"]) & (left["sev"] == right["_sev"]) & (left["_key"] == right["_rkey"])
    if few:
        return F.broadcast(left).join(right, on, "inner").drop("_key", "_rkey", "_fac", "_sev")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*_spread(records)), F.lit(salts)).cast("int"))
    right = right.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = on & (left["_salt"] == right["_rsalt"])
    return left.join(right, on, "inner").drop("_salt", "_rsalt", "_key", "_rkey", "_fac", "_sev")


def route_totals(records: DataFrame, compiled: DataFrame, sums: dict[str, str] | None = None,
                 by: Sequence[str] = ("rule_id",), count: str | None = "n", max_rows: int = BROADCAST_ROWS,
                 max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per value of ``by`` (columns of the rules) the totals of the records :func:`route` gives it.

    ``count`` names their number, ``sums`` names sums of columns; rules without records
    have no row. Whether a rule takes a record depends on facility, severity and
    program alone, so records are added up by these first and the totals are routed: by
    facility and severity to rules without a program, with the program to
    the others. A rule then meets a few hundred totals at most, however many records there are.
    """
    sums = sums or {}
    names = [*([count] if count else []), *sums]
    first = [*([F.count(F.lit(1)).alias(count)] if count else []), *[F.sum(c).alias(n) for n, c in sums.items()]]

    def added(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])

    own = freeze(records.groupBy("fac", "sev", "prog").agg(*first))
    every = added(own, "fac", "sev").withColumn("prog", F.lit(None).cast("string"))
    parts = []
    for kinds, kept in ((every, "program IS NULL"), (own, "program IS NOT NULL")):
        # a key has one total, so there is nothing that a salt could split
        found = route(kinds, compiled.filter(kept), max_rows, max_bytes, salts=1, few_records=True)
        parts.append(found.select(*by, *names))
    return added(parts[0].union(parts[1]), *by)


def unrouted(records: DataFrame, compiled: DataFrame, max_rows: int = BROADCAST_ROWS,
             max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Records that no rule takes, in one pass.

    That depends on facility, severity and program alone, so only the distinct
    combinations the rules take are looked at.
    """
    taken = freeze(rule_index(compiled).select("fac", "sev", "program").distinct())
    # without a program there are 192 combinations at most
    rest = records.join(F.broadcast(taken.filter("program IS NULL").select("fac", "sev")),
                        ["fac", "sev"], "left_anti")
    own = taken.filter("program IS NOT NULL").select("fac", "sev", F.col("program").alias("prog"))
    if fits_broadcast(own, max_rows, max_bytes):
        return rest.join(F.broadcast(own), ["fac", "sev", "prog"], "left_anti").select(*records.columns)
    rest = rest.withColumn("_salt", F.pmod(F.xxhash64(*_spread(records)), F.lit(SALTS)).cast("int"))
    own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rest.join(own, ["fac", "sev", "prog", "_salt"], "left_anti").select(*records.columns))
