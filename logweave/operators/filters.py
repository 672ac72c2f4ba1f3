"""Regular-expression filters of rules, applied to routed records.

``rule_filters`` is ``(rule_id, message_re, host_re, date_re, time_re,
inverse)``, one row per filter of a rule; a rule with several filters passes a
record only when all of them do. Within one filter every given field is tested
and ``inverse`` negates each single test, so an inverse filter passes only
when nothing matches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import clock, posix
from logweave.operators import route
from logweave.operators.joins import fits_broadcast, lookup_join
from logweave.operators.patterns import PatternSet, RowTests
from logweave.operators.rules import DEAD_MASK
from logweave.session import freeze

LITERAL_PATTERNS = 62
#: Patterns, and bytes of them, that every task holds when messages are scanned once for all rules.
SCAN_PATTERNS = 200_000
SCAN_BYTES = 16 << 20
_NAMES = ("message_re", "host_re", "date_re", "time_re")


def _fields() -> dict[str, Column]:
    ts = F.col("ts")
    return {"message_re": F.col("msg"), "host_re": F.col("host"),
            "date_re": clock.header_date(ts), "time_re": clock.clock_text(ts)}


def passes(message_re: str | None = None, host_re: str | None = None,
           date_re: str | None = None, time_re: str | None = None,
           inverse: bool = False) -> Column:
    """Condition of one filter with fixed patterns."""
    given = {"message_re": message_re, "host_re": host_re,
             "date_re": date_re, "time_re": time_re}
    tests = []
    for name, pattern in given.items():
        if pattern is not None:
            java = posix.java(pattern)
            if java is None:
                raise ValueError(f"no valid pattern: {pattern!r}")
            hit = _fields()[name].rlike(java)
            tests.append(~hit if inverse else hit)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _java(pattern: Column) -> Column:
    """Patterns of a rule table in Java's words, null where they are not valid."""
    @F.pandas_udf("string")
    def translated(patterns: pd.Series) -> pd.Series:
        known = {p: posix.java(p) for p in patterns.unique()}
        return patterns.map(known)

    return translated(pattern)


def _tests(rule_filters: DataFrame) -> DataFrame:
    """One row per single test: ``(rule_id, field, given, pattern, inverse)``.

    ``given`` is the pattern as the rule has it, ``pattern`` is null where that is not valid.
    """
    fields = [c for c in _NAMES if c in rule_filters.columns]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("re"))
                               for c in fields]))
    return (rule_filters.select("rule_id", F.coalesce("inverse", F.lit(False)).alias("inverse"),
                                each.alias("t"))
            .filter("t.re IS NOT NULL")
            .select("rule_id", F.col("t.field").alias("field"), F.col("t.re").alias("given"), "inverse")
            .distinct().withColumn("pattern", _java(F.col("given"))))


def rejected_filters(rule_filters: DataFrame) -> DataFrame:
    """``(rule_id, field, given)`` of tests whose pattern is not valid; their rules are rejected."""
    return _tests(rule_filters).filter("pattern IS NULL").select("rule_id", "field", "given")


def apply_filters(routed: DataFrame, rule_filters: DataFrame,
                  max_literal: int = LITERAL_PATTERNS, max_rows: int = 1_000_000) -> DataFrame:
    """Routed records that pass all filters of their rule; others pass freely.

    A rule with a pattern that is not valid is rejected and passes nothing
    (see :func:`rejected_filters`).

    Up to ``max_literal`` distinct tests are put into the plan as constant
    patterns, compiled once per task, and each rule carries a bit set of the
    tests it needs. With more, each row brings its rule's tests to a Python
    worker, which keeps compiled patterns: a row costs the same however many rules there are.
    """
    tests = freeze(_tests(rule_filters))
    kinds = tests.filter("pattern IS NOT NULL").select("field", "pattern", "inverse").distinct()
    known = kinds.limit(max_literal + 1).collect()  # bounded: tens of patterns
    fields = _fields()
    spread = [c for c in ("source", "seq", "host", "msg") if c in routed.columns]
    bad = tests.filter("pattern IS NULL").select("rule_id", F.lit(True).alias("_bad")).distinct()
    if not bad.isEmpty():
        routed = lookup_join(routed, bad, ["rule_id"], "left", spread, max_rows).filter(
            "_bad IS NULL").drop("_bad")
        tests = tests.filter("pattern IS NOT NULL")
    if not known:
        return routed
    if len(known) <= max_literal:
        known = sorted(known)
        number = reduce(
            lambda acc, k: acc.when((F.col("field") == k[1]["field"])
                                    & (F.col("pattern") == k[1]["pattern"])
                                    & (F.col("inverse") == k[1]["inverse"]),
                                    F.lit(1 << k[0]).cast("bigint")),
            enumerate(known), F.when(F.lit(False), F.lit(0).cast("bigint")))
        needs = tests.groupBy("rule_id").agg(F.bit_or(number).alias("_needs"))
        joined = lookup_join(routed, needs, ["rule_id"], "left", spread, max_rows)
        conds = []
        for i, k in enumerate(known):
            hit = fields[k["field"]].rlike(k["pattern"])
            unused = F.col("_needs").bitwiseAND(F.lit(1 << i).cast("bigint")) == 0
            conds.append(unused | (~hit if k["inverse"] else hit))
        return (joined.filter(F.col("_needs").isNull() | reduce(lambda a, b: a & b, conds))
                .drop("_needs"))
    number = reduce(lambda acc, k: acc.when(F.col("field") == k[1], F.lit(k[0])), enumerate(_NAMES), F.when(F.lit(False), 0))
    each = F.sort_array(F.collect_list(F.struct(number.alias("f"), "given", "inverse")))
    needs = tests.groupBy("rule_id").agg(F.to_json(each).alias("_needs"))
    joined = lookup_join(routed, needs, ["rule_id"], "left", spread, max_rows)
    return joined.filter(_row_tests("_needs", *[fields[n] for n in _NAMES])).drop("_needs")


def _row_tests(needs: str, *values: Column) -> Column:
    """Whether a row passes the tests in its column ``needs``; true where it has none."""
    kept = RowTests()

    @F.pandas_udf("boolean")
    def passing(tests: pd.Series, message: pd.Series, host: pd.Series, date: pd.Series, time: pd.Series) -> pd.Series:
        out = []
        for key, *row in zip(tests, message, host, date, time, strict=True):
            if key is None:
                out.append(True)
                continue
            found = kept.known.get(key)
            if found is None:
                found = kept.tests(key, [(t["f"], t["given"], t["inverse"]) for t in json.loads(key)])
            out.append(kept.passes(found, tuple(row)))
        return pd.Series(out, dtype=bool)

    return passing(F.col(needs), *values)


def route_matching(records: DataFrame, compiled: DataFrame, rule_filters: DataFrame,
                   max_patterns: int = SCAN_PATTERNS, max_bytes: int = SCAN_BYTES) -> DataFrame:
    """``apply_filters(route(records, compiled), rule_filters)`` for many rules that want the same records.

    Each record is scanned once for the patterns of all rules, before it meets
    a rule; a rule with a test that must match is looked up by that pattern, so a record is
    compared with the rules one of whose patterns it matches, not with all that select
    it. Rules of which no test must match are routed first and filtered after.
    Patterns beyond the bounds, which are measured, take the other way.
    """
    scan = _scan_rules(compiled, rule_filters, max_patterns, max_bytes)
    if scan is None:
        return apply_filters(route.route(records, compiled), rule_filters)
    known, rules = scan
    seen = _with_hits(records, known)
    free = route.route(seen, rules.filter("_all IS NULL OR size(_all) = 0").select(compiled.columns))
    bars = rules.filter("size(_all) = 0 AND size(_none) > 0").select("rule_id", "_none")
    spread = [c for c in ("source", "seq", "host", "msg") if c in records.columns]
    kept = lookup_join(free, bars, ["rule_id"], "left", spread).filter(
        ~F.coalesce(F.arrays_overlap("_none", "_found"), F.lit(False))).drop("_none")
    target = [c for c in free.columns if c not in seen.columns and c != "rule_id"]
    met = _met(seen, rules.filter("size(_all) > 0").select("_all", "_none", "program", "masks", "rule_id", *target), spread)
    return kept.select(free.columns).unionByName(met.select(free.columns)).drop("_found")


def _scan_rules(compiled: DataFrame, rule_filters: DataFrame, max_patterns: int,
                max_bytes: int) -> tuple[list[tuple[str, str]], DataFrame] | None:
    """All patterns, numbered by their place, and the rules without invalid ones: ``_all`` must be found in a record, ``_none`` must not.

    Nothing where there are no patterns, or more than the bounds.
    """
    tests = freeze(_tests(rule_filters).filter("given IS NOT NULL"))
    kinds = tests.filter("pattern IS NOT NULL").select("field", "given").distinct()
    if not fits_broadcast(kinds, max_patterns, max_bytes):
        return None
    known = sorted(map(tuple, kinds.collect()))  # within the bounds just measured
    if not known:
        return None
    numbers = compiled.sparkSession.createDataFrame(
        [(i, f, g) for i, (f, g) in enumerate(known)], "n int, field string, given string")
    field = reduce(lambda acc, k: acc.when(F.col("field") == k[1], F.lit(-1 - k[0])), enumerate(_NAMES), F.when(F.lit(False), 0))
    needs = tests.join(F.broadcast(numbers), ["field", "given"], "left").groupBy("rule_id").agg(
        F.bool_or(F.col("pattern").isNull()).alias("_bad"),
        F.array_sort(F.collect_set(F.when(~F.col("inverse"), F.col("n")))).alias("_all"),
        F.array_sort(F.array_union(F.collect_set(F.when(F.col("inverse"), F.col("n"))),
                                   F.collect_set(F.when(F.col("inverse"), field)))).alias("_none"))
    return known, freeze(compiled.join(needs, "rule_id", "left").filter("NOT coalesce(_bad, false)").drop("_bad"))


def _selected() -> Column:
    """Whether the rule of a row, by its ``masks`` and ``program``, takes the row's record."""
    mask = F.get("masks", F.col("fac"))
    takes = (mask != DEAD_MASK) & (mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("sev"))) != 0)
    return (F.col("program").isNull() | (F.col("program") == F.col("prog"))) & takes


def _met(seen: DataFrame, keyed: DataFrame, spread: list[str]) -> DataFrame:
    """Rows of ``seen`` with each rule that takes them, of rules with patterns that must be found: looked up by the last of these."""
    by_hit = seen.withColumn("_by", F.explode("_found"))
    return lookup_join(by_hit, keyed.withColumn("_by", F.element_at("_all", -1)), ["_by"], "inner", spread).filter(
        (F.size(F.array_except("_all", "_found")) == 0) & ~F.arrays_overlap("_none", "_found") & _selected())


def match_totals(records: DataFrame, compiled: DataFrame, rule_filters: DataFrame, sums: dict[str, str] | None = None,
                 count: str = "n", max_patterns: int = SCAN_PATTERNS, max_bytes: int = SCAN_BYTES) -> DataFrame:
    """Per ``rule_id`` the totals of the records :func:`route_matching` gives it: their number, and sums of columns.

    Records are scanned in the same way and then added up by facility, severity, program and
    the patterns found; rules that ask the same (masks, program and tests) are one class. Classes with a
    pattern that must match are looked up by it. The others get the totals of all records they
    select less those of records in which a pattern that must not match was found, looked up by that
    pattern, so neither kind is compared with records it has no pattern in. Totals come back to the rules last.
    """
    sums = sums or {}
    scan = _scan_rules(compiled, rule_filters, max_patterns, max_bytes)
    if scan is None:
        found = apply_filters(route.route(records, compiled), rule_filters)
        return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias(count), *[F.sum(c).alias(n) for n, c in sums.items()])
    known, rules = scan
    asks = F.to_json(F.struct("program", "masks", "_all", "_none"))
    rules = rules.select("rule_id", "program", "masks", "_all", "_none", asks.alias("_asks"))
    classes = freeze(rules.groupBy("_asks").agg(*[F.first(c).alias(c) for c in ("program", "masks", "_all", "_none")])
                     .withColumn("_class", F.monotonically_increasing_id()))
    # a sum is null where no value is known, so these are counted
    names = [count, *sums, *[f"_k_{n}" for n in sums]]
    needed = sorted({"fac", "sev", "prog", "host", "msg", "ts", *sums.values()})
    kinds = freeze(_with_hits(records.select(needed), known).groupBy("fac", "sev", "prog", "_found").agg(
        F.count(F.lit(1)).alias(count), *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.count(c).alias(f"_k_{n}") for n, c in sums.items()]))
    added = [F.sum(n).alias(n) for n in names]
    keyed = classes.filter("size(_all) > 0").select("_class", "program", "masks", "_all", "_none")
    met = _met(kinds, keyed, []).groupBy("_class").agg(*added)
    free = classes.filter("_all IS NULL OR size(_all) = 0").withColumnRenamed("_class", "rule_id")
    every = route.route_totals(kinds, free.select("rule_id", "program", "masks"), {n: n for n in names}, count=None)
    # a record with several of a class's patterns counts once, at the smallest
    bars = free.filter("size(_none) > 0").select("rule_id", "program", "masks", "_none", F.explode("_none").alias("_by"))
    by_hit = kinds.withColumn("_by", F.explode("_found"))
    barred = (lookup_join(by_hit, bars, ["_by"]).filter(
        (F.array_min(F.array_intersect("_none", "_found")) == F.col("_by")) & _selected())
        .groupBy("rule_id").agg(*[F.sum(n).alias(f"_less_{n}") for n in names]))
    rest = every.join(barred, "rule_id", "left").select(
        F.col("rule_id").alias("_class"),
        *[(F.col(n) - F.coalesce(f"_less_{n}", F.lit(0))).alias(n) for n in names])
    totals = met.unionByName(rest).filter(F.col(count) > 0).join(classes.select("_class", "_asks"), "_class")
    totals = freeze(totals.select("_asks", count, *[F.when(F.col(f"_k_{n}") > 0, F.col(n)).alias(n) for n in sums]))
    # as route_matching has it, a rule of which no pattern must match and that comes k times takes a record k * k times
    barred = F.coalesce((F.size("_all") == 0) & (F.size("_none") > 0), F.lit(False)).alias("_barred")
    back = lookup_join(rules.select("rule_id", "_asks", barred), totals, ["_asks"], "left", ["rule_id"]).groupBy("rule_id").agg(
        F.when(F.bool_or("_barred"), F.count(F.lit(1))).otherwise(F.lit(1)).alias("_times"),
        *[F.sum(n).alias(n) for n in (count, *sums)])
    return back.filter(F.col(count) > 0).select("rule_id", *[(F.col(n) * F.col("_times")).alias(n) for n in (count, *sums)])


def _with_hits(records: DataFrame, known: list[tuple[str, str]]) -> DataFrame:
    """``records`` with ``_found``: numbers of the patterns that match, and -1 - field for a null field."""
    fields = _fields()
    given = records.select("*", *[fields[n].alias(f"_{n}") for n in _NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [PatternSet((i, p) for i, (f, p) in enumerate(known) if f == n) for n in _NAMES]
        short: list[dict] = [{} for _ in _NAMES]
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for k, name in enumerate(_NAMES):
                if not sets[k].search:
                    continue
                for hits, value in zip(found, batch.column(f"_{name}").to_pylist(), strict=True):
                    if value is None:
                        hits.append(-1 - k)
                        continue
                    same = short[k].get(value)
                    if same is None:
                        same = sets[k].matching(value)
                        if len(short[k]) >= 10_000:
                            short[k].clear()
                        short[k][value] = same
                    hits += same
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.int32()))], names=[*names, "_found"])

    names = records.columns
    return given.mapInArrow(run, records.withColumn("_found", F.array().cast("array<int>")).schema)
