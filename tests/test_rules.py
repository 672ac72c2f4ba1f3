"""Selectors against a separate small interpreter, and routing both ways."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.operators import filters, route, rules
from logweave.plans import fixtures as X

SEV = {**S.SEVERITY_CODES, **S.SEVERITY_ALIASES, **{str(i): i for i in range(8)}}
FAC = {**S.FACILITY_CODES, **S.FACILITY_ALIASES, **{str(8 * i): i for i in range(24)}}


def interpret(selector):
    """Masks of a selector, or None when it is to be rejected."""
    mask = [0] * 25
    facs_level = []
    for part in selector.replace(" ", "").split(";"):
        while part:
            facs, _, rest = part.partition(".")
            level, _, part = rest.partition(",")
            facs_level.append((facs.split(","), level))
    for facs, level in facs_level:
        neg = level.startswith("!")
        level = level.removeprefix("!")
        one = level.startswith("=")
        level = level.removeprefix("=").lower()
        for f in facs:
            if f == "*":
                where = range(24)
            elif f.lower() in FAC:
                where = [FAC[f.lower()]]
            else:
                return None
            for i in where:
                if level == "none":
                    mask[i] = 255 if neg else 0
                elif level == "*" and not one:
                    mask[i] = 0 if neg else 255
                elif level in SEV:
                    n = SEV[level]
                    bits = 1 << n if one else (2 << n) - 1
                    mask[i] = mask[i] & ~bits if neg else mask[i] | bits
                else:
                    return None
    return mask


def compile_all(spark, selectors):
    df = spark.createDataFrame(list(enumerate(selectors)), "rule_id int, selector string")
    return {r.rule_id: list(r.masks) for r in rules.compile_masks(df).collect()}


def test_random_selectors(spark):
    rnd = random.Random(7)
    facs = ["*", "kern", "MAIL", "auth", "local7", "mark", "8", "184", "security", "nope", "192"]
    levels = ["*", "err", "=warning", "!err", "!=info", "none", "!none", "Debug", "0", "7", "8",
              "=*", "!*", "=none", "wrong"]
    made = []
    for _ in range(400):
        terms = [",".join(rnd.choices(facs[:-2] if rnd.random() < .9 else facs, k=rnd.randint(1, 3)))
                 + "." + rnd.choice(levels[:-5] if rnd.random() < .9 else levels)
                 for _ in range(rnd.randint(1, 4))]
        made.append("".join(t + rnd.choice(";,") for t in terms[:-1]) + terms[-1])
    got = compile_all(spark, made)
    for i, s in enumerate(made):
        assert got.get(i) == interpret(s), s


def test_rejects(spark):
    bad = ["mail.nosuch", "nosuch.err", "*.=*", "mail.16", "mail", "", ".err", "mail."]
    assert compile_all(spark, bad) == {}


def test_comma_after_level_ends_a_term(spark):
    m = compile_all(spark, ["mail.crit,*.err"])[0]
    assert m[2] == 15 and m[0] == 15


def test_default_rules(spark):
    got = rules.compile_masks(rules.default_rules(spark)).orderBy("pos").collect()
    assert [r.masks[0] for r in got] == [15, 1]


def test_program_blocks(spark):
    lines = ["*.err a", "!su", "*.info b", "# c", "", "#!ftpd", "*.* d", "! *", "*.* e", "!", "*.* f"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)],
                               "config_id int, line_no bigint, text string")
    want = [("*.err a", None), ("*.info b", "su"), ("*.* d", "ftpd"), ("*.* e", None), ("*.* f", None)]
    for block in (10_000, 2):
        got = rules.program_blocks(df, block).orderBy("line_no").select("text", "program").collect()
        assert [tuple(r) for r in got] == want


def test_routing_paths_agree(spark, sf):
    records, compiled = X.records(spark, sf), X.compiled(spark)
    fast = route.route(records, compiled)
    slow = route.route(records, compiled, max_rows=3, salts=3)
    cols = ["seq", "rule_id", "dest", "sink"]
    assert rows(fast.select(cols)) == rows(slow.select(cols))
    some = compiled.filter("rule_id IN ('sums', 'sales')")
    taken = route.route(records, some).select("seq").distinct()
    left = records.select("seq").exceptAll(taken)
    assert rows(route.unrouted(records, some).select("seq")) == rows(left)
    assert rows(route.unrouted(records, some, max_rows=0).select("seq")) == rows(left)


def test_warning_only_matches_nothing_and_marks_by_name(spark):
    df = spark.createDataFrame([("w", "*.=warning"), ("a", "*.*"), ("m", "mark.info")],
                               "rule_id string, selector string")
    rec = spark.createDataFrame([(1, 4, "p", "x"), (24, 6, "", "mark"), (25, 0, "p", "y")],
                                "fac int, sev int, prog string, msg string")
    got = route.route(rec, rules.compile_masks(df)).select("rule_id", "msg")
    assert rows(got) == [("a", "x"), ("m", "mark")]


def test_filters_literal_and_column_agree(spark, sf):
    routed = route.route(X.records(spark, sf), X.compiled(spark))
    base = X.rules(spark)
    a = filters.apply_filters(routed, base).select("seq", "rule_id")
    b = filters.apply_filters(routed, base, max_literal=1, max_rows=1).select("seq", "rule_id")
    assert rows(a) == rows(b)


@pytest.mark.parametrize("kw,want", [
    (dict(message_re="disk [[:alpha:]]+"), [1]),
    (dict(message_re="disk", inverse=True), [2, 3]),
    (dict(message_re="disk", host_re="^w", inverse=True), [3]),
    (dict(date_re="Jan  1"), [1, 2]),
    (dict(time_re="^1", inverse=True), [1]),
])
def test_passes(spark, kw, want):
    df = spark.createDataFrame(
        [(1, "disk full", "a", "2024-01-01 00:10:00"), (2, "x", "w", "2024-01-01 10:00:00"),
         (3, "y", "b", "2024-11-11 11:00:00")], "id int, msg string, host string, t string")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert [r.id for r in df.filter(filters.passes(**kw)).orderBy("id").collect()] == want


def test_totals_are_those_of_the_routed_rows(spark):
    """Totals by facility, severity and program, broadcast either way or shuffled; nulls, doubles and rules without records."""
    rnd = random.Random(11)
    lines = [(i if i % 9 else None, rnd.choice([None, *range(24)]), rnd.choice([None, *range(8)]), rnd.choice([None, "a", "b", "=a", ""]))
             for i in range(600)]
    records = spark.createDataFrame(lines, "seq bigint, fac int, sev int, prog string")
    facs, levels = ["*", "kern", "local1", "mail,cron"], ["*", "err", "=info", "!notice", "none"]
    given = [(rnd.choice([None, "r", *map(str, range(40))]), f"{rnd.choice(facs)}.{rnd.choice(levels)};{rnd.choice(facs)}.{rnd.choice(levels)}",
              rnd.choice([None, None, "a", "b", "=a", "*", "none"]), rnd.choice("xyz"), "file") for _ in range(120)]
    compiled = rules.compile_masks(spark.createDataFrame(
        given, "rule_id string, selector string, program string, dest string, sink string"))
    for by in (["rule_id"], ["sink", "rule_id", "dest"]):
        want = rows(route.route(records, compiled).groupBy(*by).agg(F.count(F.lit(1)), F.sum("seq")))
        assert len(want) > 30
        for limit in (10**6, 150, 20, 0):
            assert rows(route.route_totals(records, compiled, {"s": "seq"}, by, max_rows=limit)) == want
    assert rows(route.route_totals(records, compiled)) == rows(
        route.route(records, compiled).groupBy("rule_id").agg(F.count(F.lit(1))))
    assert rows(route.route(records, compiled, few_records=True)) == rows(route.route(records, compiled))


def test_totals_of_many_rules_are_not_rows_per_record(spark):
    """A rule meets a few hundred totals, and a rule set beyond the bound is neither written nor shuffled before it met them."""
    records = spark.range(30_000).selectExpr("id AS seq", "CAST(id % 24 AS int) AS fac", "CAST(id % 8 AS int) AS sev", "concat('p', id) AS prog")
    compiled = rules.compile_masks(spark.range(8_000).selectExpr(
        "CAST(id AS string) AS rule_id", "'*.*' AS selector", "CASE WHEN id % 2 = 1 THEN concat('p', id) END AS program",
        "'all' AS dest", "'file' AS sink"))
    df = route.route_totals(records, compiled, {"s": "seq"}, max_rows=40_000)  # 1.5 million index rows, 120 million pairs
    got = df.groupBy("n").agg(F.count("*"), F.min("s"), F.max("s"))
    assert rows(got) == [(1, 4_000, 1, 7_999), (30_000, 4_000, 30_000 * 29_999 // 2, 30_000 * 29_999 // 2)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
