"""What the plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from logweave.operators import collapse, ordering, route
from logweave.operators.parse import parse_lines
from logweave.plans import fixtures as X
from logweave.plans.queries import REGISTRY


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def method_sizes(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = df._jdf.queryExecution().explainString(mode)
    return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cross_joins_or_single_tasks(spark, sf, name):
    p = plan(entry.queries()[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in p
    # one task may see summary rows only, never the lines themselves
    if name != "log_table_seq":
        assert "SinglePartition" not in p


def test_parse_stays_in_generated_code(spark, sf):
    df = X.records(spark, sf)
    assert "Python" not in plan(df) and "Exchange" not in plan(df)
    # methods of 8000 bytes and more are not compiled by the JIT
    assert max(method_sizes(spark, df)) < 8000


def test_filters_on_parsed_columns_do_not_repeat_the_parsing(spark, sf):
    p = plan(X.records(spark, sf).filter("msg <> '' AND fac = 3"))
    assert p.count("try_make_timestamp_ntz") <= 3


def test_scan_reads_what_is_needed(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS seq", "event_type AS line")
    p = plan(parse_lines(raw, default_host="l"))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_routing_broadcasts_small_rules_only(spark, sf):
    records, compiled = X.records(spark, sf), X.compiled(spark)
    fast = plan(route.route(records, compiled))
    assert "BroadcastHashJoin" in fast and "SortMergeJoin" not in fast
    assert "Exchange hashpartitioning(fac" not in fast.split("BroadcastExchange")[0]


@pytest.mark.parametrize("fn", [collapse.collapse_runs, collapse.collapse_emit])
def test_collapse_shuffles_lines_once(spark, sf, fn):
    lines = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "'r' AS rule_id", "ts", "event_id AS seq", "'h' AS host", "event_type AS msg")
    df = fn(lines)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    # every other branch reads the lines from the same exchange
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_row_numbers_without_global_sort(spark, sf):
    p = plan(ordering.number_rows(X.records(spark, sf)))
    assert "rangepartitioning" not in p


def test_lookup_reaches_the_scan(spark, sf):
    p = entry.queries()["lookup_table"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in p.splitlines() if "FileScan parquet" in line)
    assert "date" in scan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = scan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(time,06:00:00)" in pushed and "LessThan(time,18:00:00)" in pushed
