"""Errors and notices of the jobs themselves, as log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.functions import codes
from logweave.operators.filters import rejected_filters
from logweave.operators.rules import parse_selectors


def as_records(df: DataFrame, text: Column, at: Column | str, pri: int = S.SYSLOG_ERR,
               local_host: str = "localhost", seq: Column | None = None) -> DataFrame:
    """Shape rows as records about ourselves (syslog.err or syslog.info)."""
    ts = F.lit(at) if isinstance(at, str) else at
    code = F.lit(pri)
    return df.select(
        (seq if seq is not None else F.monotonically_increasing_id()).cast("bigint").alias("seq"),
        ts.cast("timestamp_ntz").alias("ts"),
        codes.facility_of(code).alias("fac"), codes.severity_of(code).alias("sev"),
        code.alias("pri"), F.lit(local_host).alias("host"), F.lit(S.OWN_NAME).alias("prog"),
        F.concat(F.lit(S.OWN_NAME + ": "), text).alias("msg"),
        F.lit(False).alias("is_kernel"), F.lit(False).alias("is_mark"),
        F.lit("internal").alias("source"), F.lit(False).alias("has_header_ts"))


def notice(spark: SparkSession, text: str, at: str, local_host: str = "localhost") -> DataFrame:
    """One notice about ourselves, such as a restart or the reason for an exit."""
    return as_records(spark.range(1), F.lit(text), at, S.SYSLOG_INFO, local_host, F.col("id"))


def rule_errors(rules: DataFrame, at: Column | str, local_host: str = "localhost",
                seq: Column | None = None) -> DataFrame:
    """A record per rejected rule."""
    bad = parse_selectors(rules).filter(~F.col("valid"))
    text = F.concat(F.lit("unknown name in selector \""), F.col("selector"),
                    F.lit("\" of rule "), F.col("rule_id"))
    return as_records(bad, text, at, S.SYSLOG_ERR, local_host, seq)


def pattern_errors(rule_filters: DataFrame, at: Column | str, local_host: str = "localhost",
                   seq: Column | None = None) -> DataFrame:
    """A record per pattern that is not valid; its rule is rejected."""
    text = F.concat(F.lit("no valid pattern \""), F.col("given"), F.lit("\" in rule "), F.col("rule_id"))
    return as_records(rejected_filters(rule_filters), text, at, S.SYSLOG_ERR, local_host, seq)


def line_errors(dropped: DataFrame, at: Column | str, local_host: str = "localhost",
                seq: Column | None = None) -> DataFrame:
    """A record per line skipped because nothing follows its host."""
    text = F.concat(F.lit("no text after the host in \""), F.col("line"), F.lit("\""))
    return as_records(dropped, text, at, S.SYSLOG_ERR, local_host, seq)


def lost_report(dead_letter: DataFrame, at: Column | str,
                local_host: str = "localhost") -> DataFrame:
    """Undelivered records per sink, counted before the shuffle, as records."""
    lost = dead_letter.groupBy("sink").count()
    text = F.concat(F.col("count").cast("string"), F.lit(" records not delivered to "), F.col("sink"))
    return as_records(lost, text, at, S.SYSLOG_ERR, local_host)


def volume(routed: DataFrame, interval: str = "20 minutes") -> DataFrame:
    """Records per destination between keep-alives."""
    slot = F.window(F.col("ts").cast("timestamp"), interval)
    return (routed.groupBy(slot.alias("_w"), "dest").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("_w.start").cast("timestamp_ntz").alias("slot"), "dest", "n"))
