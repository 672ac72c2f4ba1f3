"""Registered queries: each operator over whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import clock, codes, text
from logweave.functions.clock import epoch_seconds as clock_seconds
from logweave.operators import (collapse, diagnostics, filters, integrity, marks, notify, parse,
                                reassemble, route, rules, symbols)
from logweave.plans import fixtures as X
from logweave.session import shared_dir
from logweave.sinks import committed, deliver, indexed, render
from logweave.sources import follow, recorded
from logweave.sources import lines as src

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _ts(name: str):
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss").alias(name)


def routed(spark: SparkSession, sf: str) -> DataFrame:
    return route.route(X.records(spark, sf), X.compiled(spark))


# --- parsing ---------------------------------------------------------------

@query
def route_host_counts(spark, sf):
    return (routed(spark, sf).groupBy("rule_id", "host")
            .agg(F.count(F.lit(1)).alias("n")))


@query
def parse_records(spark, sf):
    return X.records(spark, sf).select("seq", _ts("ts"), "fac", "sev", "pri", "host", "prog",
                                       "msg", "has_header_ts")


@query
def parse_pri_edge(spark, sf):
    """PRI texts of every shape: absent, empty, open, too large, kernel."""
    shape = ("CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '<>' "
             "WHEN 2 THEN concat('<', user_id) WHEN 3 THEN concat('<', user_id * 40, '>') "
             "WHEN 4 THEN concat('<', event_id, '99999999999>') "
             "ELSE concat('<', user_id % 192, '>') END")
    raw = X.table(spark, sf, "events").selectExpr(
        "event_id AS seq", "ts AS arrival_ts", f"concat({shape}, event_type) AS line",
        "user_id % 3 = 0 AS is_kernel")
    return parse.parse_lines(raw, default_host=X.LOCAL_HOST).select(
        "seq", _ts("ts"), "fac", "sev", "pri", "host", "prog", "msg", "has_header_ts")


@query
def header_times(spark, sf):
    """Headers with a year, without one, in the future, and malformed."""
    mon = "date_format(o_orderdate, 'MMM')"
    day = "lpad(CAST(day(o_orderdate) AS string), 2, ' ')"
    raw = X.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seq", "TIMESTAMP_NTZ '2024-05-05 05:05:05' AS arrival_ts",
        f"CASE o_orderkey % 4 WHEN 0 THEN {mon} || ' ' || {day} || ' 10:20:30 ' || o_orderpriority "
        f"WHEN 1 THEN {mon} || ' ' || {day} || ' 10:20:30 ' || year(o_orderdate) || ' ' || o_orderpriority "
        f"WHEN 2 THEN {mon} || ' ' || {day} || ' 10:20:30 10.0.0.1 ' || o_orderpriority "
        f"ELSE {mon} || ' ' || {day} || ' 10:20 ' || o_orderpriority END AS line")
    return parse.parse_lines(raw, default_host=X.LOCAL_HOST, ref_ts=X.REF_TS).select(
        "seq", _ts("ts"), "msg", "has_header_ts")


@query
def host_short(spark, sf):
    usable, _ = parse.split_hosts(X.raw_lines(spark, sf))
    return usable.select("seq", "msg_host", text.short_host(F.col("msg_host")).alias("host"))


@query
def code_names(spark, sf):
    return (X.table(spark, sf, "lineitem")
            .select((F.col("l_partkey") % 26).cast("int").alias("fac"),
                    (F.col("l_suppkey") % 9).cast("int").alias("sev"))
            .groupBy("fac", "sev").agg(F.count(F.lit(1)).alias("n"))
            .select("fac", "sev", codes.facility_name(F.col("fac")).alias("facility"),
                    codes.severity_name(F.col("sev")).alias("priority"), "n"))


@query
def escape_controls(spark, sf):
    """Letters turned into control characters, then escaped."""
    dirty = F.translate("text", "eaiou", "\x01\x1b\x7f\x85\t")
    return X.table(spark, sf, "documents").select(
        "doc_id", text.escape_controls(dirty).alias("shown"))


@query
def mask_nonprint(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", text.mask_nonprint(F.col("text")).alias("masked"))


def _hosts(spark, sf):
    return X.table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").selectExpr(
        "concat('10.0.0.', s_suppkey) AS addr", "concat(s_name, '.example.com') AS name")


@query
def peer_names(spark, sf):
    """Name of the sending address, or the address; shortened."""
    raw = X.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS seq", "concat('10.0.0.', l_suppkey) AS peer",
        "'x y' AS line")
    named = parse.resolve_peers(raw, _hosts(spark, sf))
    return (named.withColumn("host", text.short_host(F.col("peer_host")))
            .groupBy("peer", "peer_host", "host").agg(F.count(F.lit(1)).alias("n")))


@query
def translate_symbols(spark, sf):
    return symbols.translate_symbols(X.kernel_oops(spark, sf), X.symbols(spark, sf)).select(
        "seq", "line")


# --- sources ---------------------------------------------------------------

@query
def file_input(spark, sf):
    """All lines of files: default kern.crit, a leading PRI taken, name in front."""
    raw = X.table(spark, sf, "documents").selectExpr(
        "doc_id", "source", "posexplode(split(text, '\n')) AS (at, line)").selectExpr(
        "doc_id * 1000000 + at AS seq", "source", "TIMESTAMP_NTZ '2024-03-01 00:00:00' AS arrival_ts",
        "CASE WHEN doc_id % 3 = 0 THEN concat('<', doc_id % 1100, '>') ELSE '' END || line AS line")
    return parse.parse_lines(src.file_lines(raw), default_host=X.LOCAL_HOST).select(
        "seq", _ts("ts"), "pri", "host", "prog", "msg")


@query
def followed_lines(spark, sf):
    """A stream over growing files, stopped and started again: half of the lines, then renamed files and the others."""
    base = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    raw = X.raw_lines(spark, sf)

    def run() -> None:
        (follow.follow_lines(spark, f"{base}/in", split_bytes=1 << 18).writeStream.foreachBatch(
            lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination())

    raw.filter("seq % 2 = 0").select("line").write.text(f"{base}/in")
    run()
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for f in files.globStatus(path(f"{base}/in/part-*")):
        files.rename(f.getPath(), f.getPath().suffix(".1"))
    raw.filter("seq % 2 = 1").select("line").write.mode("append").text(f"{base}/in")
    run()
    return (spark.read.schema("file string, offset bigint, line string").parquet(f"{base}/out")
            .groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file", "offset").alias("places")))


@query
def custom_time(spark, sf):
    """File lines with their own time format in the middle."""
    raw = X.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seq", "'app' AS source", "TIMESTAMP_NTZ '2024-03-01 00:00:00' AS arrival_ts",
        "'[' || CASE WHEN o_orderstatus = 'F' THEN 'not a time, no no no' ELSE "
        "date_format(o_orderdate, 'yyyy/MM/dd-HH:mm:ss') END || '] ' || o_orderpriority AS line")
    made = src.file_lines(raw, "yyyy/MM/dd-HH:mm:ss", start=1)
    return parse.parse_lines(made, default_host=X.LOCAL_HOST, ref_ts=X.REF_TS).select(
        "seq", _ts("ts"), "pri", "msg", "has_header_ts")


@query
def reassemble_lines(spark, sf):
    return reassemble.reassemble_lines(X.chunks(spark, sf))


def _kernel_raw(spark, sf):
    return X.table(spark, sf, "events").selectExpr(
        "event_id AS seq", "ts AS arrival_ts",
        "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('<', user_id % 8, '>') "
        "ELSE concat('<', user_id, '>') END || event_type || ' at ' || props AS line")


@query
def kernel_lines(spark, sf):
    made = src.kernel_lines(_kernel_raw(spark, sf))
    return parse.parse_lines(made, default_host=X.LOCAL_HOST).select(
        "seq", _ts("ts"), "fac", "sev", "prog", "msg", "is_kernel")


@query
def kernel_lines_bsd(spark, sf):
    made = src.kernel_lines(_kernel_raw(spark, sf), style="bsd", kernel_name="/bsd")
    return parse.parse_lines(made, default_host=X.LOCAL_HOST).select(
        "seq", _ts("ts"), "fac", "sev", "prog", "msg", "is_kernel")


@query
def device_lines(spark, sf):
    """PRI beside the text; a redundant one in the text goes."""
    raw = X.table(spark, sf, "events").selectExpr(
        "event_id AS seq", "ts AS arrival_ts", "CAST(user_id AS int) AS pri",
        "CASE WHEN event_id % 2 = 0 THEN concat('<', user_id, '>') ELSE '' END || event_type AS line")
    return parse.parse_lines(src.device_lines(raw), default_host=X.LOCAL_HOST).select(
        "seq", "pri", "fac", "sev", "msg")


@query
def datagrams(spark, sf):
    """One datagram, one record, masked, host by address."""
    df = X.table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn AS offset", "TIMESTAMP_NTZ '2024-03-01 00:00:00' AS timestamp",
        "concat('10.0.0.', conv_id) AS peer", "concat('<', turn * 9, '>', role, ': ', text) AS value")
    return parse.parse_lines(src.from_stream(df), default_host=X.LOCAL_HOST, network=True,
                             hosts=_hosts(spark, sf), strip_domain=True).select(
        "seq", "pri", "host", "prog", "msg")


@query
def recorded_datagrams(spark, sf):
    """A stream over recorded datagrams, stopped and started again; lines that are no records are told apart."""
    base = f"{shared_dir(spark)}/recorded-{uuid.uuid4().hex}"
    sent = X.table(spark, sf, "conversations").selectExpr(
        "CAST(conv_id % 7 AS int) AS partition", "conv_id * 1000 + turn AS offset",
        "TIMESTAMP_NTZ '2024-03-01 00:00:00' AS time", "concat('10.0.0.', conv_id) AS peer",
        "CAST(concat('<', turn * 9, '>', role, ': ', text) AS binary) AS data")
    noise = X.table(spark, sf, "supplier").select(F.concat(F.lit("{"), "s_name").alias("value"))

    def run() -> None:
        (recorded.follow_datagrams(spark, f"{base}/in", partitions=64, split_bytes=1 << 18).writeStream.foreachBatch(
            lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination())

    for half in (0, 1):
        mine = recorded.record_datagrams(sent.filter(F.col("offset") % 2 == half))
        mine.union(noise).write.mode("append").text(f"{base}/in")
        run()
    came = spark.read.parquet(f"{base}/out")
    damaged = came.filter("damaged").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    parsed = parse.parse_lines(came.filter("NOT damaged").drop("damaged"), default_host=X.LOCAL_HOST, network=True,
                               hosts=_hosts(spark, sf), strip_domain=True)
    return parsed.select("seq", "pri", "host", "prog", "msg", F.lit(1).cast("bigint").alias("n")).unionByName(
        damaged.select(F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("int").alias("pri"),
                       F.lit("").alias("host"), F.lit("").alias("prog"), F.col("line").alias("msg"), "n"))


@query
def merge_sources(spark, sf):
    """File, kernel and network lines in one table of records."""
    events = X.table(spark, sf, "events")
    files = src.file_lines(events.filter("event_type = 'view'").selectExpr(
        "event_id AS seq", "'app.log' AS source", "ts AS arrival_ts", "event_type AS line"))
    kernel = src.kernel_lines(events.filter("event_type = 'error'").selectExpr(
        "event_id AS seq", "'kernel' AS source", "ts AS arrival_ts", "event_type AS line"))
    net = events.filter("event_type NOT IN ('view', 'error')").selectExpr(
        "event_id AS seq", "'net' AS source", "ts AS arrival_ts", "concat('p', user_id) AS peer",
        "concat('<', user_id, '>', event_type) AS line")
    return parse.parse_lines(src.merge_sources(files, kernel, net),
                             default_host=X.LOCAL_HOST).select(
        "seq", "source", "pri", "host", "prog", "msg", "is_kernel")


# --- rules and routing -----------------------------------------------------

@query
def compile_masks(spark, sf):
    return rules.rule_masks(rules.compile_masks(X.tenant_rules(spark, sf)))


@query
def rules_rejected(spark, sf):
    return rules.rejected_rules(X.tenant_rules(spark, sf)).select("rule_id", "selector")


@query
def program_blocks(spark, sf):
    return rules.program_blocks(X.config_lines(spark, sf)).select(
        "config_id", "line_no", "text", "program")


@query
def route_counts(spark, sf):
    return (routed(spark, sf).groupBy("rule_id", "dest", "sink")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum")))


@query
def route_tenants(spark, sf):
    """Every record against a rule per customer."""
    compiled = rules.compile_masks(X.tenant_rules(spark, sf))
    return route.route_totals(X.records(spark, sf), compiled)


def _program_rules(spark, sf):
    """A rule per supplier; every other one for one program only."""
    return rules.compile_masks(X.program_rules(spark, sf))


@query
def route_programs(spark, sf):
    """Every record against rules with and without a program."""
    return route.route_totals(X.records(spark, sf), _program_rules(spark, sf), {"seq_sum": "seq"})


@query
def route_programs_shuffled(spark, sf):
    """The same as for a rule set beyond the bound of a broadcast."""
    return route.route_totals(X.records(spark, sf), _program_rules(spark, sf), {"seq_sum": "seq"}, max_rows=0)


@query
def actions_fanout(spark, sf):
    """Rules with several sinks each: a row of the rule's records per sink."""
    number = "CAST(rule_id AS bigint)"
    actions = (f"CASE WHEN {number} % 3 = 0 THEN array(named_struct('sink', 'file', 'dest', 'all'), "
               f"named_struct('sink', 'forward', 'dest', concat('relay', {number} % 5))) "
               "ELSE array(named_struct('sink', 'table', 'dest', 'log')) END")
    given = X.program_rules(spark, sf).drop("dest", "sink").withColumn("actions", F.expr(actions))
    compiled = rules.compile_masks(deliver.explode_actions(given))
    return route.route_totals(X.records(spark, sf), compiled, {"seq_sum": "seq"}, ["rule_id", "sink", "dest"])


@query
def registered_parts(spark, sf):
    """A source, a filter and a sink under names, put together."""
    path = f"{shared_dir(spark)}/registered-{uuid.uuid4().hex}"
    src.register_source("events", lambda s: X.raw_lines(s, sf))
    deliver.register_filter("even hosts", lambda msg: ~msg.contains("view") & F.col("host").rlike("[02468]$"))
    deliver.register_sink("registered", lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}"))
    lines = parse.parse_lines(src.open_source(spark, "events"), default_host=X.LOCAL_HOST, ref_ts=X.REF_TS,
                              trust_msg_host=True, strip_domain=True)
    kept = deliver.named_filter(lines, "even hosts").select("seq", "host", "msg", F.lit("registered").alias("sink"))
    deliver.deliver(kept, 0)
    deliver.forget_sink("registered")
    return spark.read.schema(kept.schema).parquet(path).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query
def default_rules(spark, sf):
    compiled = rules.compile_masks(rules.default_rules(spark))
    return (route.route(X.records(spark, sf), compiled).groupBy("rule_id", "dest")
            .agg(F.count(F.lit(1)).alias("n")))


@query
def unrouted(spark, sf):
    some = X.compiled(spark).filter("rule_id IN ('whole', 'groups', 'sales', 'ledger', 'exact')")
    return route.unrouted(X.records(spark, sf), some).select("seq", "fac", "sev", "prog")


@query
def regex_message(spark, sf):
    return (X.records(spark, sf).filter(filters.passes(message_re="[[:digit:]]{3}.*9"))
            .select("seq", "host", "msg"))


@query
def regex_time_inverse(spark, sf):
    return (X.records(spark, sf)
            .filter(filters.passes(host_re="h1", time_re="^1", inverse=True))
            .select("seq", "host", _ts("ts")))


@query
def regex_chain(spark, sf):
    """Filters of all rules, and a second one for some of them."""
    base = X.rules(spark).select("rule_id", "message_re", "host_re", "date_re", "time_re", "inverse")
    more = base.filter("rule_id IN ('loud', 'louder')").select(
        "rule_id", F.lit("error").alias("message_re"), F.lit("[13579]$").alias("host_re"),
        F.lit(None).cast("string").alias("date_re"), F.lit("[02468]$").alias("time_re"),
        F.lit(False).alias("inverse"))
    more2 = more.filter("rule_id = 'louder'").withColumn("host_re", F.lit("^h1")) \
        .withColumn("inverse", F.lit(True)).withColumn("message_re", F.lit("k: 1")) \
        .withColumn("time_re", F.lit(None).cast("string"))
    chain = base.unionByName(more).unionByName(more2)
    return (filters.apply_filters(routed(spark, sf), chain).groupBy("rule_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum")))


@query
def regex_rejected(spark, sf):
    """Patterns that are not valid come back as records; the others are accepted."""
    given = X.table(spark, sf, "supplier").selectExpr(
        "CAST(s_suppkey AS string) AS rule_id", f"{X.BAD_PATTERNS} AS message_re", "false AS inverse")
    return diagnostics.pattern_errors(given, "2024-06-01 00:00:00", X.LOCAL_HOST,
                                      F.col("rule_id").cast("bigint")).select("seq", "pri", "host", "msg")


@query
def regex_many(spark, sf):
    """A pattern per supplier, more than stand in the plan as constants; rules with a bad one pass nothing."""
    rule = "CAST(1 + seq % 100 AS string)"
    lines = X.records(spark, sf).withColumn("rule_id", F.expr(rule))
    given = X.table(spark, sf, "supplier").selectExpr(
        "CAST(s_suppkey AS string) AS rule_id",
        f"CASE WHEN s_suppkey % 7 = 3 THEN {X.BAD_PATTERNS} ELSE concat('k.: ', s_suppkey % 90, '[}}&^]') END AS message_re",
        "s_suppkey % 2 = 0 AS inverse")
    return (filters.apply_filters(lines, given).groupBy("rule_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum")))


@query
def regex_grammar(spark, sf):
    """A rule per customer on the same records, each message scanned once for all patterns."""
    table = X.grammar_rules(spark, sf)
    return filters.match_totals(X.records(spark, sf), rules.compile_masks(table), table, {"seq_sum": "seq"})


@query
def drop_empty(spark, sf):
    """Records left without a message are not written."""
    raw = X.table(spark, sf, "events").selectExpr(
        "event_id AS seq", "ts AS arrival_ts",
        "concat('<', user_id % 192, '>', CASE WHEN event_type = 'view' THEN '' ELSE event_type END) AS line")
    return (parse.drop_empty(parse.parse_lines(raw, default_host=X.LOCAL_HOST))
            .groupBy("msg").agg(F.count(F.lit(1)).alias("n")))


# --- repeats, silence, marks -------------------------------------------------

def _runs(df):
    return df.select("rule_id", "first_seq", "host", "msg", "fac", "sev", "n",
                     _ts("first_ts"), _ts("last_ts"))


@query
def collapse_runs(spark, sf):
    return _runs(collapse.collapse_runs(X.repeats(spark, sf)))


@query
def collapse_runs_bucketed(spark, sf):
    """The same with tiny chunks, so that runs cross them at every level."""
    return _runs(collapse.collapse_runs(X.repeats(spark, sf), hot_rows=3, block=2))


@query
def collapse_emit(spark, sf):
    return collapse.collapse_emit(X.repeats(spark, sf)).select(
        "rule_id", "run", _ts("at"), _ts("ts"), "fac", "sev", "host", "msg", "n")


@query
def collapse_stream(spark, sf):
    """The same in two batches, open runs carried over as state."""
    lines = X.repeats(spark, sf)
    first = F.col("ts") < F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    state = spark.createDataFrame([], collapse.STATE_SCHEMA)
    parts = []
    for part in (lines.filter(first), lines.filter(~first)):
        clock = part.agg(F.max(clock_seconds(F.col("ts")))).first()[0] or 0
        written, state = collapse.collapse_step(part, state, clock)
        parts.append(written)
    parts.append(collapse.close_state(state))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "rule_id", "run", _ts("at"), _ts("ts"), "fac", "sev", "host", "msg", "n")


@query
def collapse_off(spark, sf):
    df = collapse.collapse_emit(X.repeats(spark, sf), collapse=False)
    return df.groupBy("rule_id", "msg").agg(F.count(F.lit(1)).alias("n"), F.sum("run").alias("s"))


@query
def output_gaps(spark, sf):
    return collapse.output_gaps(X.repeats(spark, sf), 3600).select(
        "rule_id", _ts("silent_from"), _ts("silent_to"), "seconds")


@query
def marks_due(spark, sf):
    written = routed(spark, sf).select("rule_id", F.col("ts").alias("at"))
    return marks.marks(written, X.compiled(spark), "2024-01-01 00:00:00", "2024-01-31 00:00:00",
                       local_host=X.LOCAL_HOST).select("rule_id", "dest", _ts("ts"), "fac", "sev",
                                                       "host", "msg")


@query
def marks_odd(spark, sf):
    """An interval of an odd number of seconds."""
    written = routed(spark, sf).select("rule_id", F.col("ts").alias("at"))
    return marks.marks(written, X.compiled(spark), "2024-01-01 00:00:00", "2024-01-31 00:00:00",
                       interval=1201, local_host=X.LOCAL_HOST).select("rule_id", "dest", _ts("ts"))


@query
def diagnostics_records(spark, sf):
    """Rejected rules and skipped lines come back as records."""
    at = "2024-06-01 00:00:00"
    bad_rules = diagnostics.rule_errors(X.tenant_rules(spark, sf), at, X.LOCAL_HOST,
                                        F.col("rule_id").cast("bigint"))
    cut = X.raw_lines(spark, sf).withColumn("line", F.when(
        F.col("line").contains("signup"), F.substring_index("line", " signup", 1))
        .otherwise(F.col("line")))
    _, dropped = parse.split_hosts(cut)
    bad_lines = diagnostics.line_errors(dropped, at, X.LOCAL_HOST, F.col("seq"))
    return bad_rules.unionByName(bad_lines).select("seq", _ts("ts"), "pri", "host", "prog", "msg")


# --- sinks -------------------------------------------------------------------

@query
def file_lines(spark, sf):
    return render.render_file_lines(routed(spark, sf)).select("dest", "seq", "value")


@query
def forward_lines(spark, sf):
    to = routed(spark, sf).filter("sink = 'forward'")
    return (render.render_forward(to, add_host=True, newline=True)
            .groupBy("dest", "value").agg(F.count(F.lit(1)).alias("n")))


@query
def log_table(spark, sf):
    to = routed(spark, sf).filter("sink = 'table'")
    return (render.to_log_table(to).groupBy("facility", "priority", "date", "host")
            .agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"),
                 F.max("message").alias("last_message"))
            .withColumn("date", F.col("date").cast("string")))


@query
def log_table_plain(spark, sf):
    """Without facility and priority columns."""
    return (render.to_log_table(routed(spark, sf), facility=False, priority=False)
            .withColumn("date", F.col("date").cast("string")))


@query
def log_table_ts(spark, sf):
    to = routed(spark, sf).filter("sink = 'table'")
    return render.to_log_table_ts(to).withColumn("timestamp", _ts("timestamp"))


@query
def log_table_ts_batches(spark, sf):
    """The same key over batches that overlap, one of which runs twice."""
    to = routed(spark, sf).filter("sink = 'table'")
    path = f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"
    cut = to.agg(F.expr("percentile_approx(seq, array(0.4, 0.5, 0.8))")).first()[0] or [0, 0, 0]
    parts = [to.filter(F.col("seq") <= cut[1]), to.filter(F.col("seq").between(cut[0], cut[2])), to.filter(F.col("seq") > cut[1])]
    for batch_id, part in ((0, parts[0]), (1, parts[1]), (1, parts[1]), (2, parts[2])):
        rows = render.to_log_table_ts(part)
        committed.write_keyed(rows, path, ["timestamp", "host", "message"], batch_id)
    return committed.read_committed(spark, path, rows.schema).withColumn("timestamp", _ts("timestamp"))


@query
def log_table_seq(spark, sf):
    """Numbered without a global sort."""
    return (render.to_log_table(X.records(spark, sf), number=True)
            .select("seq", F.col("date").cast("string").alias("date"), "time", "host", "message"))


@query
def sql_export(spark, sf):
    rows = X.table(spark, sf, "pages").select(
        F.when(F.col("page_id") % 5 > 0, F.col("url")).alias("host"), F.col("html").alias("message"))
    return render.render_sql(rows, "syslog")


@query
def lookup(spark, sf):
    rows = render.to_log_table(X.records(spark, sf))
    return (render.lookup(rows, date="2024-01-10", time_from="06:00:00", time_to="18:00:00",
                          prefix="view")
            .withColumn("date", F.col("date").cast("string")))


@query
def lookup_table(spark, sf):
    """The same on a written table, partitioned by date."""
    path = f"{shared_dir(spark)}/log-table-{uuid.uuid4().hex}"
    deliver.write_log_table(X.records(spark, sf), path, batch_id=0)
    found = render.lookup(spark.read.parquet(path), date="2024-01-10", time_from="06:00:00",
                          time_to="18:00:00", prefix="view")
    return found.select("facility", "priority", F.col("date").cast("string").alias("date"), "time", "host", "message")


@query
def lookup_indexed(spark, sf):
    """By host, by start of message and by all on a table laid out for such lookups."""
    path = f"{shared_dir(spark)}/log-index-{uuid.uuid4().hex}"
    indexed.write_indexed_log_table(X.records(spark, sf), path, batch_id=0)
    table = spark.read.parquet(path)
    asks = {"host": dict(host="h7"), "start": dict(prefix="purchase[1"),
            "all": dict(date="2024-01-10", time_from="06:00:00", time_to="18:00:00", host="h3", prefix="view")}
    found = [render.lookup(table, **ask).select(
        F.lit(name).alias("ask"), "facility", "priority", F.col("date").cast("string").alias("date"), "time", "host",
        "message") for name, ask in asks.items()]
    return found[0].union(found[1]).union(found[2])


@query
def lost_report(spark, sf):
    dead = routed(spark, sf).select("sink", "seq")
    return diagnostics.lost_report(dead, "2024-06-01 00:00:00", X.LOCAL_HOST).select(
        _ts("ts"), "fac", "sev", "pri", "host", "prog", "msg")


@query
def volume_20min(spark, sf):
    return diagnostics.volume(routed(spark, sf)).select(_ts("slot"), "dest", "n")


@query
def header_text(spark, sf):
    """Time texts of a record: header, ISO date, clock."""
    ts = F.col("o_orderdate")
    return (X.table(spark, sf, "orders")
            .select(clock.header_time(ts).alias("header"), clock.iso_date(ts).alias("date"),
                    clock.clock_text(ts).alias("time"))
            .groupBy("header", "date", "time").agg(F.count(F.lit(1)).alias("n")))


@query
def text_helpers(spark, sf):
    """Chain names, hex both ways, substitution."""
    url = F.col("url")
    return X.table(spark, sf, "pages").select(
        "page_id", text.log_name(url).alias("chain"),
        text.to_hex(F.encode(url, "UTF-8")).alias("hex"),
        F.decode(text.from_hex(text.to_hex(F.encode(url, "UTF-8"))), "UTF-8").alias("back"),
        text.substitute(url, "(http)s?://", "$1:").alias("changed"))


@query
def notify_fanout(spark, sf):
    """Errors to the users named, the gravest to everyone; told per user."""
    alerts = X.table(spark, sf, "events").filter("event_type = 'error'").selectExpr(
        "event_id AS seq",
        "CASE WHEN value > 95 THEN '*' ELSE concat('Customer#', lpad(CAST(user_id AS string), 9, '0'), "
        "',', 'Customer#', lpad(CAST(user_id * 7 % 150 AS string), 9, '0'), ',nobody') END AS users")
    sessions = X.table(spark, sf, "customer").selectExpr(
        "c_name AS user", "CASE c_custkey % 5 WHEN 0 THEN concat('ftp', c_custkey) "
        "WHEN 1 THEN concat('uucp', c_custkey) ELSE concat('tty', c_custkey) END AS terminal")
    # added up per name before the join: an alert to everyone is told on every terminal
    asked = notify.addressees(alerts).groupBy("users").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))
    return (notify.notify_fanout(asked, sessions).groupBy("user", "terminal")
            .agg(F.sum("n").alias("n"), F.sum("seq_sum").alias("seq_sum")))


# --- integrity -----------------------------------------------------------------

@query
def protect(spark, sf):
    """Running keys and the inner digests; the outer ones have no counterpart in SQL."""
    seeds = X.seeds(spark, sf).withColumn("method", F.when(
        F.col("log_id").cast("bigint") % 2 == 0, "sha1").otherwise("md5"))
    return integrity.protect(X.conversations(spark, sf), integrity.init_keys(seeds)).select(
        "log_id", "line_no", text.to_hex(F.col("inner")).alias("inner"),
        F.length("mac").alias("mac_bytes"), text.to_hex(F.col("key")).alias("key"))


@query
def protect_segments(spark, sf):
    """One hot log of rendered lines, cut into chains of 500 lines."""
    lines = integrity.chain_lines(X.records(spark, sf)).select(
        F.lit("hot").alias("log_id"), F.col("seq").alias("line_no"), "line")
    cut = integrity.segments(lines, 500)
    seeds = cut.select("log_id").distinct().select(
        "log_id", F.lit("sha1").alias("method"), F.concat(F.lit("seed-"), "log_id").cast("binary").alias("seed"))
    keys = integrity.init_keys(seeds)
    made = integrity.protect(cut, keys)
    return integrity.last_keys(made, keys).select("log_id", text.to_hex(F.col("last_key")).alias("last_key"))


def _tampered(spark, sf):
    """Lines, keys and digests, with one line of some logs changed or dropped."""
    lines = X.conversations(spark, sf)
    keys = integrity.init_keys(X.seeds(spark, sf))
    made = integrity.protect(lines, keys)
    number = F.col("log_id").cast("bigint")
    changed = F.when((number % 3 == 1) & (F.col("line_no") == number % 4),
                     F.concat("line", F.lit("!"))).otherwise(F.col("line"))
    cut = (number % 7 == 2) & (F.col("line_no") == 1)
    return (lines.withColumn("line", changed).filter(~cut), integrity.last_keys(made, keys),
            made.select("log_id", "line_no", "mac"))


@query
def verify(spark, sf):
    lines, keys, macs = _tampered(spark, sf)
    return integrity.verify(lines, keys, macs)


@query
def verify_parts(spark, sf):
    """The same with the parts of each chain side by side."""
    made = integrity.protect(X.conversations(spark, sf), integrity.init_keys(X.seeds(spark, sf)))
    lines, keys, macs = _tampered(spark, sf)
    return integrity.verify_parts(lines, keys, integrity.checkpoint_keys(made, 2), 2, macs)


@query
def verify_without_macs(spark, sf):
    lines, keys, _ = _tampered(spark, sf)
    return integrity.verify(lines, keys).select("log_id", "status", "lines")


@query
def first_corrupt_line(spark, sf):
    return integrity.first_corrupt_line(*_tampered(spark, sf))


@query
def protect_chain(spark, sf):
    """Running keys of all conversations, by sha1 or md5."""
    seeds = X.seeds(spark, sf).withColumn("method", F.when(
        F.col("log_id").cast("bigint") % 2 == 0, "sha1").otherwise("md5"))
    made = integrity.protect(X.conversations(spark, sf), integrity.init_keys(seeds))
    return made.select("log_id", "line_no", text.to_hex(F.col("key")).alias("key"))


# --- delivery that a crash does not repeat -----------------------------------

def _batches(spark, sf):
    """Forwarded records in two batches."""
    to = routed(spark, sf).filter("sink = 'forward'").select("seq", "ts", "rule_id", "dest", "msg")
    return to, [to.filter("seq % 2 = 0"), to.filter("seq % 2 = 1")]


@query
def committed_batches(spark, sf):
    """A committed log after batches of which one ran twice."""
    to, parts = _batches(spark, sf)
    path = f"{shared_dir(spark)}/committed-{uuid.uuid4().hex}"
    for batch_id, part in ((0, parts[0]), (0, parts[0]), (1, parts[1])):
        committed.write_committed(part, path, batch_id)
    return (committed.read_committed(spark, path, to.schema).groupBy("rule_id", "dest")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum")))


@query
def saved_and_replayed(spark, sf):
    """A save buffer handed out in claims; the second claim is delivered, but its sink fails before it is acknowledged."""
    to, parts = _batches(spark, sf)
    base = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    buffer = committed.SaveBuffer(spark, base, to.schema)
    failing = [1]

    def sink(df, number):
        committed.write_committed(df, f"{base}/out", number)
        if number in failing:
            failing.remove(number)
            raise OSError("lost the connection after delivery")

    for batch_id, part in enumerate(parts):
        buffer.append(part, batch_id)
        try:
            buffer.replay("forward", sink, max(1, buffer.records().count() // 3))
        except OSError:
            pass
    buffer.replay("forward", sink)
    got = committed.read_committed(spark, f"{base}/out", buffer.schema)
    place = F.col("position").bitwiseAND((1 << committed.ROW_BITS) - 1)
    # rules that forward the same record have places side by side, in any order
    return got.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
