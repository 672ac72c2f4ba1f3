"""Log inputs derived from the given tables, for queries, tests and the bench.

Expressions marked *both* read the same in Spark and in the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.operators.parse import parse_lines
from logweave.operators.rules import compile_masks

REF_TS = "2024-06-01 00:00:00"
LOCAL_HOST = "loghost"

# Rules of our own, one or two for each thing that selectors, blocks and filters
# can say: id, selector, program, message, host, date and time patterns, inverse,
# destination, sink. The lines have severities 3 to 7 in all facilities.
_RULE_ROWS = [
    ("whole", "syslog.*", None, None, None, None, None, False, "own.log", "file"),
    ("least", "local2.notice", None, None, None, None, None, False, "tenant2.log", "file"),
    ("groups", "user,local1,local4.info", None, None, None, None, None, False, "groups.log", "file"),
    ("sums", "local6.err;kern.info;cron.debug", None, None, None, None, None, False, "sums.log", "file"),
    ("general", "*.info;local5.none;uucp,ftp.!warn", None, None, None, None, None, False, "general.log", "file"),
    ("exact", "*.=notice;daemon.=info", None, None, None, None, None, False, "steps", "table"),
    ("dead", "user.=warning", None, None, None, None, None, False, "steps", "table"),
    ("cut", "local0,local1.*;local1.!notice", None, None, None, None, None, False, "calm", "table"),
    ("hole", "*.*;ftp.!=info;lpr.!=err", None, None, None, None, None, False, "holes", "table"),
    ("filled", "lpr.!none;uucp.none", None, None, None, None, None, False, "filled", "table"),
    ("comma", "local3.notice,uucp,ftp.err", None, None, None, None, None, False, "comma", "table"),
    ("numbers", "16.5;184.=7", None, None, None, None, None, False, "numbers", "table"),
    ("names", "SECURITY.Error;daemon.warning", None, None, None, None, None, False, "names", "table"),
    ("no_level", "user.loud", None, None, None, None, None, False, "never", "table"),
    ("no_facility", "nowhere.info;user.*", None, None, None, None, None, False, "never", "table"),
    ("no_exact", "cron.=*", None, None, None, None, None, False, "never", "table"),
    ("beat", "mark.info", None, None, None, None, None, False, "beat.log", "file"),
    ("guarded", "local7.*;mark.info", None, None, None, None, None, False, "guarded.log", "file"),
    ("sales", "*.*", "purchase", None, None, None, None, False, "sales.log", "file"),
    ("fresh", "*.notice;mark.*", "signup", None, None, "Jan 2[0-4]", None, False, "fresh.log", "file"),
    ("alarm", "*.err", None, None, None, None, None, False, "dora", "notify"),
    ("loud", "*.warn", None, None, None, None, None, False, "dora,emil,finn", "notify"),
    ("louder", "*.warn", None, None, None, None, None, False, "everyone", "notify"),
    ("no_digits", "*.warning", None, "[[:digit:]]{3}", None, None, None, True, "emil", "notify"),
    ("two_tests", "*.notice", None, "k [{]\"k\": [1-4]", "^h[02468][.]?", None, None, False, "finn", "notify"),
    ("far", "local0,local2,local4.info", None, None, "[5-9]$", None, None, False, "vault", "forward"),
    ("night", "*.err;syslog.none", None, None, None, None, "^0[0-5]:", False, "vault", "forward"),
    ("day", "*.err", None, None, None, None, "^(0[0-5]|2[0-3]):", True, "relay", "forward"),
    ("ledger", "news.notice", None, None, None, None, None, False, "ledger", "table"),
]


#: *both*: a pattern per supplier, the first five kinds are not valid.
BAD_PATTERNS = ("CASE s_suppkey % 9 WHEN 0 THEN '[abc' WHEN 1 THEN '(x' WHEN 2 THEN '[[:word:]]' WHEN 3 THEN '*x' "
                "WHEN 4 THEN 'x[[.long.]]' WHEN 5 THEN '[[]' WHEN 6 THEN 'k {x' WHEN 7 THEN '[]&&a]' "
                "ELSE '[^[:digit:]]{2,3}' END")


#: *both*: a pattern of the grammar per customer, and the same question to the checking engine's patterns.
GRAMMAR = [
    (r"\<error\[", r"\berror\["), ("[[:digit:]]{{3}}.*}}$", "[0-9]{{3}}.*\\}}$"), ("k (x|[{{]\"k\": {n}[[:digit:]]?}})", "k (x|[{{]\"k\": {n}[0-9]?[}}])"),
    ("^(click|view)[[]{n}", "^(click|view)\\[{n}"), ("[^]a-z :[]{{4}}", "[^]a-z :\\[]{{4}}"), ("(a|e|i)+r+o?r\\[.*{n}", "[aei]+r+o?r\\[.*{n}"),
    ("k {{x|{n}[}}]", "k \\{{x|{n}[}}]"),
]


def grammar(ours: bool, string: str) -> str:
    """*both*: the pattern of a customer, in our words or those of the checking engine."""
    kinds = []
    for i, pair in enumerate(GRAMMAR):
        parts = pair[not ours].replace("{{", "\1").replace("}}", "\2").split("{n}")
        quoted = ["'" + p.replace("\1", "{").replace("\2", "}").replace("\\", "\\\\" if string == "string" else "\\") + "'" for p in parts]
        kinds.append(f"WHEN {i} THEN " + f" || CAST(c_custkey % 90 AS {string}) || ".join(quoted))
    return f"CASE c_custkey % {len(GRAMMAR)} {' '.join(kinds)} END"


def grammar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per customer, all of which want the same records; every fifth takes those that do not match."""
    return table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS string) AS rule_id", "'local' || CAST(c_custkey % 3 AS string) || ',auth.info' AS selector",
        "CAST(NULL AS string) AS program", "'all' AS dest", "'file' AS sink", f"{grammar(True, 'string')} AS message_re",
        "CASE WHEN c_custkey % 4 = 0 THEN '^h[0-9]$' END AS host_re", "CAST(NULL AS string) AS date_re",
        "CAST(NULL AS string) AS time_re", "c_custkey % 5 = 0 AS inverse")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession) -> DataFrame:
    rows = [(r[0], i, *r[1:]) for i, r in enumerate(_RULE_ROWS)]
    return spark.createDataFrame(rows, S.RULES)


def rule_values() -> str:
    """The same rules as SQL values ``(rule_id, selector, program, …)``."""
    def show(x):
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) \
            else "'" + str(x).replace("'", "''") + "'"
    return ",\n".join("(" + ", ".join(show(x) for x in r) + ")" for r in _RULE_ROWS)


_LEVEL = ("CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 4 WHEN 'signup' THEN 5 "
          "WHEN 'purchase' THEN 6 ELSE 7 END")


def raw_sql(string: str, month: str, clock: str) -> str:
    """*both*, but for the names of the text type and the two time texts."""
    return (f"'<' || CAST((event_id % 24) * 8 + {_LEVEL} AS {string}) || '>' || {month} || ' ' || "
            f"lpad(CAST(day(ts) AS {string}), 2, ' ') || ' ' || {clock} || ' h' || "
            f"CAST(user_id % 20 AS {string}) || '.example.com ' || event_type || '[' || "
            f"CAST(user_id AS {string}) || ']: k ' || props")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, arrival_ts, line``: a line per event."""
    raw = raw_sql("string", "date_format(ts, 'MMM')", "date_format(ts, 'HH:mm:ss')")
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "ts AS arrival_ts", f"{raw} AS line")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(raw_lines(spark, sf_dir), default_host=LOCAL_HOST, ref_ts=REF_TS,
                       trust_msg_host=True, strip_domain=True)


def compiled(spark: SparkSession) -> DataFrame:
    return compile_masks(rules(spark))


def pick(items: list[str], index: str, string: str) -> str:
    """*both*: one of ``items`` by a computed number."""
    return f"split_part('{'|'.join(items)}', '|', CAST(({index}) % {len(items)} AS {string}) + 1)"


_FACS = ["*", "kern", "mail", "AUTH", "daemon", "syslog", "local0", "local7", "mark", "security",
         "8", "authpriv", "news", "nosuch"]
_LEVELS = ["*", "err", "=warning", "!err", "!=info", "none", "!none", "debug", "Notice", "3",
           "emerg", "panic", "=crit", "!*", "warn", "bogus", "=*", "16"]


def tenant_selector(integer: str) -> str:
    """*both*: a selector per customer."""
    def f(e):
        return pick(_FACS[:-1], e, integer)

    def v(e):
        return pick(_LEVELS[:-3], e, integer)
    odd = pick(_FACS, "c_custkey * 5", integer)
    bad = pick(_LEVELS, "c_custkey * 7", integer)
    return (f"{f('c_custkey')} || ',' || {f('c_nationkey * 3 + 1')} || '.' || {v('c_custkey * 11')} || "
            f"';' || {odd} || '.' || {bad} || ',' || {f('c_custkey + c_nationkey')} || '.' || "
            f"{v('c_nationkey * 7')}")


def tenant_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per customer: as many rules as there are customers."""
    return table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS string) AS rule_id", f"{tenant_selector('int')} AS selector",
        "CAST(NULL AS string) AS program", "c_mktsegment AS dest", "'file' AS sink")


def program_rule(string: str) -> str:
    """*both*: selector and program of a supplier's rule."""
    return (f"'local' || CAST(s_suppkey % 8 AS {string}) || '.' || CASE s_suppkey % 3 WHEN 0 THEN 'info' "
            "WHEN 1 THEN '=err' ELSE '!warning' END || CASE WHEN s_suppkey % 4 = 0 THEN ';cron.*' ELSE '' END AS selector, "
            "CASE s_suppkey % 6 WHEN 1 THEN 'error' WHEN 3 THEN 'click' WHEN 5 THEN 'purchase' END AS program")


def program_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS string) AS rule_id", f"{program_rule('string')}".split(" AS selector, ")[0] + " AS selector",
        program_rule("string").split(" AS selector, ")[1], "'all' AS dest", "'file' AS sink")


def config_text(string: str) -> str:
    """*both*: a line of a customer's rule text per order."""
    return ("CASE WHEN o_orderkey % 5 = 0 THEN '!' || lower(substr(o_orderpriority, 3, 4)) "
            "WHEN o_orderkey % 31 = 0 THEN '#!' WHEN o_orderkey % 37 = 0 THEN '! *' "
            "WHEN o_orderkey % 7 = 0 THEN '# note' WHEN o_orderkey % 11 = 0 THEN '  ' "
            f"ELSE 'local' || CAST(o_orderkey % 8 AS {string}) || '.info' END")


def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS config_id", "o_orderkey AS line_no", f"{config_text('string')} AS text")


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed records that repeat: the event type as message, one host.

    Rule ``all`` takes every event, ``errors`` a single type (one run over
    everything), ``mixed`` two types.
    """
    target = ("explode(CASE event_type WHEN 'error' THEN array('all', 'errors', 'mixed') "
              "WHEN 'click' THEN array('all', 'mixed') ELSE array('all') END) AS rule_id")
    return table(spark, sf_dir, "events").selectExpr(
        target, "CAST(date_trunc('second', ts) AS timestamp_ntz) AS ts", "event_id AS seq",
        "1 AS fac", f"{_LEVEL} AS sev", "'h' AS host", "event_type AS msg", "false AS is_mark")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into pieces of 100 characters, a connection each."""
    return (table(spark, sf_dir, "documents")
            .select(F.col("doc_id").alias("conn_id"), F.posexplode(F.expr(
                "transform(sequence(0, cast((length(text) - 1) div 100 as int)), "
                "i -> substr(text, i * 100 + 1, 100))")).alias("seq", "chunk"))
            .withColumn("seq", F.col("seq").cast("bigint")))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").selectExpr(
        "lower(hex(p_partkey + 4096)) AS addr", "replace(p_name, ' ', '_') AS name",
        "p_brand AS module")


def kernel_oops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel messages with addresses, one per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq",
        "CASE WHEN o_orderstatus = 'F' THEN 'disk full on ' || o_orderpriority "
        "ELSE 'oops at [<' || hex(o_custkey + 4096) || '>] from [<' || "
        "lower(hex(o_orderkey % 2000 + 4096)) || '>] end' END AS line")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "CAST(conv_id AS string) AS log_id", "turn AS line_no", "text AS line")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain per conversation; the method goes by the conversation."""
    return (table(spark, sf_dir, "conversations").select("conv_id").distinct().selectExpr(
        "CAST(conv_id AS string) AS log_id",
        "split_part('sha1|md5|rmd160', '|', CAST(conv_id % 3 AS int) + 1) AS method",
        "CAST(concat('seed-', conv_id) AS binary) AS seed"))
