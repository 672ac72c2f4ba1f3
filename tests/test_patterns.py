"""The grammar of patterns against a plain matcher, in Java and in Python; many patterns at once."""

import random
import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logweave.functions import posix as P
from logweave.operators import filters, parse, route, rules
from logweave.operators.patterns import PatternSet
from logweave.plans import fixtures as X


def ends(node, text, at):
    """All places where a match of ``node`` that begins at ``at`` ends; sets of places, no engine."""
    k = node.kind
    if k == "char":
        return {at + 1} if text[at:at + 1] == node.text else set()
    if k == "set":
        return {at + 1} if at < len(text) and any(a <= text[at] <= b for a, b in node.ranges) != node.negated else set()
    if k in ("begin", "end"):
        return {at} if at == (0 if k == "begin" else len(text)) else set()
    if k == "edge":
        def word(i):
            return 0 <= i < len(text) and text[i].isascii() and (text[i].isalnum() or text[i] == "_")
        left, right = word(at - 1), word(at)
        return {at} if {"<": right and not left, ">": left and not right, "b": left != right, "B": left == right}[node.text] else set()
    if k == "alt":
        return set().union(*(ends(p, text, at) for p in node.parts))
    if k == "cat":
        now = {at}
        for p in node.parts:
            now = set().union(*(ends(p, text, a) for a in now)) if now else now
        return now
    now, out = {at}, {at} if node.least == 0 else set()
    for n in range(1, (node.most if node.most is not None else node.least + len(text) + 1) + 1):
        now = set().union(*(ends(node.parts[0], text, a) for a in now)) if now else now
        new = now - out
        if n >= node.least:
            out |= now
            if not new:
                break
    return out


def matches(pattern, text):
    node = P.parse(pattern)
    return any(ends(node, text, a) for a in range(len(text) + 1))


ATOMS = ["a", "b", ".", "x", "[ab]", "[^a]", "[[:alpha:]]", "[^[:digit:]_]", "[a-c9]", "[]x]", "[a-]", "\\.", "\\*", " ", "é", "{", "}",
         "]", "\\<", "\\>", "\\b", "\\w", "\\S", "^", "$", "[[.-.]]", "[[=a=]]", "&", "-", "#", "\"", "1"]
COUNTS = ["", "", "", "*", "+", "?", "{2}", "{1,}", "{0,2}", "{,1}", "**"]


def make(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        piece = "(" + make(rng, depth + 1) + ")" if depth < 2 and rng.random() < 0.25 else rng.choice(ATOMS)
        out.append(piece + rng.choice(COUNTS))
    return "".join(out) + ("|" + make(rng, depth + 1) if depth < 2 and rng.random() < 0.2 else "")


def test_fuzz(spark):
    rng = random.Random(7)
    good, texts = {}, ["", "a", "ab b", "xé1", "a.b*", "{a}", "aab-", "_1 a&", "b\nx", "]x]", "99 \"ca\" #"]
    for _ in range(4000):
        p = make(rng) if rng.random() < 0.8 else "".join(rng.choice("ab[]()*+?{}|^$\\.:-1,<>") for _ in range(rng.randrange(1, 8)))
        java = P.java(p)
        if java is None:
            with pytest.raises(P.NoPattern):
                P.parse(p)
        else:
            good[p] = java
    assert 1500 < len(good) < 3900
    compiled = spark._jvm.java.util.regex.Pattern
    for p, java in good.items():
        compiled.compile(java)  # raises for what Java does not take
        ours, first = re.compile(P.python(p)), P.literals(P.parse(p))
        for t in texts:
            want = matches(p, t)
            assert (ours.search(t) is not None) == want, (p, t)
            if want and first:
                assert any(x in t for x in first), (p, t, first)
    some = rng.sample(sorted(good), 150)
    df = spark.createDataFrame([(k, t) for k in range(1) for t in texts], "k int, t string").coalesce(1)
    for i in range(0, len(some), 50):
        part = some[i:i + 50]
        for r in df.select("t", *[F.col("t").rlike(good[p]).alias(f"c{j}") for j, p in enumerate(part)]).collect():
            for j, p in enumerate(part):
                assert r[f"c{j}"] == matches(p, r.t), (p, r.t)


@pytest.mark.parametrize("bad", ["", "a|", "|a", "()", "(a", "a)", "*a", "+", "^*", "$+", "(|a)", "a{3,2}", "a{40000}", "[a", "[]", "[z-a]",
                                 "[a-[:digit:]]", "[[:nope:]]", "[[.long.]]", "\\", "\\d", "\\1", "\\`", "(?:a)", "(?P<n>a)", "(?|a|b)",
                                 "\\m", "x\\K", "(?#c)a", "a(*b)", "{1}", "\\<*", "é\\é", "(" * 5000 + "a" + ")" * 5000])
def test_outside_the_grammar(bad):
    assert P.java(bad) is None and P.java(None) is None


@pytest.mark.parametrize("pattern,text,hit", [
    (r"\<err\>", "abc err", True), (r"\<err\>", "abc errs", False), ("a$", "a\n", False), ("a.b", "a\nb", True), ("k {x", "k {x", True),
    ("[a&&b]", "&", True), ("(a|b)*c", "x" * 10 + "c", True), ("a{,2}b", "aaab", True), ("^a{,2}b", "aaab", False), ("[[:upper:]]", "É", False)])
def test_meaning(spark, pattern, text, hit):
    assert matches(pattern, text) == hit == (re.search(P.python(pattern), text) is not None)
    df = spark.createDataFrame([(text,)], "msg string")
    assert df.filter(F.col("msg").rlike(P.java(pattern))).count() == hit


def test_choice_of_characters_takes_long_texts(spark):
    df = spark.range(1).select(F.expr("repeat('ab', 200000)").alias("msg"))
    assert df.filter(filters.passes(message_re="^(a|b|[cd])*$")).count() == 1


def test_thousands_of_patterns_cost_little():
    rng = random.Random(1)
    texts = [" ".join(f"word{rng.randrange(50_000)}" for _ in range(12)) for _ in range(20_000)]
    patterns = [(i, f"( word{i * 7} |text{i} ).*word[0-9]{{2,}}$") for i in range(5000)]
    took = []
    for n in (10, 5000):
        found = PatternSet(patterns[:n])
        for t in texts:  # patterns are compiled when first met
            found.matching(t)
        start = time.perf_counter()
        got = [found.matching(t) for t in texts]
        took.append(time.perf_counter() - start)
    plain = [re.compile(P.python(p)) for _, p in patterns]
    for t, hits in list(zip(texts, got, strict=True))[:20]:
        assert hits == [i for i, p in enumerate(plain) if p.search(t)]
    assert took[1] < 3 * took[0] + 0.2, took


def _rules():
    tests = [("m", "*.*", None, "error", None, None, None, False), ("n", "*.*", None, "[0-9]{3}", None, None, None, True),
             ("both", "*.*", None, "k .*1", "h1", None, None, False), ("prog", "*.*", "click", "click", None, "Jan", None, False),
             ("bad", "*.*", None, "(x", None, None, None, False), ("free", "*.err", None, None, None, None, None, False),
             ("none", "*.*", None, "e", "h", None, None, True), ("dead", "*.=warning", None, "c", None, None, None, False)]
    tests += [(f"t{i}", f"local{i % 8}.*", None, f"\"k\": {i}[}}]", None, None, None, i % 5 == 0) for i in range(90)]
    return [(r[0], i, *r[1:], "d", "s") for i, r in enumerate(tests)]


def test_all_ways_agree(spark, sf):
    from logweave import schema as S
    table = spark.createDataFrame(_rules(), S.RULES)
    more = spark.createDataFrame([("m", None, None, None, "^1", False), ("m", "zzz", None, None, None, True)],
                                 "rule_id string, message_re string, host_re string, date_re string, time_re string, inverse boolean")
    chain = table.select(more.columns).unionByName(more)
    lines = X.raw_lines(spark, sf)
    records = parse.parse_lines(lines, default_host="l", ref_ts=X.REF_TS, trust_msg_host=True, strip_domain=True)
    records = records.withColumn("host", F.when(F.col("seq") % 9 > 0, F.col("host"))).withColumn(
        "msg", F.when(F.col("seq") % 11 > 0, F.col("msg")))
    compiled = rules.compile_masks(table)
    cols = ["seq", "rule_id", "dest", "sink"]
    routed = route.route(records, compiled)
    worker = rows(filters.apply_filters(routed, chain, max_literal=2).select(cols))
    once = filters.route_matching(records, compiled, chain)
    assert once.columns == routed.columns
    assert rows(once.select(cols)) == worker
    assert rows(filters.route_matching(records, compiled, chain, max_patterns=1).select(cols)) == worker
    few = table.filter("rule_id NOT LIKE 't%'").select(more.columns).unionByName(more)
    some = rules.compile_masks(table.filter("rule_id NOT LIKE 't%'"))
    literal = rows(filters.apply_filters(route.route(records, some), few).select(cols))
    assert rows(filters.route_matching(records, some, few).select(cols)) == literal
    assert literal == [r for r in worker if not r[1].startswith("t")]
    none = table.select(more.columns).filter("rule_id = 'free'")
    assert rows(filters.route_matching(records, some, none).select(cols)) == rows(route.route(records, some).select(cols))


def test_totals_are_those_of_the_matched_rows(spark, sf):
    """Inverse rules by what they bar, others by what they must find; null fields and numbers, rules that come twice or ask the same."""
    from logweave import schema as S
    table = spark.createDataFrame([*_rules(), *[(f"again{r[0]}", *r[1:]) for r in _rules()], *_rules()[5:12]], S.RULES)
    more = spark.createDataFrame([("m", None, None, None, "^1", False), ("m", "zzz", None, None, None, True),
                                  ("none", "k", None, None, "^0", True), ("none", "error", None, None, None, True)],
                                 "rule_id string, message_re string, host_re string, date_re string, time_re string, inverse boolean")
    chain = table.select(more.columns).unionByName(more)
    records = parse.parse_lines(X.raw_lines(spark, sf), default_host="l", ref_ts=X.REF_TS, trust_msg_host=True, strip_domain=True)
    records = records.withColumn("host", F.when(F.col("seq") % 9 > 0, F.col("host"))).withColumn(
        "msg", F.when(F.col("seq") % 11 > 0, F.col("msg"))).withColumn("sev", F.when(F.col("seq") % 13 > 0, F.col("sev")))
    records = records.withColumn("num", F.when(F.col("prog") != "click", F.col("seq")))
    compiled = rules.compile_masks(table)
    want = rows(filters.route_matching(records, compiled, chain).groupBy("rule_id").agg(F.count(F.lit(1)), F.sum("num")))
    assert len(want) > 80 and ("prog", want[[r[0] for r in want].index("prog")][1], None) in want
    assert rows(filters.match_totals(records, compiled, chain, {"s": "num"})) == want
    single = rules.compile_masks(table.dropDuplicates(["rule_id"]))
    want = rows(filters.match_totals(records, single, chain))
    assert rows(filters.match_totals(records, single, chain, max_patterns=1)) == want


def test_totals_of_many_inverse_rules(spark):
    """Rules of which no pattern must match do not meet each record: two rules a class, and a hit per record."""
    n = 40_000
    records = spark.range(n).selectExpr("id AS seq", "16 AS fac", "6 AS sev", "'p' AS prog", "concat('m', id % 50, '.') AS msg", "'h' AS host",
                                        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts")
    table = spark.range(10_000).selectExpr(
        "CAST(id AS string) AS rule_id", "'*.*' AS selector", "CAST(NULL AS string) AS program", "'all' AS dest", "'file' AS sink",
        "concat('m', id % 100, '[.]') AS message_re", "true AS inverse")
    df = filters.match_totals(records, rules.compile_masks(table), table, {"s": "seq"})  # 400 million pairs
    assert rows(df.groupBy("n").count()) == [(n, 5_000), (n - n // 50, 5_000)]
    assert df.filter("rule_id = '3'").first().s == n * (n - 1) // 2 - sum(range(3, n, 50))


def test_rejected_rules_do_not_stop_a_job(spark):
    table = spark.createDataFrame([("a", "(?P<n>a)", False), ("b", "x\\K", False), ("c", "fine", False)],
                                  "rule_id string, message_re string, inverse boolean")
    assert rows(filters.rejected_filters(table).select("rule_id")) == [("a",), ("b",)]
    df = spark.createDataFrame([(i, "fine") for i in "abc"], "rule_id string, msg string") \
        .withColumn("host", F.lit("h")).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    for most in (62, 0):
        assert rows(filters.apply_filters(df, table, max_literal=most).select("rule_id")) == [("c",)]
