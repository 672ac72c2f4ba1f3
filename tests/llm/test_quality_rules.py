"""Counts and likelihood ratios against plain Python, and odd rows."""

import math
import random
import re
from collections import Counter

import pytest
import regex
import xxhash

from logweave.llm import quality_rules as Q


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*parts):
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return signed(seed)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def grams(t, buckets):
    w = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", t or "")
    return [xx(x) % buckets for x in w] + [xx(w[i - 1] if i else None, w[i]) % buckets for i in range(len(w))]


def base(t):
    w = words(t)
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))


@pytest.mark.parametrize("buckets", [64, 1 << 16])
def test_equals_plain_python(spark, buckets):
    r = random.Random(buckets)
    make = lambda: r.choice([" ", "\n", "\t "]).join(r.choices(["a", "bé", "c##", "D!!", "|", "x,", "<e>", "foo,bar", "$$$w", "«é»", "…x—9"], k=r.randrange(90)))
    rows = [(i, make(), "c") for i in range(60)] + [(None, "a a a a", "c"), (3, None, "c"), (3, "", "c"),
                                                    (100, "w " * 50_000, "c"), (101, "same\n" * 80, "c")]
    trusted = [(i,) for i in range(0, 40)] + [(None,), (5,), (777,)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = Q.judge(df, spark.createDataFrame(trusted, "doc_id long"), buckets=buckets, threshold=0.0).collect()
    raw, good = Counter(), Counter()
    ids = {t for t, in trusted if t is not None}
    for d, t, _ in rows:
        raw.update(grams(t, buckets))
        if d in ids:
            good.update(grams(t, buckets))
    shift = math.log((sum(raw.values()) + buckets) / (sum(good.values()) + buckets))
    want = []
    for d, t, _ in rows:
        b, g = base(t), grams(t, buckets)
        ratio = sum(math.log((good[x] + 1) / (raw[x] + 1)) + shift for x in g) / len(g) if g else 0.0
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want.append((d, *b, failed, not failed and ratio >= 0, round(ratio, 4)))
    key = lambda x: tuple(str(v) for v in x)
    have = sorted(((*x[:8], round(x[8], 4)) for x in got), key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:7] == b[:7] and abs(a[8] - b[8]) < 2e-4
        assert a[7] == b[7] or abs(b[8]) < 2e-4


def test_empty_and_untrusted(spark):
    df = spark.createDataFrame([(1, "one two " * 40)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert [x.log_ratio for x in Q.judge(df, none).collect()] == [0.0]
    assert Q.judge(df.limit(0), none).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    plan = Q.judge(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ngrams_are_hashed_in_generated_code(spark):
    df = spark.createDataFrame([(1, "one, two"), (2, None), (3, "")], "_row long, text string")
    found = Q._ngrams(df, "text", ["_row"], 1 << 16)
    assert sorted(map(tuple, found.collect())) == sorted((1, g) for g in grams("one, two", 1 << 16))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
