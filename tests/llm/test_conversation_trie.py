"""Nodes against brute force over all prefixes, for several container sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from logweave.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string, ids string, depth int, heads string, t string"


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            key = hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest()
            convs[c].append((t is not None, t or 0, key[:32], r or "", x or ""))
    own = {c: [a[3:] for a in sorted(v)] for c, v in convs.items()}
    whole, members, kids = {}, defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + v[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


def nodes(spark, rows, limit, extra=(None, 1, "h", "t")):
    df = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3)
    got = C.trie(C.rebuild(C.sequences(df)), limit)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    return sorted(map(tuple, got.collect()), key=repr)


def rows(seed):
    rng = random.Random(seed)
    out = []
    words = ["", "a", "b", "ü" * 3, None, "a long text " * 20]
    for c in rng.sample(range(-300, 900), 260):
        n = rng.choice([0, 1, 2, 3, 5, 8, 30])
        out += [(c, t if t else rng.choice([0, None]), rng.choice(["user", "bot", None]), rng.choice(words)) for t in range(n)]
    long = [(t, "user", rng.choice(words)) for t in range(60)]
    for c in (1000, 1003, 1007, 1009, 1100, 1101):  # long common beginnings
        out += [(c, *x) for x in long[:rng.choice([40, 50, 60])]] + [(c, 99, "bot", str(c))]
    for c in range(2000, 2300):  # copies, some of them in the same hundred
        out += [(c, t, "user", "same") for t in range(7)]
    out += [(5001, 3, "user", "tie"), (5001, 3, "bot", "tie"), (5001, 3, "user", "tie"), (None, 1, "user", "lost"), (5002, None, None, None)]
    return out


@pytest.mark.parametrize("seed,limit", [(1, 1024), (1, 30), (2, 1), (3, 5)])
def test_brute(spark, seed, limit):
    given = rows(seed)
    assert nodes(spark, given, limit) == brute(given)


def test_registered(spark, sf):
    import __spark_entry__ as entry
    got = entry.queries()["op13_conversation_trie"](spark, sf)
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(given)


def test_pieces_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 7)
    given = [(c, 0, "user", "one") for c in range(6000, 6100)]
    assert nodes(spark, given, 10) == brute(given)


def test_empty_and_turnless(spark):
    assert nodes(spark, [], 10) == []
    assert nodes(spark, [(None, 1, "user", "x")], 10) == []
    # a conversation whose own turns are all replaced and whose hundred has no first conversation
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = nodes(spark, [(alone, 0, "user", "x")], 10)
    assert got == brute([(alone, 0, "user", "x")]) and len(got) == 1 and got[0][1:4] == (0, None, 1)
