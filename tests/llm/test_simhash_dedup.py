"""Fingerprints and components against brute force, big groups, odd rows."""

import random

import numpy as np
import pytest
import xxhash

from logweave.llm import simhash_dedup as S


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return groups.values()


def test_fingerprint():
    r = random.Random(1)
    for _ in range(200):
        t = " ".join(r.choices(["The", "a", "É", "x y", "b"], k=r.randrange(12)))
        assert S.fingerprint(t) == plain_fingerprint(t)
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0


@pytest.mark.parametrize("seed,limit", [(1, 512), (2, 3), (3, 1)])
def test_links_connect_all_within_three_bits(spark, seed, limit):
    r = np.random.default_rng(seed)
    fps = set()
    for _ in range(15):
        at = int(r.integers(0, 1 << 63)) * 2 + int(r.integers(2))
        for _ in range(int(r.integers(1, 30))):
            fps.add(at)
            for b in r.choice(64, int(r.integers(1, 5)), replace=False):
                at ^= 1 << int(b)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {}
    for x in S.components(S.links(df, limit)).collect():
        got.setdefault(x.component, set()).add(int(np.int64(x.node).view(np.uint64)))
    want = [g for g in components_of(fps) if len(g) > 1]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_rows(spark):
    r = random.Random(4)
    base = " ".join(f"w{r.randrange(500)}" for _ in range(400))
    near = base.replace(base.split()[200], "changed", 1)
    rows = [(5, base), (3, base), (3, base), (9, near), (None, base), (7, None), (8, ""), (11, "other words here"),
            (None, "alone without id"), (1, "x " * 100_000)]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, fp string")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fp = {}
    for d, t in rows:
        fp.setdefault(plain_fingerprint(t), []).append(d)
    groups = components_of(fp)
    want = {}
    for g in groups:
        ids = [d for f in g for d in fp[f] if d is not None]
        for f in g:
            want[f] = min(ids) if ids else None
    for x in got:
        assert x.component_id == want[int(np.int64(x.fp).view(np.uint64))]
    kept = S.deduplicate(df)
    assert kept.columns == df.columns
    ids = sorted((x.doc_id if x.doc_id is not None else -1) for x in kept.collect())
    assert ids == sorted(-1 if v is None else v for v in (want[next(iter(g))] for g in groups))
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.deduplicate(df.limit(0)).count() == 0
