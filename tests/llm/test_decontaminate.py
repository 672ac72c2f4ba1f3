"""Benchmark search against brute force over all windows, and odd rows."""

import random
from collections import Counter

import pytest

from logweave.llm import decontaminate as D


def shingles(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, t in items:
            v = (t or "").lower().split()
            if not v or not w:
                continue
            k, size = min(5, len(v)), min(len(v), len(w))
            own = shingles(v, k)
            for s in range(len(w) - size + 1):
                win = shingles(w[s:s + size], k)
                both = sum((own & win).values())
                sim = both / (sum((own | win).values()) or 1)
                if sim >= 0.8 and sim > out.get((d, i), (0, 0))[0]:
                    out[d, i] = sim, s
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([2, 5, 9, 25, 40])))) for i in range(25)]
    docs = []
    for d in range(60):
        w = r.choices(vocabulary, k=r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            part = r.choice(items)[1].upper().split()
            for _ in range(r.randrange(3)):
                e = r.randrange(len(part))
                part[e:e + r.randrange(2)] = ["edit"] * r.randrange(2)
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((d, " ".join(w)))
    want = brute(docs, items)
    assert want
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(x.doc_id, x.item_id): (x.similarity, x.start) for x in got}
    assert found == want


def test_index_finds_all_within_radius():
    import numpy as np
    r = np.random.default_rng(1)
    fps = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    index = D.BlockIndex(fps, 6)
    for _ in range(100):
        fp = int(fps[r.integers(300)])
        for b in r.choice(64, r.integers(9), replace=False):
            fp ^= 1 << int(b)
        assert index.near(fp) == [i for i, x in enumerate(fps.tolist()) if (x ^ fp).bit_count() <= 6]


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(None, item, "x"), (1, None, None), (2, "", "x"), (3, item, "x"), (3, item, "y"),
         (4, "word " * 200_000 + item.upper(), "x"), (5, "clean", "x")],
        "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "")],
                                  "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.similarity, r.start) for r in D.contaminated(docs, items).collect())
    assert got == [(-1, 7, 1.0, 0), (3, 7, 1.0, 0), (3, 7, 1.0, 0), (4, 7, 1.0, 200_000)]
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0
