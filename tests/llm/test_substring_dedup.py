"""Removed passages against brute force, with small groups and odd rows."""

import random

import pytest

from logweave.llm import substring_dedup as S


def brute(docs, window=20):
    seen, out = set(), []
    for d, text in sorted(docs, key=lambda x: x[0]):
        w = (text or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def texts(seed, n=80):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(40)]
    passages = [" ".join(r.choices(v, k=r.choice([19, 20, 21, 45, 90]))) for _ in range(6)]
    for d in range(n):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choices(v, k=r.randrange(1, 40)))
                 for _ in range(r.randrange(5))]
        yield d, r.choice([" ", "\n", "  \t"]).join(parts)
    yield n, "same " * 300
    yield n + 1, "a b " * 60


@pytest.mark.parametrize("seed,long,split", [(1, 5000, 20000), (2, 2, 5), (3, 1, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, long, split):
    monkeypatch.setattr(S, "LONG_PREFIX", long)
    monkeypatch.setattr(S, "SPLIT", split)
    docs = list(texts(seed))
    copies = [(1000 + k, docs[k % 20][1]) for k in range(40)]
    docs += copies
    df = spark.createDataFrame(random.Random(seed).sample(docs, len(docs)), "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.cut_repeats(df).collect())
    want = brute(docs)
    assert sum(w[2] for w in want) > 1000
    assert got == want


@pytest.mark.parametrize("split,both", [(20000, False), (3, False), (20000, True)])
def test_windows_with_one_path_are_told_apart(spark, monkeypatch, split, both):
    """With one bit left of the hash in the path, the second hash decides; with one bit of both, nothing does."""
    whole = S.rolling

    def one_bit(h, k, *root):
        out = whole(h, k, *root)
        return out if k <= S.ANCHOR or (root and not both) else out & S.np.uint64(1 << 63)

    monkeypatch.setattr(S, "rolling", one_bit)
    monkeypatch.setattr(S, "SPLIT", split)
    docs = list(texts(7, 40))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept)
                 for r in S.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert (got == brute(docs)) != both


def test_remove_keeps_columns_and_untouched_texts(spark):
    long = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(1, "a  b\nc", "s", 5), (2, long, "s", 1), (3, "new " + long + "  tail", None, 2),
                                (4, None, "s", 3)], "doc_id long, text string, id string, _row long") \
        .withColumnRenamed("_row", "n")
    got = {r.doc_id: r.text for r in S.remove_repeats(df).collect()}
    assert S.remove_repeats(df).columns == df.columns
    assert got == {1: "a  b\nc", 2: long, 3: "new tail", 4: None}


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(25))
    df = spark.createDataFrame([(None, long, "c"), (5, long, "c"), (5, long, "d"), (6, None, "c"), (7, "", "c"),
                                (8, "z " + long * 1, "c")], "doc_id long, text string, start string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in S.cut_repeats(df).collect())
    assert got == [(-1, 25, 25), (5, 25, 0), (5, 25, 25), (6, 0, 0), (7, 0, 0), (8, 26, 25)]
    assert S.cut_repeats(df.limit(0)).count() == 0
