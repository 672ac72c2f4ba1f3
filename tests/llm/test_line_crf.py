"""Chains against sums over all labellings, gradients, learning, odd rows."""

import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import line_crf as C
from logweave.llm.queries import op10_quality_classifier


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    texts = ["a b\nC!! D\n\n## x\nlast", "", None, "one", "x x x\ny"]
    bins, _, first = C.line_bins(pa.array(texts))
    model = C.Model(r.normal(size=C._SIZE), r.normal(size=(2, 2)), 0.4)
    got = C.marginals(bins, first, model)
    scores = model.weights[C._features(bins, first)].sum(1)
    assert np.diff(first).tolist() == [4, 0, 0, 1, 2]
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, good = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=int(b - a)):
            s = (model.start * y[0] if y else 0) + sum(scores[a + i] * v for i, v in enumerate(y))
            s += sum(model.moves[y[i], y[i + 1]] for i in range(len(y) - 1))
            total += math.exp(s)
            good += math.exp(s) * np.array(y)
        assert np.allclose(got[a:b], good / total)


def test_score_is_length_weighted_and_defined_for_odd_rows(spark):
    r = random.Random(1)
    clean = lambda: "\n".join(" ".join(r.choices(["hello", "there", "words,", "go."], k=12)) for _ in range(r.randrange(1, 6)))
    junk = lambda: "\n".join("BUY!! NOW!! ###" * 6 for _ in range(r.randrange(1, 6)))
    rows = [(i, clean() if i % 3 else junk(), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (1, None), (5000, 0)],
                                   "doc_id long, quality int")
    df = spark.createDataFrame(rows + [(None, None, "s"), (900, "", "s"), (901, "\n \n", "s"), (1, rows[1][1], "s"),
                                       (902, "hello there\n" * 50_000, "s")], "doc_id long, text string, score string")
    model = C.fit(df, labels)
    got = C.score(df, model).collect()
    assert len(got) == df.count() and all(0 <= x.score <= 1 for x in got)
    for x in got:
        if x.doc_id is not None and x.doc_id < 300:
            assert (x.score > 0.5) == (x.doc_id % 3 > 0)
        elif x.doc_id != 902:
            assert x.score == model.empty
    kept = C.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(x.score >= C.THRESHOLD for x in got)
    assert {x.score for x in C.score(df, C.fit(df, labels.limit(0))).collect()} == {0.5}
    assert C.score(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    got = {x.doc_id: x for x in op10_quality_classifier(spark, base).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{base}/labels.parquet'").fetchall()
    held = [(got[d].predicted, q) for d, q in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(x.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, x in got.items())
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) > 0.97
