"""Operators that return all columns keep those whose names are like internal ones."""

import pytest

from logweave.llm import simhash_dedup, substring_dedup

SCHEMA = "doc_id long, text string, _row string, starts string, copy string, id string, fp string, _rest int, _text int, _new int"
LONG = " ".join(f"word{i}" for i in range(40))


@pytest.fixture
def docs(spark):
    given = [(1, LONG), (2, LONG), (3, "other words " + LONG), (None, None), (4, ""), (4, ""), (5, "short text")]
    return spark.createDataFrame([(i, t, f"r{n}", "s", "c", "i", "f", n, n + 1, None) for n, (i, t) in enumerate(given)], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_remove_repeats(docs):
    got = substring_dedup.remove_repeats(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    rest = [c for c in docs.columns if c != "text"]
    assert rows(got.select(rest)) == rows(docs.select(rest))
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, LONG), (2, ""), (3, "other words"), (None, None), (4, ""), (5, "short text")}
    assert substring_dedup.remove_repeats(docs.filter("false")).collect() == []


def test_deduplicate(docs):
    got = simhash_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    kept = rows(got)
    assert set(kept) <= set(rows(docs)) and sorted(r[0] for r in kept) in ([1, 3, 4, 5], [1, 4, 5])
    assert simhash_dedup.deduplicate(docs.filter("false")).collect() == []
