"""Scans against SQL that compares all blocks with all templates, and against plain sets."""

import re

import duckdb
import pytest

from logweave.llm import license_scan as L

NOTICES = dict((a, t) for a, t in L.TEMPLATES)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(L.WORD, lower)


def brute(text, templates=L.TEMPLATES, containment=0.8):
    """(label, start, containment) of all blocks that reach the containment."""
    sets = [(a, set(words(t))) for a, t in templates]
    step = max(len(words(t)) for _, t in templates)
    w = words(text)
    out = []
    for at in range(0, len(w), step):
        block = set(w[at:at + 2 * step])
        out += [(a, at, len(s & block) / len(s)) for a, s in sets if 10 * len(s & block) >= 10 * containment * len(s)]
    return sorted(out)


def texts():
    filler = "lorem ipsum dolor sit amet é ü 12 " * 30
    yield from (None, "", " \n ", "#!$", "MIT License", "mit-LICENSE mit license", "cc by", "CC BY-NC 4.0", "gnu general public license " * 3)
    for _, t in L.TEMPLATES:
        yield t.upper()
        yield filler + t + filler
        yield " ".join(t.split()[:int(len(t.split()) * .85)])
        yield " ".join(w for k, w in enumerate(t.split()) if k % 6)
        yield " ".join(w for k, w in enumerate(t.split()) if k % 3)
    yield filler * 3 + " ".join(t for _, t in L.TEMPLATES) + filler
    yield "the of and to any this license software " * 4000
    yield "x" * 300_000 + " apache license"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "text", 1, "l") for i, t in enumerate(texts())]
    rows += [(None, "MIT license", "t", 1, "l"), (4, rows[4][1], "t", 1, "l"), (4, "other", None, 1, "l")]
    return spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int, template string").repartition(3)


def test_same_as_sql(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(L.scan_sql()).fetchall(), key=repr)
    got = sorted(map(tuple, L.scan(docs).collect()), key=repr)
    assert got == want and len(got) == docs.count()


def test_blocks(spark, docs):
    got = L.find_blocks(docs).collect()
    want = sorted(((r.doc_id, *b) for r in docs.collect() for b in brute(r.text)), key=repr)
    assert sorted(((r.doc_id, r.label, r.start, r.containment) for r in got), key=repr) == want
    assert {r.label for r in got} == {a for a, _ in L.TEMPLATES}


def test_nested_notices(spark):
    df = spark.createDataFrame([(k, NOTICES[a]) for k, a in enumerate(("gpl", "lgpl", "cc-by", "cc-by-nc"))], "doc_id int, text string")
    assert {r.doc_id: (r.labels, r.score) for r in L.scan(df, phrases={}).collect()} == {
        0: ("gpl", 1.0), 1: ("lgpl", 1.0), 2: ("cc-by", 1.0), 3: ("cc-by-nc", 1.0)}


def test_places(spark):
    df = spark.createDataFrame([(1, "a MIT, License mit license. apache\nlicense"), (2, "mit licenses"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: tuple(r)[1:] for r in L.scan(df).collect()}
    assert got == {1: (7, 3, 1, 5, "apache,mit", "apache,mit", 1.0), 2: (2, 0, None, None, "", "", 0.0),
                   3: (0, 0, None, None, "", "", 0.0)}


def test_other_templates(spark, docs):
    own = [("x", "lorem ipsum dolor"), ("y", "!!"), ("z", "never seen words here")]
    got = L.find_blocks(docs, own, 1.0).collect()
    assert {r.label for r in got} == {"x"}
    assert sorted(((r.doc_id, r.start) for r in got), key=repr) == sorted(
        ((r.doc_id, at) for r in docs.collect() for _, at, _ in brute(r.text, [own[0], own[2]], 1.0)), key=repr)
    assert L.find_blocks(docs, []).count() == 0
    assert L.scan(docs, []).filter("score = 1").count() == L.scan(docs).filter("n_base > 0").count()


def test_empty(spark, docs):
    none = docs.filter("false")
    assert L.scan(none).collect() == [] and L.find_blocks(none).collect() == []
