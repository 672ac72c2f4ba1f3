"""Trees and codes against plain k-means in integers, odd vectors, clashing columns."""

import hashlib

import numpy as np
import pytest

from logweave.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, `_label` string, v string"


def nearest(x, books):
    """(parts, points) indexes and distances, all pairs compared."""
    d = ((x[:, :, None] - books[:, None]) ** 2).sum(3)
    return d.argmin(2), d.min(2)


def brute(rows, parts=16, entries=64, rounds=2):
    """Rows (id, code, error, label_error) and the digest."""
    fine = [(i, v, y) for i, v, y in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    if not fine:
        return [], None
    width = -(-max(1, *(len(v) for _, v, _ in fine)) // parts) * parts
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(c)) for c in r[1]]))
    x = np.zeros((len(fine), width), np.int64)
    for k, (_, v, _) in enumerate(fine):
        x[k, :len(v)] = np.clip(np.floor(256 * np.float32(v).astype(float)), -(1 << 24), 1 << 24)
    x = x.reshape(len(fine), parts, -1).swapaxes(0, 1)
    books = x[:, :entries].copy()
    for _ in range(rounds):
        code, _ = nearest(x, books)
        for p in range(parts):
            for e in np.unique(code[p]):
                own = x[p][code[p] == e]
                books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    code, d = nearest(x, books)
    error = d.sum(0)
    total = {}
    for (_, _, y), e in zip(fine, error, strict=True):
        total[y] = total.get(y, 0) + int(e)
    out = [(i, "".join(f"{c:02x}" for c in code[:, k]), int(error[k]), total[y]) for k, (i, _, y) in enumerate(fine)]
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(out, key=repr), digest


def run(df):
    codes = V.encode(df)
    got = V.label_errors(codes.table)
    assert got.columns == ["id", "label", "code", "error", "label_error"]
    return sorted(((r.id, r.code, r.error, r.label_error) for r in got.collect()), key=repr), codes.digest()


@pytest.mark.parametrize("n", [1, 2, 17, 300, 3000])
def test_trees(n):
    rng = np.random.default_rng(n)
    for x in ((rng.normal(0, .12, (4, n, 4)) * 256).astype(np.int64), rng.integers(-2, 3, (3, n, 2)),
              np.ones((2, n, 3), np.int64), (rng.normal(0, 1, (2, n, 3)) * (1 << 24)).astype(np.int64)):
        parts = len(x)
        trees = V.build_trees(x)
        low, count = trees["low"].astype(int), trees["count"].astype(int)
        flat = x.reshape(parts * n, -1)
        assert sorted(trees["order"]) == list(range(parts * n))
        for b in rng.integers(0, len(low), 100):
            own = flat[trees["order"][low[b]:low[b] + count[b]]]
            assert (own.sum(0) == trees["sums"][b]).all()
            assert np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max() <= trees["radius"][b] * (1 + 1e-9) + 1e-6
            assert trees["left"][b] >= 0 or count[b] <= V.LEAF or trees["radius"][b] == 0
        books = x[:, :64].copy()
        balls, owners, places, chosen = V.assign(x, trees, books)
        code = np.full(parts * n, -1)
        code[trees["order"][V._ranges(low[balls], count[balls])]] = np.repeat(owners, count[balls])
        code[places] = chosen
        assert count[balls].sum() + len(places) == parts * n
        assert (code.reshape(parts, n) == nearest(x, books)[0]).all()


def test_lists_shrink():
    rng = np.random.default_rng(5)
    x = (rng.normal(0, .02, (1, 4000, 2)) * 256).astype(np.int64)
    x[0, :2000] += 5000
    books = np.array([[[0, 0], [5000, 5000]]])
    trees = V.build_trees(x)
    balls, _, places, _ = V.assign(x, trees, books)
    assert len(places) == 0 and len(balls) <= 8


def test_against_kmeans(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in np.float32(rng.normal(0, .2, 32))], int(i % 3) if i % 7 else None)
            for i in rng.permutation(900)]
    hot = rows[0][1]
    rows += [(2000 + i, hot, 1) for i in range(700)]
    rows += [(3000, None, 1), (3001, [None] * 32, 1), (3002, [float("nan")] * 32, 2), (3003, [float("inf")] + [0.0] * 31, 2),
             (3004, [1e30] * 32, 2), (3005, [-1e30] * 32, 9), (None, rows[1][1], 4), (5, rows[2][1], 4), (5, rows[2][1], 4)]
    more = [(*r, "x", 1, "y", "z") for r in rows]
    monkeypatch.setattr(V, "BLOCK", 200)
    df = spark.createDataFrame(more, SCHEMA).repartition(3)
    want, digest = brute(rows)
    assert run(df) == (want, digest)


def test_few_and_odd_lengths(spark):
    rows = [(3, [0.5] * 5, 1), (1, [], None), (2, [0.25] * 20, 1), (7, [-0.001] * 16, None)]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    assert run(df) == brute(rows)


def test_empty(spark):
    got, digest = run(spark.createDataFrame([(1, None, 1, None, None, None, None)], SCHEMA))
    assert got == [] and digest == hashlib.sha256(b"").hexdigest()
    assert run(spark.createDataFrame([], SCHEMA))[0] == []
