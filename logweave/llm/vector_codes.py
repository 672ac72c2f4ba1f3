"""Vector codes: a codebook per part of the vectors, fitted on metric trees with cached sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import written
from logweave.operators.joins import lookup_join

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components beyond this size count as this size, so that errors fit 64 bits (up to 8,192 components).
MOST = 1 << 24
#: Vectors in one set of trees, and the points that a ball may hold without being split.
BLOCK = 8192
BLOCK_BYTES = 8 << 20
LEAF = 16
#: Pairs of points and entries that are compared at a time.
PAIRS = 1 << 20


def _firsts(values: np.ndarray, best: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first place in each segment whose value is the segment's ``best``."""
    hits = np.flatnonzero(values == np.repeat(best, lengths))
    return hits[np.searchsorted(hits, starts)]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def _norm(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(-1))


def _anchors(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor (0, 1, ...) that owns each point, and the number of anchors of each segment of ``x``.

    The first anchor is a segment's first point; each further one is the point
    farthest from its owner, and takes the points that are nearer to it. A
    point whose distance to its owner is at most half of the distance between
    the two anchors cannot be taken, so it is not compared.
    """
    segment = np.repeat(np.arange(len(starts)), lengths)
    owner = np.zeros(len(x), np.int64)
    spots = np.zeros((len(starts), int(most.max()), x.shape[1]), np.int64)
    spots[:, 0] = x[starts]
    away = ((x - spots[segment, 0]) ** 2).sum(1)
    used = np.ones(len(starts), np.int64)
    for k in range(1, spots.shape[1]):
        far = np.maximum.reduceat(away, starts)
        more = (most > k) & (far > 0)
        if not more.any():
            break
        new = x[_firsts(away, far, starts, lengths)]
        gaps = ((spots[:, :k] - new[:, None]) ** 2).sum(2)
        gaps[~more] = np.iinfo(np.int64).max
        spots[:, k] = new
        open_ = np.flatnonzero(4 * away > gaps[segment, owner])
        dist = ((x[open_] - new[segment[open_]]) ** 2).sum(1)
        nearer = dist < away[open_]
        owner[open_[nearer]] = k
        away[open_[nearer]] = dist[nearer]
        used[more] = k + 1
    return owner, used


def _around(c1, r1, n1, c2, r2, n2) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radius of a ball around two balls (centres, radii, counts)."""
    centre = (c1 * n1[..., None] + c2 * n2[..., None]) / (n1 + n2)[..., None]
    return centre, np.maximum(_norm(centre - c1) + r1, _norm(centre - c2) + r2)


class _Trees:
    """Balls of all parts of a block: children, centres, radii, and the leaf of each point."""

    def __init__(self, x: np.ndarray, parts: int):
        self.left, self.right, self.n = [], [], parts
        self.radius = np.zeros(parts)
        self.count = np.full(parts, len(x) // parts, np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.leaf = np.zeros(len(x), np.int64)
        points = np.arange(len(x))
        nodes = np.arange(parts)
        lengths = self.count.copy()
        while len(nodes):
            nodes, lengths, points = self._split(x, nodes, lengths, points)

    def _split(self, x, nodes, lengths, points):
        """Split the segments that are too large into anchors, and join these up to the segment's ball."""
        starts = np.cumsum(lengths) - lengths
        own = x[points]
        total = np.add.reduceat(own, starts)
        centre = total / lengths[:, None]
        away = _norm(own - np.repeat(centre, lengths, axis=0))
        self.radius[nodes] = np.maximum.reduceat(away, starts)
        same = np.maximum.reduceat((own != np.repeat(own[starts], lengths, axis=0)).any(1), starts)
        self.radius[nodes[~same]] = 0
        self.leaf[points] = np.repeat(nodes, lengths)
        large = (lengths > LEAF) & same
        if not large.any():
            return nodes[:0], lengths[:0], points[:0]
        points = points[np.repeat(large, lengths)]
        nodes, lengths = nodes[large], lengths[large]
        starts = np.cumsum(lengths) - lengths
        own = x[points]
        owner, used = _anchors(own, starts, lengths, np.ceil(np.sqrt(lengths)).astype(np.int64))
        # points of an anchor side by side; the anchors' numbers follow those of all balls so far
        first = self.n + np.cumsum(used) - used
        anchor = np.repeat(first, lengths) + owner
        order = np.argsort(anchor, kind="stable")
        points, own = points[order], own[order]
        n_anchors = int(used.sum())
        inner = int((used - 2).sum())
        counts = np.bincount(anchor - self.n, minlength=n_anchors)
        begin = np.cumsum(counts) - counts
        centres = np.add.reduceat(own, begin) / counts[:, None]
        radii = np.maximum.reduceat(_norm(own - np.repeat(centres, counts, axis=0)), begin)
        self.radius = np.concatenate([self.radius, radii, np.zeros(inner)])
        self.count = np.concatenate([self.count, counts, np.zeros(inner, np.int64)])
        fresh = self.n + n_anchors
        anchors = np.arange(self.n, fresh)
        self.n = fresh + inner
        self._join(nodes, used, first - anchors[0], centres, radii, counts, anchors, fresh)
        return anchors, counts, points

    def _join(self, nodes, used, at, centres, radii, counts, anchors, fresh) -> None:
        """Join the anchors of each segment two by two, those first whose common ball is smallest."""
        for size in np.unique(used):
            rows = np.flatnonzero(used == size)
            for part in range(0, len(rows), max(1, (1 << 18) // int(size * size))):
                some = rows[part:part + max(1, (1 << 18) // int(size * size))]
                pick = at[some][:, None] + np.arange(size)
                fresh = self._join_equal(nodes[some], centres[pick], radii[pick],
                                         counts[pick].astype(float), anchors[pick].copy(), fresh)

    def _join_equal(self, nodes, c, r, n, number, fresh) -> int:
        rows, k = number.shape
        at = np.arange(rows)
        live = np.ones((rows, k), bool)
        size = np.empty((rows, k, k))
        for i in range(k):
            size[:, i] = _around(c[:, i:i + 1], r[:, i:i + 1], n[:, i:i + 1], c, r, n)[1]
            size[:, i, i] = np.inf
        for step in range(1, k):
            i, j = np.divmod(size.reshape(rows, -1).argmin(1), k)
            if step == k - 1:
                made = nodes
            else:
                made = np.arange(fresh, fresh + rows)
                fresh += rows
            self.edges.append((made, number[at, i], number[at, j]))
            centre, reach = _around(c[at, i], r[at, i], n[at, i], c[at, j], r[at, j], n[at, j])
            if step < k - 1:
                self.radius[made] = reach
                self.count[made] = n[at, i] + n[at, j]
            c[at, i], r[at, i], number[at, i] = centre, reach, made
            n[at, i] += n[at, j]
            live[at, j] = False
            size[at, j] = np.inf
            size[at, :, j] = np.inf
            near = _around(c[at, i][:, None], r[at, i][:, None], n[at, i][:, None], c, r, n)[1]
            near[~live] = np.inf
            near[at, i] = np.inf
            size[at, i] = near
            size[at, :, i] = near
        return fresh


def build_trees(x: np.ndarray) -> dict[str, np.ndarray]:
    """Metric trees over the points of each part; ``x`` is (parts, points, components), integers.

    Anchors hierarchy, from the middle out: about sqrt(n) anchors split a
    ball's points, their balls are joined upwards into a binary tree, and each
    anchor's ball is split in the same way. A ball covers a range of ``order``
    (places in the flattened points), and caches the sum of its points; ball p is
    the root of part p. A ball of equal points has radius 0 and is a leaf.
    """
    parts, n, d = x.shape
    flat = np.ascontiguousarray(x, np.int64).reshape(parts * n, d)
    trees = _Trees(flat, parts)
    left = np.full(trees.n, -1, np.int64)
    right = np.full(trees.n, -1, np.int64)
    for made, a, b in trees.edges:
        left[made], right[made] = a, b
    low = np.zeros(trees.n, np.int64)
    now = np.arange(parts)
    low[now] = now * n
    while len(now):
        now = now[left[now] >= 0]
        low[left[now]] = low[now]
        low[right[now]] = low[now] + trees.count[left[now]]
        now = np.concatenate([left[now], right[now]])
    order = np.argsort(low[trees.leaf], kind="stable")
    upto = np.zeros((parts * n + 1, d), np.int64)
    np.cumsum(flat[order], axis=0, out=upto[1:])
    return {"order": order.astype(np.int32), "left": left.astype(np.int32), "right": right.astype(np.int32),
            "low": low.astype(np.int32), "count": trees.count.astype(np.int32), "radius": trees.radius,
            "sums": upto[low + trees.count] - upto[low]}


def assign(x: np.ndarray, trees: dict[str, np.ndarray], books: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nearest entry of ``books`` (parts, entries, components) for each point; ties go to the lower index.

    Gives (balls, their entries, places in the flattened points, their
    entries): balls that one entry owns whole, and the points of all others.
    From the root down a ball inherits the entries that may own one of
    its points. It drops each entry that even its point farthest towards it would not
    choose over the entry nearest to the centre; the test keeps a margin above the error of
    floating point, and what it leaves is compared in integers, in a leaf.
    """
    parts, n, d = x.shape
    k = books.shape[1]
    flat = x.reshape(parts * n, d).astype(np.int64)
    entries = books.astype(float)
    half = (entries ** 2).sum(2) / 2
    apart = _norm(entries[:, :, None] - entries[:, None])
    keep = np.ones((parts, k), bool)  # an entry equal to an earlier one owns nothing
    for p in range(parts):
        keep[p, :] = False
        keep[p, np.unique(books[p], axis=0, return_index=True)[1]] = True
    part, entry = np.nonzero(keep)
    ball, lengths = np.arange(parts), keep.sum(1)
    balls, owners, places, chosen = [], [], [], []
    while len(ball):
        starts = np.cumsum(lengths) - lengths
        centre = trees["sums"][ball] / trees["count"][ball][:, None]
        by = np.repeat(np.arange(len(ball)), lengths)
        dot = (centre[by] * entries[part, entry]).sum(1)
        score = dot - half[part, entry]
        best = np.maximum.reduceat(score, starts)
        top = _firsts(score, best, starts, lengths)
        margin = 1e-9 * (1 + np.abs(dot) + half[part, entry] + np.abs(best)[by])
        reach = trees["radius"][ball] * (1 + 1e-9)
        stays = score + reach[by] * apart[part, entry, entry[top][by]] >= best[by] - margin
        stays[top] = True
        part, entry, by = part[stays], entry[stays], by[stays]
        lengths = np.bincount(by, minlength=len(ball))
        starts = np.cumsum(lengths) - lengths
        whole = lengths == 1
        balls.append(ball[whole])
        owners.append(entry[starts[whole]])
        leaf = ~whole & (trees["left"][ball] < 0)
        if leaf.any():
            found = _compare(flat, trees, books, ball[leaf], starts[leaf], lengths[leaf], part, entry)
            balls.append(found[0])
            owners.append(found[1])
            places.append(found[2])
            chosen.append(found[3])
        inner = ~whole & ~leaf
        ball, starts, lengths = ball[inner], starts[inner], lengths[inner]
        again = _ranges(starts, lengths)
        part, entry = np.concatenate([part[again]] * 2), np.concatenate([entry[again]] * 2)
        lengths = np.concatenate([lengths] * 2)
        ball = np.concatenate([trees["left"][ball], trees["right"][ball]])
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(a or none) for a in (balls, owners, places, chosen))


def _compare(flat, trees, books, ball, starts, lengths, part, entry) -> tuple[np.ndarray, ...]:
    """Exact choice among a leaf's remaining entries: per ball of equal points, per point for the others."""
    same = trees["radius"][ball] == 0
    count = np.where(same, 1, trees["count"][ball])
    at = trees["order"][_ranges(trees["low"][ball], count)].astype(np.int64)
    leaf = np.repeat(np.arange(len(ball)), count)
    widths = lengths[leaf]
    upto = np.cumsum(widths)
    best = np.zeros(len(at), np.int64)
    first = 0
    while first < len(at):
        last = max(int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, side="right")), first + 1)
        width = widths[first:last]
        pair = _ranges(starts[leaf[first:last]], width)
        dist = ((flat[np.repeat(at[first:last], width)] - books[part[pair], entry[pair]]) ** 2).sum(1)
        begin = np.cumsum(width) - width
        best[first:last] = entry[pair[_firsts(dist, np.minimum.reduceat(dist, begin), begin, width)]]
        first = last
    alone = same[leaf]
    return ball[same], best[alone], at[~alone], best[~alone]


def _pack(ids: list, labels: list, x: np.ndarray) -> dict:
    trees = build_trees(x)
    wide = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32
    return {"ids": ids, "labels": labels, "points": x.astype(wide).tobytes(), "wide": np.dtype(wide).itemsize,
            **{name: value.tobytes() for name, value in trees.items()}}


_KINDS = {"order": np.int32, "left": np.int32, "right": np.int32, "low": np.int32, "count": np.int32,
          "radius": np.float64, "sums": np.int64}


def _unpack(row: dict, parts: int, d: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    x = np.frombuffer(row["points"], np.int16 if row["wide"] == 2 else np.int32)
    trees = {name: np.frombuffer(row[name], kind) for name, kind in _KINDS.items()}
    trees["sums"] = trees["sums"].reshape(-1, d)
    return x.reshape(parts, -1, d), trees


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the floored components, shorter vectors filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), _ranges(np.zeros(len(lengths), np.int64), lengths)] = (
        np.clip(flat, -MOST, MOST).astype(np.int64))
    return out


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & fine


class Codes:
    """Coded vectors of a table: ``table`` has (id, label, code, error), ``books`` the final codebooks."""

    def __init__(self, table: DataFrame, books: np.ndarray):
        self.table, self.books = table, books

    def digest(self) -> str:
        """SHA-256 of all components of all entries, in decimal and joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def encode(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all usable vectors of ``df``: per part the nearest entry of the part's codebook.

    Rows whose vector is null or has a null, not-a-number or infinite component are left
    out. Components become floor(256 * x), those beyond 2^24 count as 2^24.
    The codebooks start as the vectors of the ``entries`` smallest ids (nulls last;
    of equal ids the smaller vector first; fewer rows, fewer entries). Each
    round assigns every part to its nearest entry (ties to the lower one) and
    replaces each entry by the floored mean of its parts; unused ones stay.

    Tasks build trees over blocks of their own rows, once and without a
    shuffle; the rounds read them, and only sums and counts per entry leave a
    task. The driver holds the codebooks alone. Repeated ids give a row each. Vectors of other lengths than the longest, or whose
    length does not divide by ``parts``, are filled up with zeros. An empty
    table gives no rows and empty codebooks. Other columns are ignored.
    """
    found = df.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(
        usable(F.col("v")))
    longest = found.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-max(longest, 1) // parts) * parts
    d = width // parts
    head = (found.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect())
    start = pa.array([list(map(float, r.v)) for r in head], pa.list_(pa.float64()))
    books = _integers(start, width).reshape(len(head), parts, d).swapaxes(0, 1).copy()
    kinds = dict(found.dtypes)
    blocks = written(_blocks(found, kinds, parts, width), "balls")
    for _ in range(rounds if len(head) else 0):
        books = _means(blocks, books)
    return Codes(_coded(blocks, kinds, books), books)


def _blocks(found: DataFrame, kinds: dict[str, str], parts: int, width: int) -> DataFrame:
    """One row per block of vectors: ids, labels, points and the trees over them."""
    rows = max(64, min(BLOCK, BLOCK_BYTES // (8 * width)))
    schema = (f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, points binary, wide int, "
              + ", ".join(f"{name} binary" for name in _KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        types = None

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept.clear()
            x = _integers(table.column("v"), width)
            row = _pack([table.column("id")], [table.column("label")],
                        x.reshape(len(x), parts, width // parts).swapaxes(0, 1))
            one = pa.array([0, len(x)], pa.int32())
            lists = [pa.ListArray.from_arrays(one, row[c][0]) for c in ("ids", "labels")]
            rest = [pa.array([row["points"]], pa.binary()), pa.array([row["wide"]], pa.int32())]
            return pa.RecordBatch.from_arrays(
                lists + rest + [pa.array([row[name]], pa.binary()) for name in _KINDS],
                names=["ids", "labels", "points", "wide", *_KINDS])

        held = 0
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                some = batch.slice(first, rows - held)
                kept.append(some)
                held += some.num_rows
                first += some.num_rows
                if held == rows:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return found.mapInArrow(run, schema)


def _means(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floored means of what each entry owns."""
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, k, d), np.int64)
        counts = np.zeros((parts, k), np.int64)
        pieces = 0
        for batch in batches:
            for row in batch.to_pylist():
                x, trees = _unpack(row, parts, d)
                n = x.shape[1]
                balls, owners, places, chosen = assign(x, trees, books)
                part = trees["low"][balls] // n
                np.add.at(sums, (part, owners), trees["sums"][balls])
                np.add.at(counts, (part, owners), trees["count"][balls])
                np.add.at(sums, (places // n, chosen), x.reshape(-1, d)[places])
                np.add.at(counts, (places // n, chosen), 1)
                pieces += 1
                if pieces % 1024 == 0:
                    yield report(sums, counts)
                    sums[:], counts[:] = 0, 0
        yield report(sums, counts)

    def report(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part, entry = np.nonzero(counts)
        values = np.concatenate([counts[part, entry][:, None], sums[part, entry]], axis=1)
        at = pa.array(np.arange(len(part) + 1, dtype=np.int32) * (d + 1), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array((part * k + entry).astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(values.reshape(-1)))],
            names=["entry", "sums"])

    partial = blocks.select("points", "wide", *_KINDS).mapInArrow(run, "entry long, sums array<long>")
    total = (partial.select("entry", F.posexplode("sums").alias("at", "value"))
             .groupBy("entry", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    found: dict[int, list[int]] = {}
    for r in total:
        found.setdefault(r.entry, [0] * (d + 1))[r.at] = int(r.value)
    out = books.copy()
    for entry, (count, *values) in found.items():
        out[entry // k, entry % k] = [v // count for v in values]
    return out


def _coded(blocks: DataFrame, kinds: dict[str, str], books: np.ndarray) -> DataFrame:
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                row = {c: one.column(c)[0].as_py() for c in ("points", "wide", *_KINDS)}
                x, trees = _unpack(row, parts, d)
                n = x.shape[1]
                balls, owners, places, chosen = assign(x, trees, books)
                codes = np.zeros(parts * n, np.int64)
                counts = trees["count"][balls]
                codes[trees["order"][_ranges(trees["low"][balls], counts)]] = np.repeat(owners, counts)
                codes[places] = chosen
                codes = codes.reshape(parts, n)
                error = np.zeros(n, np.int64)
                for p in range(parts):
                    error += ((x[p].astype(np.int64) - books[p][codes[p]]) ** 2).sum(1)
                text = codes.T.astype(np.uint8).tobytes().hex()
                texts = [text[2 * parts * i:2 * parts * (i + 1)] for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [one.column("ids").flatten(), one.column("labels").flatten(), pa.array(texts, pa.string()),
                     pa.array(error)], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over rows of the same label; nulls are one label."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    keyed = coded.withColumn("_label", key)
    sums = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return lookup_join(keyed, sums, ["_label"], "left", spread=["id", "code"]).drop("_label")


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Codes, errors and the digest of the codebooks of ``embeddings`` in DuckDB's SQL, all distances compared."""

    def nearest(name: str, book: str) -> str:
        return (f"{name} AS (SELECT r, p, arg_min({{e: e, d: d}}, {{d: d, e: e}}) AS best FROM (SELECT r, p, e, "
                f"list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d "
                f"FROM part JOIN {book} USING (p)) GROUP BY r, p)")

    steps = []
    for k in range(rounds):
        steps.append(nearest(f"near{k}", f"book{k}"))
        steps.append(f"""sum{k} AS (SELECT p, e, i, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS c
  FROM (SELECT p, best.e AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i
        FROM near{k} JOIN part USING (r, p)) GROUP BY ALL)""")
        steps.append(f"""mean{k} AS (SELECT p, e, list((s - (((s % c) + c) % c)) // c ORDER BY i) AS y FROM sum{k} GROUP BY p, e)""")
        steps.append(f"""book{k + 1} AS (SELECT p, e, coalesce(m.y, b.y)::BIGINT[] AS y
  FROM book{k} b LEFT JOIN mean{k} m USING (p, e))""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
  list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
width AS (SELECT max(len(x)) // {parts} AS d FROM kept),
part AS (SELECT r, p, x[p * d + 1:p * d + d] AS x FROM kept, width, range({parts}) t(p)),
book0 AS (SELECT p, r - 1 AS e, x AS y FROM part WHERE r <= {entries}),
{(","+chr(10)).join(steps)},
{nearest("final", f"book{rounds}")},
code AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM final GROUP BY r),
digest AS (SELECT sha256(string_agg(v, ',' ORDER BY p, e, i)) AS h
  FROM (SELECT p, e, unnest(y)::VARCHAR AS v, generate_subscripts(y, 1) AS i FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN code USING (r), digest"""
