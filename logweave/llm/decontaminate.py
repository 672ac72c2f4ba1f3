"""Benchmark decontamination: SimHash of item-sized windows, multi-index search, exact check."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import inside_rows, rolling, text_slices, word_hashes, words

SHINGLE = 5
SIMILARITY = 0.8
#: Bits that the fingerprints of an item and a window may differ in. At a similarity of 0.8 ten
#: bits differ on average, and over 20 in about one of 10,000 cases.
RADIUS = 20
#: Items and bytes of their texts that one pass over the documents looks for.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20
_BITMAP = 22


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fingerprints(sums: np.ndarray, n: int) -> np.ndarray:
    """SimHash from counts of set bits among ``n`` shingle hashes."""
    return np.packbits(sums * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


class BlockIndex:
    """Fingerprints cut into one block more than bits may differ: equals or near ones share a block."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        edges = [64 * k // (radius + 1) for k in range(radius + 2)]
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        self.table: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, fp in enumerate(fps.tolist()):
            for k, (shift, mask) in enumerate(self.blocks):
                self.table[k, fp >> shift & mask].append(i)

    def near(self, fp: int) -> list[int]:
        """All entries within the radius of ``fp``."""
        found = set()
        for k, (shift, mask) in enumerate(self.blocks):
            found.update(self.table.get((k, fp >> shift & mask), ()))
        if not found:
            return []
        at = np.fromiter(found, np.int64, len(found))
        apart = np.bitwise_count(self.fps[at] ^ np.uint64(fp))
        return sorted(at[apart <= self.radius].tolist())


class Items:
    """Benchmark items of one pass: their shingles, and an index of fingerprints per size."""

    def __init__(self, rows: list[tuple], shingle: int, similarity: float, radius: int):
        data, starts, ends, first = words(pa.array([t for _, t in rows], pa.string()))
        h = word_hashes(data, starts, ends, lower=True)
        self.similarity, self.ids, self.sizes, self.counts = similarity, [], [], []
        places: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        by_size: dict[int, list[int]] = defaultdict(list)
        fps = []
        for k, (item_id, _) in enumerate(rows):
            own = h[first[k]:first[k + 1]]
            if not len(own):
                continue
            i = len(self.ids)
            s = rolling(own, min(shingle, len(own)))
            values, n = np.unique(s, return_counts=True)
            self.ids.append(item_id)
            self.sizes.append(len(own))
            self.counts.append(dict(zip(values.tolist(), n.tolist(), strict=True)))
            for value in values.tolist():
                places[min(shingle, len(own))][value].append(i)
            by_size[len(own)].append(i)
            fps.append(_fingerprints(_bits(s).sum(0, dtype=np.int64)[None, :], len(s))[0])
        self.index = {size: (members, BlockIndex(np.array([fps[i] for i in members], np.uint64), radius))
                      for size, members in by_size.items()}
        self.tables = {}
        for k, found in places.items():
            values = np.array(sorted(found), np.uint64)
            seen = np.zeros(1 << _BITMAP, bool)
            seen[values >> np.uint64(64 - _BITMAP)] = True
            self.tables[k] = values, [found[v] for v in values.tolist()], seen

    def leaks(self, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the best window for each item of each row.

        A window has as many words as the item, or all words of a shorter
        text. Windows are placed wherever a text has so many of an item's
        shingles within the item's size that the similarity can be reached;
        anywhere else it cannot. Their fingerprints are looked up among all items of
        that size, and what is found is compared exactly.
        """
        data, starts, ends, first = words(column)
        h = word_hashes(data, starts, ends, lower=True)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for k, (values, members, seen) in self.tables.items():
            g = rolling(h, k)
            if not len(g):
                continue
            hit = np.flatnonzero(seen[g >> np.uint64(64 - _BITMAP)] & inside_rows(first, k, len(h)))
            at = np.minimum(np.searchsorted(values, g[hit]), len(values) - 1)
            real = values[at] == g[hit]
            hits: dict[tuple[int, int], list[int]] = defaultdict(list)
            for p, v in zip(hit[real].tolist(), at[real].tolist(), strict=True):
                for i in members[v]:
                    hits[int(row_of[p]), i].append(p)
            tried: set[tuple[int, int]] = set()
            for (row, i), places in hits.items():
                a, b = int(first[row]), int(first[row + 1])
                size = min(self.sizes[i], b - a)
                need = math.ceil(self.similarity * (self.sizes[i] - k + 1) - 1e-9)
                if len(places) < need:
                    continue
                p = np.array(places)
                # each run of `need` hits that fits into a window allows a range of window starts
                lo = np.maximum(p[need - 1:] + k - size, a)
                hi = np.minimum(p[:len(p) - need + 1], b - size)
                fits = lo <= hi
                if not fits.any():
                    continue
                lo, hi = lo[fits], hi[fits]
                delta = np.zeros(int(hi.max() - lo.min()) + 2, np.int64)
                np.add.at(delta, lo - lo.min(), 1)
                np.add.at(delta, hi - lo.min() + 1, -1)
                at_all = np.flatnonzero(np.cumsum(delta[:-1])) + int(lo.min())
                for run in np.split(at_all, np.flatnonzero(np.diff(at_all) > 1) + 1):
                    self._try(g, row, run, size, self.sizes[i], k, a, tried, best)
        return [(row, i, *found) for (row, i), found in sorted(best.items())]

    def _try(self, g: np.ndarray, row: int, run: np.ndarray, size: int, item_size: int, k: int, a: int,
             tried: set, best: dict) -> None:
        """Fingerprints of the windows at the places ``run`` (no gaps), their search and check."""
        n = size - k + 1
        sums = np.concatenate([np.zeros((1, 64), np.int64),
                               np.cumsum(_bits(g[run[0]:run[-1] + n]), axis=0, dtype=np.int64)])
        fps = _fingerprints(sums[n:] - sums[:-n], n).tolist()
        members, index = self.index[item_size]
        for s, fp in zip(run.tolist(), fps, strict=True):
            if (s, item_size) in tried:
                continue
            tried.add((s, item_size))
            near = index.near(fp)
            if not near:
                continue
            values, counts = np.unique(g[s:s + n], return_counts=True)
            window = dict(zip(values.tolist(), counts.tolist(), strict=True))
            for i in (members[x] for x in near):
                own = self.counts[i]
                both = sum(min(c, own.get(v, 0)) for v, c in window.items())
                similar = both / (n + item_size - k + 1 - both)
                if similar >= self.similarity and similar > best.get((row, i), (0.0,))[0]:
                    best[row, i] = similar, s - a, size


def _blocks(benchmark: DataFrame, shingle: int, similarity: float, radius: int) -> Iterator[Items]:
    """The items in blocks of bounded size, each gathered by the driver for one pass."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")) \
        .filter("item_id IS NOT NULL AND text IS NOT NULL")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(math.ceil(n / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    for k in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        items = Items(sorted((r.item_id, r.text) for r in rows), shingle, similarity, radius)
        if items.ids:
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", shingle: int = SHINGLE,
                 similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): items found in texts, with their best window.

    Similarity is that of shingles of ``shingle`` words (fewer in shorter
    items), A-Z in lower case, repeats counted, of the item and a window of the item's number of
    words: shared over all. ``start`` is the window's first word; of equally similar windows the first is
    given. Items with a null id or text, or without words, match nothing;
    repeated items and ids give one row per text and id. Null and empty texts
    match nothing; null and repeated doc_ids give rows of their own; other columns are ignored.
    Texts are read whole where they lie; a larger benchmark takes more passes over them.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, similarity double, start long, n_words long"
    found = None
    for items in _blocks(benchmark, shingle, similarity, radius):
        one = base.mapInArrow(_report(items), schema)
        found = one if found is None else found.union(one)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _report(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            best: dict[tuple[int, int], tuple] = {}
            for row, i, *found in items.leaks(part.column("text")):
                key = row, items.ids[i]
                if found[0] > best.get(key, (0.0,))[0]:
                    best[key] = tuple(found)
            if best:
                rows = pa.array([k[0] for k in best])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), pa.array([k[1] for k in best], pa.int64()),
                     *(pa.array([v[j] for v in best.values()], kind)
                       for j, kind in enumerate((pa.float64(), pa.int64(), pa.int64())))],
                    names=["doc_id", "item_id", "similarity", "start", "n_words"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", shingle: int = SHINGLE,
                  similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item is found."""
    kept = docs
    for items in _blocks(benchmark, shingle, similarity, radius):
        kept = kept.mapInArrow(_clean(items, text), docs.schema)
    return kept


def _clean(items: Items, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            keep = np.ones(part.num_rows, bool)
            keep[[row for row, *_ in items.leaks(part.column(text))]] = False
            yield part.filter(pa.array(keep))

    return run
