"""Exact substring dedup: suffixes in groups by prefix, sorted into subtrees, deep nodes removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import inside_rows, rolling, stable, text_slices, with_row_key, word_hashes, words
from logweave.session import freeze

WINDOW = 20
#: Words of an anchor, and of the shorter prefix that groups suffixes.
ANCHOR = 5
PREFIX = 10
#: Suffixes of an anchor up to which the short prefix names a group; beyond, the whole window
#: does, and beyond the second bound a group is split again and its first members meet once more.
LONG_PREFIX = 5_000
SPLIT = 20_000
#: Root of the second hash of a window.
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of each one's anchor, and the hashes of all short runs.

    A window's anchor is the run of ``ANCHOR`` words in it with the smallest
    hash (the first such): equal windows have equal anchors at equal places.
    """
    k = min(ANCHOR, window)
    g = rolling(h, k)
    inside = np.flatnonzero(inside_rows(first, window, len(h)))
    if not len(inside):
        return inside, inside, g
    views = np.lib.stride_tricks.sliding_window_view(g, window - k + 1)
    return inside, inside + views[inside].argmin(1), g


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(_row, place, h): the anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 21):
            data, starts, ends, first = words(part.column("text"))
            _, anchors, g = _anchors(word_hashes(data, starts, ends), first, window)
            if not len(anchors):
                continue
            at = anchors[np.concatenate([[True], anchors[1:] != anchors[:-1]])]
            row = np.searchsorted(first, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [part.column("_row").take(pa.array(row)), pa.array((at - first[row]).astype(np.int32)),
                 pa.array(g[at].view(np.int64))], names=["_row", "place", "h"])

    return docs.select("_row", "text").mapInArrow(run, "_row long, place int, h long")


def _suffixes(docs: DataFrame, window: int) -> DataFrame:
    """(path, more, id, _row, start, n): suffixes whose window has an anchor met elsewhere.

    ``docs`` has (_row, id, text, places: anchors with their number of occurrences). ``path`` is the
    way down the tree: 16 bits of a hash of the suffix's first ``PREFIX`` words, then 48 of its first ``window``;
    ``more`` are 64 bits of those by another hash, so that windows are told apart by 112 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 21):
            data, starts, ends, first = words(part.column("text"))
            h = word_hashes(data, starts, ends)
            inside, anchors, _ = _anchors(h, first, window)
            places = part.column("places")
            known = places.flatten()
            count = np.zeros(len(h) + 1, np.int64)
            row = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy())
            count[known.field("place").to_numpy() + first[row]] = known.field("n").to_numpy()
            n = count[anchors]
            at, n = inside[n > 0], n[n > 0]
            if not len(at):
                continue
            row = pa.array(np.searchsorted(first, at, side="right") - 1)
            short, whole = rolling(h, min(PREFIX, window))[at], rolling(h, window)[at]
            path = (short >> np.uint64(48) << np.uint64(48)) | (whole >> np.uint64(16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.view(np.int64)), pa.array(rolling(h, window, _SECOND)[at].view(np.int64)),
                 part.column("id").take(row), part.column("_row").take(row),
                 pa.array((at - first[row.to_numpy()]).astype(np.int32)),
                 pa.array(np.minimum(n, 1 << 30).astype(np.int32))],
                names=["path", "more", "id", "_row", "start", "n"])

    return docs.select("_row", "id", "text", "places").mapInArrow(
        run, "path long, more long, id long, _row long, start int, n int")


def _subtrees(suffixes: DataFrame, group: Column, first_leaves: bool) -> DataFrame:
    """Leaves of deep nodes: all but the first of each (or, of nodes in split groups, the first ones).

    Suffixes with one prefix are in one task; sorted, they are the leaves of
    the prefix's subtree from left to right, and how much a leaf has in common
    with the one before it tells the nodes above both. Nodes as deep as the
    window are runs of leaves that have the whole window in common. Leaves of a
    node are in order of document and place, and pass in a stream: a group needs no more
    memory than a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            path, more = batch.column("path").to_numpy(), batch.column("more").to_numpy()
            common = np.concatenate([[before == (path[0], more[0])],
                                     (path[1:] == path[:-1]) & (more[1:] == more[:-1])])
            before = path[-1], more[-1]
            pick = ~common & (batch.column("n").to_numpy() > SPLIT) if first_leaves else common
            yield batch.filter(pa.array(pick))

    return (suffixes.repartition(group).sortWithinPartitions("path", "more", "id", "_row", "start")
            .mapInArrow(run, suffixes.schema))


def repeated_windows(docs: DataFrame, same: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_row, starts): of each text, the windows that also start earlier; whole copies have no row.

    ``docs`` has (_row, id, text); earlier is by (id, _row, start). ``same`` has (_row, m, copy)
    of the texts that m rows have, all but the first of them copies: these stay
    out, and what occurs only as often as its text does occurs nowhere else. Only windows are compared whose anchor occurs at least twice, which loses none. Anchors
    are counted with a map-side sum, the suffixes around repeated ones are
    dealt to groups by a prefix of their words, longer where there are many.
    """
    anchors = _anchor_rows(docs, window)
    repeated = freeze(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    most = repeated.agg(F.max("n")).first()[0] or 0
    places = (anchors.join(repeated, "h").groupBy("_row")
              .agg(F.collect_list(F.struct("place", F.col("n").cast("int").alias("n"))).alias("places"))
              .join(same, "_row", "left").filter("copy IS NULL OR NOT copy")
              .select("_row", F.filter("places", lambda p: p["n"] > F.coalesce("m", F.lit(1))).alias("places"))
              .filter(F.size("places") > 0))
    suffixes = _suffixes(docs.join(places, "_row"), window)
    salts = F.ceil(F.col("n") / SPLIT)
    group = (F.when(F.col("n") <= LONG_PREFIX, F.shiftrightunsigned("path", 48))
             .when(F.col("n") <= SPLIT, F.col("path"))
             .otherwise(F.xxhash64("path", F.pmod(F.xxhash64("_row"), salts))))
    later = _subtrees(suffixes, group, False)
    if most > SPLIT:
        heads = _subtrees(suffixes, group, True)
        later = later.union(_subtrees(heads, F.col("path"), False))
    return later.groupBy("_row").agg(F.collect_list("start").alias("starts"))


def _with_repeats(docs: DataFrame, text: str, window: int) -> DataFrame:
    """All columns of ``docs`` in ``_all``, its text, and which windows repeat; ``copy``: the whole text does."""
    keyed = with_row_key(docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text")))
    digest = keyed.select(F.sha2("text", 256).alias("digest"), "id", "_row")
    firsts = (digest.groupBy("digest").agg(F.min(F.struct("id", "_row")).alias("head"), F.count("*").alias("n"))
              .filter("n > 1"))
    # later copies of whole texts are settled; their first copy stands for them
    same = freeze(digest.join(firsts, "digest").select(
        "_row", F.col("n").alias("m"), (F.col("_row") != F.col("head._row")).alias("copy")))
    starts = repeated_windows(keyed, same, window)
    marks = starts.select("_row", "starts", F.lit(False).alias("copy")).union(
        same.filter("copy").select("_row", F.array().cast("array<int>"), F.lit(True)))
    return keyed.join(marks, "_row", "left")


def _cut(part: pa.RecordBatch, window: int) -> tuple[list[int], list[int], list, list[str]]:
    """Of each row: words, removed words, removed spans [first, behind last], kept words joined by a blank."""
    n_words, n_removed, spans, kept = [], [], [], []
    for text, starts, copy in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "copy")),
                                  strict=True):
        tokens = text.encode("utf-8", "replace").split()
        own: list[list[int]] = []
        if copy and len(tokens) >= window:
            own = [[0, len(tokens)]]
        else:
            for s in sorted(starts or ()):
                if own and s <= own[-1][1]:
                    own[-1][1] = s + window
                else:
                    own.append([s, s + window])
        rest, at = [], 0
        for a, b in own:
            rest += tokens[at:a]
            at = b
        rest += tokens[at:]
        n_words.append(len(tokens))
        n_removed.append(len(tokens) - len(rest))
        spans.append(own)
        kept.append(b" ".join(rest).decode())
    return n_words, n_removed, spans, kept


def cut_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of each row of ``docs``.

    Removed is every word covered by ``window`` consecutive words that also
    start earlier, in a smaller doc_id (of rows with one id, in either of them; rows without id count
    as last) or earlier in the same text. ``spans`` are the removed stretches as word numbers,
    ``kept`` the other words joined by one blank. Null and empty texts have no
    words; texts shorter than the window stay; an empty table gives no rows;
    other columns are ignored. No text, group of copies or passage is gathered in one task.
    """
    marked = _with_repeats(stable(docs), text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            n_words, n_removed, spans, kept = _cut(part, window)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.string())],
                names=["id", "n_words", "n_removed", "spans", "kept"])

    out = marked.select("id", "text", "starts", "copy").mapInArrow(
        run, "id long, n_words long, n_removed long, spans array<array<int>>, kept string")
    return out.select(F.when(F.col("id") != (1 << 63) - 1, F.col("id")).alias("doc_id"), "n_words",
                      "n_removed", "spans", "kept")


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts, all other columns as they are.

    Texts without a removed word stay exactly as they are; a null text stays null.
    """
    docs = stable(docs)
    rest = [c for c in docs.columns if c != text]
    whole = with_row_key(docs.select(F.struct(*rest).alias("_rest"), F.col(text).alias("_text")))
    marks = _with_repeats(docs, text, window).filter("starts IS NOT NULL").select("_row", "starts", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_text"):
            again = pa.RecordBatch.from_arrays(
                [part.column("_text").fill_null(""), part.column("starts"), part.column("copy")],
                names=["text", "starts", "copy"])
            _, removed, _, kept = _cut(again, window)
            new = [k if r else t for t, r, k in zip(part.column("_text").to_pylist(), removed, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("_rest"), pa.array(new, pa.string())],
                                             names=["_rest", "_new"])

    joined = whole.join(marks, "_row", "left").select("_rest", "_text", "starts", "copy")
    kind = joined.schema["_rest"].dataType.simpleString()
    cut = joined.mapInArrow(run, f"_rest {kind}, _new string")
    return cut.select(*[F.col("_new").alias(c) if c == text else F.col("_rest")[c].alias(c)
                        for c in docs.columns])
