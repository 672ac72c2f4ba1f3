"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import text_slices, word_hashes, words

#: Labelled documents that the model is fitted on, at most, and lines of all of them together.
FIT_DOCUMENTS = 6000
FIT_LINES = 3_000_000
ROUNDS = 250
RIDGE = 5e-5
THRESHOLD = 0.3

#: Bin edges of what is measured of a line; a value belongs behind the last edge below it.
_EDGES = {
    "same_as_previous_word": [0.001, 0.05, 0.2, 0.5],
    "upper_of_letters": [0.02, 0.1, 0.3, 0.6],
    "symbols_per_word": [0.001, 0.05, 0.2, 0.5, 0.9],
    "exclamations_per_word": [0.001, 0.05, 0.2, 0.5, 0.9],
    "digits_per_byte": [0.001, 0.05, 0.2, 0.5],
    "stops_per_word": [0.001, 0.05, 0.1, 0.2, 0.5],
    "bytes_per_word": [2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 30.0],
    "words": [1.0, 3.0, 8.0, 20.0, 60.0, 200.0],
}
_WIDTHS = np.array([len(e) + 1 for e in _EDGES.values()])
_OFFSETS = np.cumsum(_WIDTHS) - _WIDTHS
_OWN = int(_WIDTHS.sum())
#: Weights: own bins, bins of the line before and of the line behind, and "no such line" of both.
_SIZE = 3 * _OWN + 2


def _two_counts(low: str, high: str) -> np.ndarray:
    table = np.zeros(256, np.uint64)
    table[[*low.encode()]] += np.uint64(1)
    table[[*high.encode()]] += np.uint64(1 << 32)
    return table


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTED = [_two_counts(_UPPER, _UPPER + _UPPER.lower()), _two_counts("#*$%&|<>", "!"),
            _two_counts("0123456789", ".,;:?")]


def line_bins(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of each line with a word (lines x measures), its bytes, and lines before each row."""
    data, starts, ends, first = words(column)
    if not len(starts):
        return (np.zeros((0, len(_EDGES)), np.int64), np.zeros(0, np.int64),
                np.zeros(len(first), np.int64))
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = breaks[starts] + row
    new = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.flatnonzero(new)
    n = np.diff(np.concatenate([head, [len(starts)]]))
    a, b = starts[head], ends[np.concatenate([head[1:], [len(starts)]]) - 1]
    counts = []
    for table in _COUNTED:
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data])])
        both = run[b] - run[a]
        counts += [(both & np.uint64(0xFFFFFFFF)).astype(float), (both >> np.uint64(32)).astype(float)]
    upper, letters, symbols, calls, digits, stops = counts
    h = word_hashes(data, starts, ends)
    same = np.concatenate([[False], (h[1:] == h[:-1])]) & ~new
    size = (b - a).astype(float)
    values = [np.add.reduceat(same, head, dtype=float) / n, upper / np.maximum(letters, 1), symbols / n,
              calls / n, digits / size, stops / n, size / n, n.astype(float)]
    bins = np.stack([np.searchsorted(e, v, side="right")
                     for e, v in zip(_EDGES.values(), values, strict=True)], axis=1)
    return bins, b - a, np.searchsorted(head, first)


@dataclass
class Model:
    """Weights of a line's bins for "good", transitions [from, to] (0 bad, 1 good), start; empty: score of no lines."""

    weights: np.ndarray
    moves: np.ndarray
    start: float
    empty: float = 0.5


def _features(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weight indexes of each line: its own bins and those of its neighbours in the text."""
    own = bins + _OFFSETS
    n = len(bins)
    out = np.full((n, 3 * bins.shape[1]), -1)
    k = bins.shape[1]
    out[:, :k] = own
    heads = np.zeros(n + 1, bool)
    heads[first] = True
    before, behind = ~heads[:n], ~heads[1:]
    out[1:, k:2 * k] = own[:-1] + _OWN
    out[:-1, 2 * k:] = own[1:] + 2 * _OWN
    out[~before, k:2 * k] = 3 * _OWN
    out[~behind, 2 * k:] = 3 * _OWN + 1
    return out


def _chains(scores: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of "good" per line; all rows advance together."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    ahead, back = np.zeros(len(scores)), np.zeros(len(scores))
    (bb, bg), (gb, gg) = model.moves
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), side="left")
    a = np.zeros(0)
    for t in range(longest):
        at = begin[:active[t]] + t
        if t:
            a = a[:active[t]]
            a = np.logaddexp(a + gg, bg) - np.logaddexp(a + gb, bb)
        else:
            a = np.full(active[0], model.start)
        a = a + scores[at]
        ahead[at] = a
    for t in range(longest - 2, -1, -1):
        at = begin[:active[t + 1]] + t
        nxt = back[at + 1] + scores[at + 1]
        back[at] = np.logaddexp(nxt + gg, gb) - np.logaddexp(nxt + bg, bb)
    return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def marginals(bins: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Probability of "good" of each line, by forward-backward over its whole text."""
    f = _features(bins, first)
    scores = model.weights[f].sum(1)
    ahead, back = _chains(scores, first, model)
    return _sigmoid(ahead + back)


def fit_bins(bins: np.ndarray, first: np.ndarray, good: np.ndarray, rounds: int = ROUNDS,
             ridge: float = RIDGE) -> Model:
    """Maximum likelihood, every line carrying its document's label; gradient steps (Adam)."""
    n = np.diff(first)
    y = np.repeat(good.astype(float), n)
    # texts count alike, however many lines they have
    weight = np.repeat(1 / np.maximum(n, 1), n)
    f = _features(bins, first)
    params = np.zeros(_SIZE + 5)
    mean, power = np.zeros_like(params), np.zeros_like(params)
    total = max(1.0, weight.sum())
    inner = np.ones(len(y), bool)
    inner[first[:-1][n > 0]] = False
    pos = np.flatnonzero(inner)
    starts = first[:-1][n > 0]
    for k in range(1, rounds + 1):
        model = Model(params[:_SIZE], params[_SIZE:_SIZE + 4].reshape(2, 2), params[-1])
        scores = model.weights[f].sum(1)
        ahead, back = _chains(scores, first, model)
        p = _sigmoid(ahead + back)
        grad = np.zeros_like(params)
        for j in range(f.shape[1]):
            grad[:_SIZE] += np.bincount(f[:, j], weight * (y - p), _SIZE)
        if len(pos):
            # pair odds of neighbouring lines: forward of the first, score and backward of the second
            left, right = ahead[pos - 1], scores[pos] + back[pos]
            pair = np.stack([np.zeros(len(pos)) + model.moves[0, 0], right + model.moves[0, 1],
                             left + model.moves[1, 0], left + right + model.moves[1, 1]])
            pair = np.exp(pair - pair.max(0))
            pair /= pair.sum(0)
            seen = np.stack([(1 - y[pos - 1]) * (1 - y[pos]), (1 - y[pos - 1]) * y[pos],
                             y[pos - 1] * (1 - y[pos]), y[pos - 1] * y[pos]])
            grad[_SIZE:_SIZE + 4] = ((seen - pair) * weight[pos]).sum(1)
        grad[-1] = (weight[starts] * (y[starts] - p[starts])).sum()
        grad = grad / total - ridge * params
        mean = 0.9 * mean + 0.1 * grad
        power = 0.99 * power + 0.01 * grad ** 2
        params = params + 0.2 * (mean / (1 - 0.9 ** k)) / (np.sqrt(power / (1 - 0.99 ** k)) + 1e-8)
    share = (good.sum() + 1) / (len(good) + 2)
    return Model(params[:_SIZE].copy(), params[_SIZE:_SIZE + 4].reshape(2, 2).copy(), float(params[-1]),
                 float(share))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = FIT_DOCUMENTS,
        lines: int = FIT_LINES) -> Model:
    """A model from ``labels`` (doc_id, quality 0/1), on a bounded sample of labelled rows.

    The sample is the ``most`` labelled ids with the smallest hash, in that
    order and one row of each (that of the smallest text hash), all lines of
    it; documents of more than ``lines`` lines are left out, and so are those from
    where the sample would have more lines than that.
    Only the sample's bins come to the driver. Null ids and
    labels are left out, of repeated ids the smaller label counts. Without
    labelled rows the model scores every text 0.5.
    """
    sample = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
              .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
              .orderBy(F.xxhash64("_id"), "_id").limit(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            bins, _, first = line_bins(part.column("text"))
            packed = [bins[a:b].astype(np.uint8).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("good"), part.column("hash"), pa.array(np.diff(first).astype(np.int64)),
                 pa.array(packed, pa.binary())], names=["id", "good", "hash", "n", "bins"])

    joined = (docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col(text).alias("text"))
              .join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
              .select(F.col("_id").cast("long").alias("id"), F.col("_good").cast("int").alias("good"),
                      F.xxhash64("text").alias("hash"), "text")
              .mapInArrow(run, "id long, good int, hash long, n long, bins binary"))
    one = joined.groupBy("id").agg(F.min(F.struct("hash", "n", "good", "bins")).alias("row"))
    # at most one row for each id of the sample: a window over all of them is bounded
    upto = F.sum("row.n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = one.filter(F.col("row.n") <= lines).withColumn("upto", upto).filter(F.col("upto") <= lines).select("row.good", "row.bins").collect()
    rows.sort(key=lambda r: (r.good, r.bins))
    arrays = [np.frombuffer(r.bins, np.uint8).reshape(-1, len(_EDGES)) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
    if not first[-1]:
        return Model(np.zeros(_SIZE), np.zeros((2, 2)), 0.0)
    return fit_bins(np.concatenate(arrays).astype(np.int64), first, np.array([r.good for r in rows]))


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """The scores of a column of texts."""
    bins, size, first = line_bins(column)
    good = np.concatenate([[0.0], np.cumsum(marginals(bins, first, model) * size)])
    sizes = np.concatenate([[0], np.cumsum(size)])
    weight = sizes[first[1:]] - sizes[first[:-1]]
    value = (good[first[1:]] - good[first[:-1]]) / np.maximum(weight, 1)
    return np.clip(np.where(weight > 0, value, model.empty), 0.0, 1.0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, score): length-weighted mean over a text's lines of the probability of "good".

    Lines are split at line feeds; those without a word do not count. Null and
    empty texts score the share of good texts in the sample. Null and repeated doc_ids
    give a row each; other columns are ignored; an empty table gives no rows.
    Texts are read whole, in the task that reads them: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            value = score_texts(part.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(value)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            value = score_texts(part.column(text), model)
            yield part.filter(pa.array(value >= threshold)).select(names)

    return docs.mapInArrow(run, docs.schema)
