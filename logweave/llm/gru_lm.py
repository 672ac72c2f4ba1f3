"""A gated recurrent language model over words, with counts of the whole corpus below it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import stable, text_slices, with_row_key, words, worker_cache, written

#: Words that the network tells apart, words whose counts travel to the tasks, and words of a class at most.
NETWORK_WORDS = 4096
COUNTED_WORDS = 131_072
CLASS_WORDS = 64
#: Words whose neighbourhood tells classes apart, and groups of words with like neighbourhoods.
ANCHORS = 48
GROUPS = 16
#: Size of the state, steps of truncated backpropagation, texts side by side, step size.
STATE = 16
STEPS = 16
LANES = 1024
RATE = 0.1
#: Steps of words in a class against those of the rest: a word has few tokens in a window.
WORD_RATE = 0.125
#: Models that are trained side by side and averaged, and how often.
WORKERS = 64
ROUNDS = 2
_TAILS = 16
_NO_WORD = -1e4
_LOG10 = math.log(10)
_LETTER = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text whose words are counted or run through the network at a time; rows of counts that a task adds up at a time.
_SLICE = 1 << 23
_COUNT_ROWS = 800_000
#: Rows of class scores that are turned into probabilities at a time.
_ROWS = 1024


def tokens_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a line, A-Z in lower case, and the number of words of each text; null has none."""
    data, starts, ends, first = words(column)
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    # words[k] is at offsets[k] once the bytes between words are gone
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] = 1
    step[ends] -= 1
    data = _LOWER[data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]]
    return _binary(data, offsets), np.diff(first)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1,
                                            [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def tail_classes(words: list[bytes] | pa.Array) -> np.ndarray:
    """Which of the classes of rarer words each word is in: by its first non-ASCII sign and its ending."""
    if not len(words):
        return np.zeros(0, np.int32)
    if isinstance(words, list):
        words = pa.array(words, pa.large_binary())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.append(np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], np.uint8(32))
    ends = offsets[1:] - offsets[0]
    last = data[ends - 1]
    sign = ~(_LETTER[last])
    high = np.flatnonzero(data > 127)
    first = np.searchsorted(high, np.concatenate([[0], ends[:-1]]))
    place = np.concatenate([high, [len(data)]])[first]
    own = place < ends
    # the byte behind a lead byte tells letters of one alphabet apart
    second = data[np.minimum(place + 1, len(data) - 1)].astype(np.int32)
    return np.where(own, 2 * (1 + second % (_TAILS // 2 - 1)), 0).astype(np.int32) + sign


@dataclass
class Counts:
    """What tasks know of the corpus: the most frequent words with their counts, and totals."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    ends: int
    token: str = ""
    class_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    slot_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    tail_total: np.ndarray = field(default_factory=lambda: np.zeros(_TAILS))
    classes: int = 0

    @property
    def network(self) -> int:
        return min(NETWORK_WORDS, len(self.words))

    def index(self) -> pa.Array:
        """The words as an Arrow array; kept in the worker."""
        kept = worker_cache()
        if kept.get("lm_token") != self.token:
            kept["lm_token"] = self.token
            kept["lm_words"] = pa.array(self.words, pa.large_binary())
            kept["lm_tails"] = tail_classes(kept["lm_words"])
        return kept["lm_words"]

    def tails(self) -> np.ndarray:
        self.index()
        return worker_cache()["lm_tails"]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all words of all texts; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> list[pa.RecordBatch]:
            found = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"word": found["word"].cast(pa.string()), "n": found["n_sum"]}).to_batches()

        for part in text_slices(batches, "text", _SLICE):
            own, _ = tokens_of(part.column("text"))
            found = own.value_counts()
            held.append(pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"]))
            rows += len(found)
            if rows > _COUNT_ROWS:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return (docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def frequent(counts: DataFrame, ends: int, most: int = COUNTED_WORDS) -> Counts:
    """The ``most`` most frequent words at most (all of one count or none), and the totals."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    total, distinct, least, taken = 0, 0, None, 0
    for r in by_count:
        total += r.n * r.words
        distinct += r.words
        if distinct <= most:
            least, taken = r.n, distinct
    rows = [] if not taken else counts.filter(F.col("n") >= least).collect()
    rows.sort(key=lambda r: (-r.n, r.word))
    return Counts([r.word.encode() for r in rows], np.array([r.n for r in rows], np.int64), total + ends,
                  distinct + (ends > 0), ends)


def _number(part: pa.RecordBatch, known: Counts, tails: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all texts in a line (-1 - tail class for words without one), text lengths, unnumbered words."""
    own, lengths = tokens_of(part.column("text"))
    found = pc.index_in(own, value_set=known.index())
    rare = own.filter(found.is_null())
    out = found.fill_null(-1).to_numpy().copy()
    if tails:
        out[out < 0] = -1 - tail_classes(rare)
    return out, lengths, rare


def neighbourhoods(docs: DataFrame, known: Counts, text: str = "text") -> np.ndarray:
    """How often each word of the network follows each anchor word, over all texts."""
    anchors, n = min(ANCHORS, known.network), known.network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(n * anchors, np.int64)
        for part in text_slices(batches, "text"):
            own, _, _ = _number(part, known, tails=False)
            a, b = own[:-1], own[1:]
            both = (a >= 0) & (a < anchors) & (b >= 0) & (b < n)
            cells += np.bincount(b[both].astype(np.int64) * anchors + a[both], minlength=n * anchors)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    out = np.zeros(n * max(1, anchors))
    # as many rows as network words times anchors at most
    for r in (docs.select(F.col(text).alias("text")).mapInArrow(run, "cell long, n long")
              .groupBy("cell").agg(F.sum("n").alias("n")).collect()):
        out[r.cell] = r.n
    return out.reshape(n, max(1, anchors))


def make_classes(known: Counts, near: np.ndarray) -> None:
    """Give each word of the network a class: like neighbourhoods first, then like frequency.

    Class 0 is the end of a text, the next ones are those of rarer words. The words
    of a class are numbered in it (their slots).
    """
    n = known.network
    group = np.zeros(n, np.int64)
    if n > GROUPS:
        x = np.sqrt(near + 0.1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centres = x[np.linspace(0, min(n, 400) - 1, GROUPS).astype(int)]
        for _ in range(20):
            group = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, group, x * np.log1p(known.counts[:n, None]))
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    class_of, at = np.zeros(n, np.int32), 1 + _TAILS
    for g in range(GROUPS):
        members = np.flatnonzero(group == g)
        for a in range(0, len(members), CLASS_WORDS):
            class_of[members[a:a + CLASS_WORDS]] = at
            at += 1
    known.class_of, known.classes = class_of, at
    order = np.argsort(class_of, kind="stable")
    size = np.bincount(class_of, minlength=at)
    known.slot_of = np.empty(n, np.int32)
    known.slot_of[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)


@dataclass
class Network:
    """Weights: of inputs and state for gates and candidate, of the classes, and of the words in them.

    ``words`` and ``word_bias`` are by class and slot; slots without a word have a bias of ``_NO_WORD``.
    """

    inputs: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.out, self.bias, self.words, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @staticmethod
    def of(flat: np.ndarray, like: Network) -> Network:
        out, at = [], 0
        for p in like.parts():
            out.append(flat[at:at + p.size].reshape(p.shape).astype(np.float32).copy())
            at += p.size
        return Network(*out)


def first_network(known: Counts, tail_mass: np.ndarray, size: int = STATE) -> Network:
    """Small random weights; the bias of classes, and of words in them, is how often they occur."""
    r = np.random.default_rng(7)
    n = known.network
    mass = np.bincount(known.class_of, known.counts[:n], known.classes).astype(float)
    width = int(known.slot_of.max(initial=0)) + 1
    word_bias = np.full((known.classes, width), _NO_WORD, np.float32)
    word_bias[known.class_of, known.slot_of] = np.log(known.counts[:n] / np.maximum(mass[known.class_of], 1))
    mass[0], mass[1:1 + _TAILS] = known.ends, tail_mass
    return Network((r.normal(size=(1 + _TAILS + n, 3 * size)) * 0.1).astype(np.float32),
                   (r.normal(size=(size, 3 * size)) * 0.3).astype(np.float32),
                   (r.normal(size=(size, known.classes)) * 0.05).astype(np.float32),
                   np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32),
                   np.zeros((known.classes, width, size), np.float32), word_bias)


def _sequences(own: np.ndarray, known: Counts, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, classes and slots of word numbers; words outside the network stand for their tail class, slot -1."""
    n = known.network
    tail = np.where(own < 0, -1 - own, tails[np.maximum(own, 0)] if len(tails) else 0)
    inside = (own >= 0) & (own < n)
    inputs = np.where(inside, own + 1 + _TAILS, 1 + tail)
    word = np.where(inside, own, 0)
    classes = np.where(inside, known.class_of[word] if n else 0, 1 + tail)
    slots = np.where(inside, known.slot_of[word] if n else 0, -1)
    return inputs.astype(np.int32), classes.astype(np.int32), slots.astype(np.int32)


class Lanes:
    """Texts dealt to lanes that run side by side, the longest lane first; each text ends with class 0."""

    def __init__(self, inputs: np.ndarray, classes: np.ndarray, slots: np.ndarray, lengths: np.ndarray, lanes: int):
        first = np.cumsum(lengths) - lengths
        n = max(1, min(lanes, len(lengths)))
        order = np.argsort(-lengths, kind="stable")
        rounds = -(-len(order) // n)
        # deal forth and back, so that lanes come out about equally long
        lane = np.concatenate([np.arange(n) if k % 2 == 0 else np.arange(n)[::-1] for k in range(rounds)])[:len(order)] \
            if len(order) else np.zeros(0, np.int64)
        size = np.bincount(lane, lengths[order] + 1, n).astype(np.int64)
        rank = np.argsort(-size, kind="stable")
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        self.size = size[rank]
        self.steps = int(self.size[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.size, -np.arange(self.steps), side="left")
        by_lane = np.argsort(place[lane], kind="stable")
        order, lane = order[by_lane], place[lane][by_lane]
        begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        total = int(self.size.sum())
        self.inputs, self.classes = np.zeros(total, np.int32), np.zeros(total, np.int32)
        self.slots = np.full(total, -1, np.int32)
        self.start, self.text = np.zeros(total, bool), np.zeros(total, np.int32)
        n_own = lengths[order]
        at = np.cumsum(n_own + 1) - (n_own + 1)
        source = np.arange(int(n_own.sum())) - np.repeat(np.cumsum(n_own) - n_own, n_own)
        target = np.repeat(at, n_own) + source
        source += np.repeat(first[order], n_own)
        self.inputs[target], self.classes[target] = inputs[source], classes[source]
        self.slots[target] = slots[source]
        self.start[at] = True
        self.text[:] = np.repeat(order, n_own + 1)
        self.begin = begin

    def at(self, t: int) -> np.ndarray:
        """Places of step ``t`` of all lanes that are that long."""
        return self.begin[:self.active[t]] + t


class Room:
    """Arrays that windows use one after the other: memory given back and taken anew costs more than the sums in it."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, self.dtype)
        return self.held[name][:size].reshape(shape)

    def rows(self, name: str, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        # "clip" writes to the array itself
        return np.take(of, at, axis=0, out=self(name, len(at), *of.shape[1:]), mode="clip")


def _run(net: Network, lanes: Lanes, begin: int, end: int, h: np.ndarray, room: Room) -> tuple:
    """Steps ``begin`` to ``end`` of the gated unit from the states ``h``.

    Places, and a row for each: the state before (and a one), update and reset gate, candidate and what
    the state gives it; then where each step begins and ends there, which lanes start a text, the last states.
    """
    size = net.state.shape[0]
    places = np.concatenate([lanes.at(t) for t in range(begin, end)])
    n = len(places)
    edges = np.concatenate([[0], np.cumsum(lanes.active[begin:end])]).tolist()
    spans = list(zip(edges, edges[1:], strict=False))
    inputs = room.rows("inputs", net.inputs, lanes.inputs[places]).reshape(n, 3, size).swapaxes(0, 1)
    weights = np.ascontiguousarray(net.state.reshape(size, 3, size).swapaxes(0, 1))
    gates, cand = room("gates", 2, n, size), room("candidate", n, size)
    # exp(-x) of a gate's sum: input and state have the sign already
    np.negative(inputs[:2], out=gates)
    np.negative(weights[:2], out=weights[:2])
    cand[:] = inputs[2]
    before, given, sums = room("before", n, size), room("given", n, size), room("sums", 3 * len(h) * size)
    start = lanes.start[places]
    fresh = [start[s:e] if any_ else None
             for (s, e), any_ in zip(spans, np.logical_or.reduceat(start, edges[:-1]).tolist(), strict=True)]
    for (s, e), new in zip(spans, fresh, strict=True):
        h = h[:e - s]
        if new is not None:
            h[new] = 0
        before[s:e] = h
        u = np.matmul(h, weights, out=sums[:3 * h.size].reshape(3, e - s, size))
        g, c, u_c = gates[:, s:e], cand[s:e], u[2]
        g += u[:2]
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        given[s:e] = u_c
        u_c *= g[1]
        c += u_c
        np.tanh(c, out=c)
        h = h - c
        h *= g[0]
        h += c
    states = room("states", n, size + 1)
    states[:, :-1], states[:, -1] = before, 1
    return places, states, before, gates, cand, given, spans, fresh, h


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Turn scores into exponentials in place: their sums by row, and what was taken off the scores of a row before."""
    off = 0.0
    # the first score of a row is never that of a slot without word, so that no sum comes out zero
    if x.size and (x.max() > 60 or x[:, 0].min() < -60):
        off = x.max(1)
        x -= off[:, None]
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype), off


def _with_bias(net: Network, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes and of the words in them, the bias last."""
    words = room("words", *net.word_bias.shape, net.words.shape[2] + 1)
    words[:, :, :-1], words[:, :, -1] = net.words, net.word_bias
    return np.concatenate([net.out, net.bias[None]]), words


def _word_scores(words: np.ndarray, states: np.ndarray, classes: np.ndarray, slots: np.ndarray, room: Room) -> tuple:
    """Places that have a slot, in order of class, where each class begins and ends there, their states and
    the scores of the words of their class."""
    at = np.flatnonzero(slots >= 0)
    at = at[np.argsort(classes[at].astype(np.int16), kind="stable")]
    own, states = classes[at], room.rows("word states", states, at)
    edges = np.append(_heads(own), len(at)).tolist()
    spans = list(zip(edges, edges[1:], strict=False))
    met = own[edges[:-1]]
    x = room("word scores", len(at), words.shape[1])
    for c, (a, b) in zip(met.tolist(), spans, strict=True):
        np.matmul(states[a:b], words[c].T, out=x[a:b])
    return at, met, spans, states, x


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def log_probability(net: Network, lanes: Lanes, texts: int) -> np.ndarray:
    """Natural log of the probability of classes and of words in them, summed per text.

    Both depend on the state, which runs through whole texts. A token without slot counts with its class alone.
    """
    out = np.zeros(texts)
    size = net.state.shape[0]
    room = Room(net.state.dtype)
    weights, words = _with_bias(net, room)
    h = np.zeros((len(lanes.size), size), net.state.dtype)
    ends = np.cumsum(lanes.active)
    begin = 0
    while begin < lanes.steps:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + 16_384, side="right")))
        places, states, *_, h = _run(net, lanes, begin, end, h, room)
        begin = end
        classes, slots = lanes.classes[places], lanes.slots[places]
        p = np.empty(len(places), states.dtype)
        for a in range(0, len(places), _ROWS):
            own = states[a:a + _ROWS]
            x = np.matmul(own, weights, out=room("scores", len(own), weights.shape[1]))
            picked = x[np.arange(len(x)), classes[a:a + _ROWS]]
            total, off = _exponentials(x)
            p[a:a + _ROWS] = picked - off - np.log(total)
        at, _, _, _, x = _word_scores(words, states, classes, slots, room)
        picked = x[np.arange(len(at)), slots[at]]
        total, off = _exponentials(x)
        p[at] += picked - off - np.log(total)
        np.add(out, np.bincount(lanes.text[places], p, texts), out=out)
    return out


def _descend(part: np.ndarray, held_sum: np.ndarray, where: np.ndarray | slice, grad: np.ndarray, rate: float) -> None:
    """One step against a gradient, shorter where gradients were large before."""
    total = grad * grad
    total += held_sum[where]
    held_sum[where] = total
    total = np.sqrt(total)
    total += 1e-6
    np.divide(grad, total, out=total)
    total *= rate
    part[where] -= total


def train(net: Network, lanes: Lanes, memory: list[np.ndarray], rate: float = RATE, steps: int = STEPS) -> None:
    """One pass over the lanes: windows of ``steps``, gradients end at a window's start, the state goes on."""
    size = net.state.shape[0]
    room = Room(net.state.dtype)
    h = np.zeros((len(lanes.size), size), net.state.dtype)
    for begin in range(0, lanes.steps, steps):
        places, states, before, (z, r), cand, given, edges, fresh, h = _run(
            net, lanes, begin, min(begin + steps, lanes.steps), h, room)
        n = len(places)
        scale = before.dtype.type(1 / n)
        classes, slots = lanes.classes[places], lanes.slots[places]
        weights, words = _with_bias(net, room)
        d_before, d_out = room("to states", n, size), np.zeros_like(weights)
        for a in range(0, n, _ROWS):
            own = states[a:a + _ROWS]
            p = np.matmul(own, weights, out=room("scores", len(own), weights.shape[1]))
            p /= _exponentials(p)[0][:, None]
            p[np.arange(len(p)), classes[a:a + _ROWS]] -= 1
            d_out += own.T @ p
            np.matmul(p, net.out.T, out=d_before[a:a + _ROWS])
        in_class, met, spans, states, p = _word_scores(words, states, classes, slots, room)
        if spans:
            p /= _exponentials(p)[0][:, None]
            p[np.arange(len(p)), slots[in_class]] -= 1
            d_words = room("to words", len(met), *words.shape[1:])
            d_states = room("to word states", len(p), size)
            for k, (c, (a, b)) in enumerate(zip(met.tolist(), spans, strict=True)):
                np.matmul(p[a:b].T, states[a:b], out=d_words[k])
                np.matmul(p[a:b], net.words[c], out=d_states[a:b])
            d_before[in_class] += d_states
            _descend(net.words, memory[4], met, d_words[:, :, :-1] * scale, rate * WORD_RATE)
            _descend(net.word_bias, memory[5], met, d_words[:, :, -1] * scale, rate * WORD_RATE)
        # what the gradient of a state is multiplied by on its way to the gates and the candidate
        factor, to_c, x = room("factor", n, 3, size), room("to candidate", n, size), room("x", n, size)
        y = np.subtract(1, z, out=room("y", n, size))
        np.multiply(cand, cand, out=to_c)
        np.subtract(1, to_c, out=to_c)
        to_c *= y
        y *= z
        np.subtract(before, cand, out=x)
        np.multiply(x, y, out=factor[:, 0])
        np.multiply(to_c, r, out=x)
        factor[:, 2] = x
        x *= given
        np.subtract(1, r, out=y)
        np.multiply(x, y, out=factor[:, 1])
        after = room("after", n, size)
        weights = np.ascontiguousarray(net.state.T)
        d_h = after[:0]
        for (s, e), new in zip(reversed(edges), reversed(fresh), strict=True):
            own = after[s:e]
            own[:len(d_h)], own[len(d_h):] = d_h, 0
            d_u = factor[s:e]
            d_u *= own[:, None]
            d_h = d_u.reshape(e - s, 3 * size) @ weights
            own_z = z[s:e]
            own_z *= own
            d_h += own_z
            d_h += d_before[s:e]
            if new is not None:
                d_h[new] = 0
        d_state = before.T @ factor.reshape(n, 3 * size)
        np.multiply(to_c, after, out=factor[:, 2])
        x = lanes.inputs[places]
        order = np.argsort(x.astype(np.int16) if len(net.inputs) < 1 << 15 else x, kind="stable")
        heads = _heads(x[order])
        d_rows = np.add.reduceat(room.rows("inputs", factor.reshape(n, 3 * size), order), heads, axis=0)
        d_rows *= scale
        _descend(net.inputs, memory[0], x[order[heads]], d_rows, rate)
        for part, held_sum, grad in zip(net.parts()[1:4], memory[1:4], (d_state, d_out[:-1], d_out[-1]), strict=True):
            _descend(part, held_sum, slice(None), grad * scale, rate)


def fit(docs: DataFrame, known: Counts, net: Network, text: str = "text", rounds: int = ROUNDS,
        workers: int = WORKERS, lanes: int = LANES) -> Network:
    """Train on all texts of ``docs``, a share of them in each round.

    A limited number of workers start from the same weights, each passes over
    its own texts, and their weights are averaged by the number of their tokens.
    The averages are made in chunks of the weights; the driver gets one network.
    """
    chunk = 1 << 14
    for k in range(rounds):
        share = docs.select(F.col(text).alias("text")).filter(
            F.pmod(F.xxhash64("text"), F.lit(rounds)) == k if rounds > 1 else F.lit(True))
        start = net.flat().astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            own = Network.of(start, net)
            memory = [np.full(p.shape, 1e-6, np.float32) for p in own.parts()]
            seen = 0
            for part in text_slices(batches, "text", _SLICE):
                numbers, lengths, _ = _number(part, known)
                train(own, Lanes(*_sequences(numbers, known, known.tails()), lengths, lanes), memory)
                seen += int(lengths.sum()) + len(lengths)
            flat = own.flat()
            at = list(range(0, len(flat), chunk)) if seen else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array([seen] * len(at), pa.int64()),
                 pa.array([flat[a:a + chunk].tobytes() for a in at], pa.binary())], names=["at", "n", "part"])

        def mean(group: pd.DataFrame) -> pd.DataFrame:
            total, weight = 0.0, int(group["n"].sum())
            for n, part in zip(group["n"], group["part"], strict=True):
                total = total + np.frombuffer(part, np.float32).astype(float) * (n / weight)
            return pd.DataFrame({"at": group["at"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

        rows = (share.coalesce(workers).mapInArrow(run, "at long, n long, part binary")
                .groupBy("at").applyInPandas(mean, "at long, part binary").collect())
        for r in rows:
            part = np.frombuffer(r.part, np.float32)
            start[r.at:r.at + len(part)] = part
        net = Network.of(start, net)
    return net


def score(docs: DataFrame, training: DataFrame, text: str = "text", lanes: int = LANES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows of ``training``. ``base_score`` is the log10 probability by smoothed word counts, ``score``
    that of the network: of each token's class given all tokens before it in
    the text, times that of the word among those of its class, a softmax with learned weights of the same
    state. In the classes of words rarer than those of the network, a word's share is its count's, where
    counts and one unseen word are smoothed by a half. Texts end with a token of their own. Null and empty
    texts are the end alone; null and repeated doc_ids give a row each; other columns are ignored;
    an empty table gives no rows; without training rows nothing is known.

    Counts are of the whole corpus. Tasks get those of a limited number of frequent words;
    all rarer words of the texts meet their counts in a shuffle join.
    """
    docs, training = stable(docs), stable(training)
    counts = written(word_counts(training, text), "word-counts")
    known = frequent(counts, training.count())
    known.token = uuid.uuid4().hex
    make_classes(known, neighbourhoods(training, known, text))
    tails = _tail_totals(counts, known)
    known.tail_total = tails[:, 0] + 0.5 * (tails[:, 1] + 1)
    net = fit(training, known, first_network(known, tails[:, 0]), text, lanes=lanes)
    log_counts = np.log10(known.counts + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", _SLICE):
            own, lengths, rare = _number(part, known)
            n, text_of = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
            inputs, classes, slots = _sequences(own, known, known.tails())
            value = log_probability(net, Lanes(inputs, classes, slots, lengths, lanes), n) / _LOG10
            counted = own >= 0
            base = np.zeros(len(own))
            base[counted] = log_counts[own[counted]]
            within = np.zeros(len(own))
            tail = slots < 0
            within[tail] = base[tail] - np.log10(known.tail_total[classes[tail] - 1])
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), part.column("doc_id"), pa.array(lengths + 1),
                 pa.array(np.bincount(text_of, counted, n).astype(np.int64)),
                 pa.array(np.bincount(text_of, base, n)), pa.array(value + np.bincount(text_of, within, n)),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text_of, ~counted, n))]),
                                                   pa.int32(), safe=False), rare.cast(pa.string()))],
                names=["_row", "doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    made = written(with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")))
                   .mapInArrow(run, "_row long, doc_id long, n_tokens long, n_known long, base double, "
                                    "score double, rare array<string>"), "scored")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    rare = (made.select("_row", F.explode("rare").alias("word")).join(counts, "word", "left")
            .groupBy("_row").agg(F.sum(log).alias("more"), F.count("n").alias("more_known")))
    more, total = F.coalesce("more", F.lit(0.0)), known.total + 0.5 * (known.distinct + 1)
    end = math.log10(known.ends + 0.5)
    return made.drop("rare").join(rare, "_row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(known.ends > 0)).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + more + F.lit(end) - F.col("n_tokens") * F.lit(math.log10(total))).alias("base_score"),
        (F.col("score") + more).alias("score"))


def _tail_totals(counts: DataFrame, known: Counts) -> np.ndarray:
    """Tokens and distinct words of each class of words outside the network."""
    inside = set(known.words[:known.network])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode() for w in batch.column("word").to_pylist()]
            n = batch.column("n").to_numpy()
            at = tail_classes(words)
            kept = np.array([w not in inside for w in words], bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(_TAILS)), pa.array(np.bincount(at[kept], n[kept], _TAILS).astype(np.int64)),
                 pa.array(np.bincount(at[kept], minlength=_TAILS))], names=["tail", "n", "words"])

    out = np.zeros((_TAILS, 2))
    for r in (counts.mapInArrow(run, "tail long, n long, words long").groupBy("tail")
              .agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()):
        out[r.tail] = r.n, r.words
    return out
