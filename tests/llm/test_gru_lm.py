"""The network against plain steps and differences, counts against brute force, odd rows."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from logweave.llm import gru_lm as G


#: Words of each class; classes without have tokens without slot.
WORDS = (0, 0, 3, 1, 5, 0, 4)


def small(classes=7, inputs=9, size=4, seed=1, words=WORDS):
    r = np.random.default_rng(seed)
    width = max(1, *words)
    net = G.Network(*(r.normal(size=s).astype(np.float64) * 0.5 for s in
                      ((inputs, 3 * size), (size, 3 * size), (size, classes), (classes,),
                       (classes, width, size), (classes, width))))
    net.word_bias[np.arange(width) >= np.array(words)[:, None]] = G._NO_WORD
    return net


def sequences(seed=2, texts=11):
    r = np.random.default_rng(seed)
    lengths = r.integers(0, 9, texts)
    classes = r.integers(1, 7, lengths.sum())
    slots = np.array([r.integers(WORDS[c]) if WORDS[c] else -1 for c in classes])
    return r.integers(1, 9, lengths.sum()), classes, slots, lengths


def plain(net, inputs, classes, slots, lengths):
    out, at = [], 0
    size = net.state.shape[0]
    for n in lengths:
        h, total = np.zeros(size), 0.0
        for x, c, word in [*zip(inputs[at:at + n], classes[at:at + n], slots[at:at + n]), (0, 0, -1)]:
            s = h @ net.out + net.bias
            total += s[c] - math.log(np.exp(s).sum())
            if word >= 0:
                s = {k: h @ net.words[c, k] + b for k, b in enumerate(net.word_bias[c]) if b > G._NO_WORD / 2}
                total += s[word] - math.log(sum(math.exp(v) for v in s.values()))
            u, a = h @ net.state, net.inputs[x]
            z, r = (1 / (1 + np.exp(-(a + u)[k * size:(k + 1) * size])) for k in (0, 1))
            cand = np.tanh(a[2 * size:] + r * u[2 * size:])
            h = (1 - z) * cand + z * h
        out.append(total)
        at += n
    return np.array(out)


def test_state_runs_through_whole_texts():
    net, (x, c, w, n) = small(), sequences()
    want = plain(net, x, c, w, n)
    for lanes in (1, 3, 100):
        assert np.allclose(G.log_probability(net, G.Lanes(x, c, w, n, lanes), len(n)), want, atol=1e-4)


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(G, "WORD_RATE", 1.0)
    net, (x, c, w, n) = small(), sequences()
    lanes = G.Lanes(x, c, w, n, 4)
    big, rate = 1e12, 1.0
    after = G.Network(*(p.copy() for p in net.parts()))
    G.train(after, lanes, [np.full(p.shape, big) for p in net.parts()], rate=rate, steps=10_000)
    tokens = n.sum() + len(n)
    for k, part in enumerate(net.parts()):
        step = (part - after.parts()[k]) * math.sqrt(big) / rate
        flat = np.random.default_rng(k).choice(part.size, min(7, part.size), replace=False)
        for i in flat:
            values = []
            for d in (1e-4, -1e-4):
                moved = G.Network(*(p.copy() for p in net.parts()))
                moved.parts()[k].ravel()[i] += d
                values.append(-plain(moved, x, c, w, n).sum() / tokens)
            assert abs((values[0] - values[1]) / 2e-4 - step.ravel()[i]) < 1e-3


def test_training_lowers_the_loss():

    lengths = np.full(64, 30)
    c = np.concatenate([np.where(np.arange(30) % 2 == k % 2, 1, 2) for k in range(64)])
    net = small(3, 3, 8, words=(0, 0, 0))
    lanes = G.Lanes(c, c, np.full(len(c), -1), lengths, 16)
    before = G.log_probability(net, lanes, 64).sum()
    memory = [np.full(p.shape, 1e-6) for p in net.parts()]
    for _ in range(20):
        G.train(net, lanes, memory)
    assert G.log_probability(net, lanes, 64).sum() > 0.6 * before


def test_tail_classes():
    words = [b"plain", b"end.", "ünder".encode(), "señor,".encode(), "é".encode(), b"\xff", b"x"]
    got = G.tail_classes(words)
    assert got.min() >= 0 and got.max() < G._TAILS
    assert got[0] == got[6] == 0 and got[1] == 1 and got[3] % 2 == 1 and got[2] > 1
    assert len(G.tail_classes([])) == 0


def brute(rows, training):
    counts = Counter()
    for t in training:
        counts.update((t or "").encode().lower().split() + [None])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        w = (t or "").encode().lower().split() + [None]
        out.append((d, len(w), sum(counts[x] > 0 for x in w), total,
                    sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)))
    return out


def test_counts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "NETWORK_WORDS", 30)
    monkeypatch.setattr(G.frequent, "__defaults__", (60,))
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(200)] + ["É.", "ß", "A", "a"]
    rows = [(i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=r.randrange(80))), "c")
            for i in range(150)]
    rows += [(None, "w1 w2", "c"), (5, None, "c"), (5, "", "c"), (999, "never seen before", "c"), (1000, "w0 " * 30_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    training = df.filter("doc_id < 100")
    got = G.score(df, training).collect()
    key = lambda x: (str(x[0]), x[1], x[2], round(x[4], 3))
    want = sorted(brute([r[:2] for r in rows], [r[1] for r in rows if r[0] is not None and r[0] < 100]), key=key)
    have = sorted(((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in got), key=key)
    for a, b in zip(have, want, strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4]))
    assert all(np.isfinite(x.score) and x.score < 0 for x in got)
    assert G.score(df.limit(0), training).count() == 0
    alone = G.score(df, df.limit(0)).collect()
    assert len(alone) == len(rows) and {x.n_known for x in alone} == {0} and {x.train_tokens for x in alone} == {0}


def test_words_in_a_class_follow_the_state():
    """Two words of one class by turns: only learned weights of the state tell which is next."""
    lengths = np.full(64, 30)
    w = np.concatenate([(np.arange(30) + k) % 2 for k in range(64)])
    c = np.ones(len(w), int)
    net = small(2, 3, 8, words=(0, 2))
    lanes = G.Lanes(1 + w, c, w, lengths, 16)
    memory = [np.full(p.shape, 1e-6) for p in net.parts()]
    for _ in range(60):
        G.train(net, lanes, memory)
    # by counts each word has half of its class
    assert G.log_probability(net, lanes, 64).sum() > 0.3 * len(w) * math.log(0.5)


def test_score_equals_plain_steps(spark, monkeypatch):
    """P(class) x P(word | class) of each token, step by step, from the counts of the training texts."""
    monkeypatch.setattr(G, "NETWORK_WORDS", 40)
    monkeypatch.setattr(G.frequent, "__defaults__", (70,))
    kept = {}

    def fitted(docs, known, net, text="text", **_):
        r = np.random.default_rng(5)
        kept["net"] = G.Network(*((p + r.normal(size=p.shape) * 0.3).astype(np.float32) for p in net.parts()))
        kept["known"] = known
        return kept["net"]

    monkeypatch.setattr(G, "fit", fitted)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(120)] + ["É.", "ß", "end."]
    rows = [(i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=r.randrange(50))))
            for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.score for x in G.score(df, df.filter("doc_id < 60")).collect()}
    net, known = kept["net"], kept["known"]
    counts = Counter(w for i, t in rows if i < 60 for w in t.encode().lower().split())
    number = {w: i for i, w in enumerate(known.words[:known.network])}
    assert len(number) > 10 and net.word_bias.shape[1] > 1
    mass, distinct = Counter(), Counter()
    for w, n in counts.items():
        if w not in number:
            mass[int(G.tail_classes([w])[0])] += n
            distinct[int(G.tail_classes([w])[0])] += 1
    for i, t in rows:
        x, c, slots, tails = [], [], [], 0.0
        for w in t.encode().lower().split():
            if w in number:
                x.append(1 + G._TAILS + number[w])
                c.append(known.class_of[number[w]])
                slots.append(known.slot_of[number[w]])
            else:
                k = int(G.tail_classes([w])[0])
                x.append(1 + k)
                c.append(1 + k)
                slots.append(-1)
                tails += math.log((counts[w] + 0.5) / (mass[k] + 0.5 * (distinct[k] + 1)))
        want = (plain(net, x, c, slots, [len(x)])[0] + tails) / math.log(10)
        assert abs(got[i] - want) < 1e-4 * max(1, abs(want))


def test_model_beats_counts_on_held_out_texts(spark):
    r = random.Random(3)
    def text():
        own = r.choice(["a", "b", "c"])
        return " ".join(f"{own}{min(int(r.expovariate(0.15)), 60)}" for _ in range(60))
    df = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string")
    got = G.score(df, df.filter("doc_id % 5 <> 1")).filter("doc_id % 5 = 1").collect()
    assert sum(x.score for x in got) > 0.9 * sum(x.base_score for x in got)


def test_classes_stay_small():
    r = np.random.default_rng(9)
    n = G.NETWORK_WORDS
    known = G.Counts([b"w%d" % i for i in range(n)], np.arange(2 * n, n, -1), 1 << 24, n, 1)
    G.make_classes(known, r.integers(0, 50, (n, G.ANCHORS)).astype(float))
    assert np.bincount(known.class_of).max() <= 64 and len(np.unique(known.class_of)) >= n // 64


def test_words_are_numbered_at_less_cost_than_one_by_one():
    r = random.Random(6)
    vocabulary = [f"W{i}" for i in range(3000)] + ["É.", "ß", "Ende!", "señor,", "日本"]
    texts = ["", None, "\t  \n", "no", "spaces", " in\x0bfront\x0cand  behind ", "nb\xa0sp A\x00b"]
    texts += [" ".join(r.choices(vocabulary, k=200)) for _ in range(1000)]
    counts = Counter(w for t in texts for w in (t or "").encode().lower().split())
    words = [w for w, _ in counts.most_common(2000)]
    known = G.Counts(words, np.array([counts[w] for w in words]), sum(counts.values()), len(counts), len(texts), "numbers")
    # slices of a batch have offsets of their own
    part = pa.RecordBatch.from_arrays([pa.array(["before", *texts, "behind"])], names=["text"]).slice(1, len(texts))

    def plain():
        ids, out, rare, lengths = {w: i for i, w in enumerate(words)}, [], [], []
        for t in part.column("text").to_pylist():
            own = (t or "").encode().lower().split()
            found = [ids.get(w, -1) for w in own]
            rare += [w for w, i in zip(own, found) if i < 0]
            lengths.append(len(own))
            out += found
        out = np.array(out)
        out[out < 0] = -1 - G.tail_classes(rare)
        return out, lengths, rare

    def seconds(run):
        taken = []
        for _ in range(7):
            begin = time.process_time()
            run()
            taken.append(time.process_time() - begin)
        return min(taken)

    own, lengths, rare = G._number(part, known)
    want = plain()
    assert own.tolist() == want[0].tolist() and lengths.tolist() == want[1] and rare.to_pylist() == want[2]
    assert seconds(lambda: G._number(part, known)) < 0.8 * seconds(plain)


def test_counts_are_added_up_over_flushes(spark, monkeypatch):
    monkeypatch.setattr(G, "_COUNT_ROWS", 50)
    monkeypatch.setattr(G, "_SLICE", 300)
    r = random.Random(8)
    texts = [" ".join(r.choices(["A", "a", "É", "b\nc", *map(str, range(60))], k=r.randrange(40))) for _ in range(90)] + [None, ""]
    got = G.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()
    want = Counter(w.decode() for t in texts for w in (t or "").encode().lower().split())
    assert {x.word: x.n for x in got} == want and len(got) == len(want)


def test_rows_with_large_scores():
    """Scores far from zero give what a softmax in double precision gives."""
    r = np.random.default_rng(3)
    for move in (0, 200, -200):
        x = (r.normal(size=(9, 6)) * 3 + move).astype(np.float32)
        x[:, 4] = G._NO_WORD
        want = x.astype(float) - (move + np.log(np.exp(x.astype(float) - move).sum(1, keepdims=True)))
        picked = x[:, 1].copy()
        total, off = G._exponentials(x)
        assert np.allclose(picked - off - np.log(total), want[:, 1], atol=1e-3)
