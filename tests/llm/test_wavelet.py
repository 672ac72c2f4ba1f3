"""Wavelet matrices against plain arrays, and shards against the public tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logweave.llm import wavelet as W


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 300), (5000, 50257), (600_000, 9), (3000, 90_000)])
def test_matrix(n, top):
    r = np.random.default_rng(n)
    ids = r.integers(0, top, n).astype(np.uint32)
    m = W.WaveletMatrix(W.build(ids, [1, None], np.array([n, 0])))
    assert m.tokens().tolist() == ids.tolist()
    assert m.documents()[0] == [1, None]
    for i in r.integers(0, n, 20).tolist() if n else []:
        assert m.access(i) == ids[i]
        a, b = sorted(r.integers(0, n + 1, 2).tolist())
        assert m.count(int(ids[i]), a, b) == int((ids[a:b] == ids[i]).sum())
        where = np.flatnonzero(ids == ids[i])
        k = int(r.integers(len(where)))
        assert m.occurrence(int(ids[i]), k) == where[k]
        assert m.occurrence(int(ids[i]), len(where)) is None
    assert m.count(1 << 20) == 0


def test_shards(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(2)
    rows = [(i, r.choice([None, "", "a b\nc  d", "<|endoftext|> x", "ünï " * r.randrange(50), "w" * 3000]), "x")
            for i in range(-20, 200)]
    rows += [(None, "no id", "x"), (5, "again", "y")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = W.read_shards(W.write_shards(df, P.path("byte_bpe_50k.json"), shard_tokens=300)).collect()
    got.sort(key=lambda x: x.start)
    at = 0
    for x in got:
        assert x.start == at and x.n_tokens == len(x.ids) // 4
        at += x.n_tokens
    ids = [x.doc_id for x in got]
    assert ids[0] is None and ids[1:] == sorted(x[0] for x in rows if x[0] is not None)
    want = sorted((str(d), tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for d, x, _ in rows)
    assert sorted((str(x.doc_id), tuple(np.frombuffer(x.ids, "<u4").tolist())) for x in got) == want
    checked = {x.start: x.ids_crc32 for x in W.checks(W.read_shards(W.write_shards(df, P.path("byte_bpe_50k.json")))).collect()}
    assert checked == {x.start: zlib.crc32(x.ids) for x in got}
    assert W.read_shards(W.write_shards(df.limit(0), P.path("byte_bpe_50k.json"))).count() == 0


def test_columns_equal_the_library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    signs = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u2028",
             "\u3000", "\u1680", "\u202f", "\u205f", "\u180e", "\u200b", "'", "'s", "'re", "don't", ".", "!!", "1", "½", "²", "中",
             "ß", "x\u0301", "«", "…", "\U0001f600", "\0", "\x7f", "_", "ª", "ʰ", "ⅷ", "<|endoftext|>", "The ", "\U00010d50"]
    r = random.Random(6)
    texts = [None, "", *("".join(r.choices(signs, k=r.randrange(14))) for _ in range(8000)), "w" * 3000, None]
    encoder = W._Encoder(P.path("byte_bpe_50k.json"), kept=50)
    ids, n = encoder.column(pa.array(texts).slice(1))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts[1:]]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert [x.tolist() for x in encoder.column(pa.array([], pa.string()))] == [[], []]


def test_words_are_encoded_once_whatever_signs_follow(monkeypatch):
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmné"]
    text = "".join(f"{w}{s}" for s in (" ", ". ", ", ", "!\n", "; ") for w in words)
    encoder, calls = W._Encoder(P.path("byte_bpe_50k.json")), []
    for name in ("_piece", "_whole"):
        monkeypatch.setattr(encoder, name, lambda c, of=getattr(encoder, name): calls.append(c) or of(c))
    ids, _ = encoder.column(pa.array([text] * 3))
    assert ids.tolist() == 3 * encoder.tokenizer.encode(text, add_special_tokens=False).ids
    # with a blank before them and without; signs count as well
    assert len(calls) < 2.2 * len(words)
