"""Prefix-table BPE against the public library, appends, edits and odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from logweave.llm import bpe

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixEncoder(RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts(n=300, seed=1):
    r = random.Random(seed)
    for _ in range(n):
        yield "".join(r.choice(["the", "ing", " ", "  ", "\n", "é", "ß", "日本", "\u3000", "\n", "\n", " ", " ", "\x1c", "'s", "12", "!!", "aaaa",
                                "🙂", " ", "x", "er", "Th"]) for _ in range(r.randrange(60)))


def test_equals_library(encoder, library):
    split = regex.compile(P.PATTERN).findall
    _, chunks = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in [*odd_texts(), "a" * 5000, "<|endoftext|>"]:
        want = library.encode_ordinary(t)
        assert [i for p in split(t) for i in encoder.encode(p.encode())] == want
        assert np.frombuffer(chunks.text(t), "<u4").tolist() == want


def test_random_bytes(encoder, library):
    r = random.Random(3)
    for _ in range(200):
        data = bytes(r.choice(b"abcdeinst \xc3\xa9\xff") for _ in range(r.randrange(1, 40)))
        ids = encoder.encode(data)
        assert encoder.decode(ids) == data and ids == library._encode_single_piece(data)


def test_appends_and_edits(encoder, library):
    r = random.Random(5)
    for t in odd_texts(60, 7):
        e = bpe.EncodedText(encoder, P.PATTERN, t)
        for more in odd_texts(3, r.randrange(999)):
            e.append(more)
            assert e.ids() == library.encode_ordinary(e.text)
            a = r.randrange(len(e.text) + 1)
            b = min(len(e.text), a + r.randrange(5))
            e.edit(a, b, more[:4])
            assert e.ids() == library.encode_ordinary(e.text)


def test_rows(spark, library):
    texts = [None, "", "the end", "the end", "x " * 200_000, "é\n\n  ü"]
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)],
                               "doc_id int, text string, ids string")
    got = sorted(bpe.digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect(),
                 key=lambda x: x[0] or 0)
    for row, t in zip(got, texts, strict=True):
        ids = library.encode_ordinary(t or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    path = P.path("byte_bpe_50k.tiktoken")
    assert sorted(map(tuple, bpe.decode(bpe.encode(df, path, P.PATTERN), path).collect()), key=repr) == \
        sorted(map(tuple, bpe.round_trip(df, path, P.PATTERN).collect()), key=repr)
    assert bpe.digests(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
