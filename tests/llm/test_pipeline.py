"""Each stage on what the one before it kept, against brute force."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_decontaminate import brute as leaks
from test_simhash_dedup import components_of, plain_fingerprint
from test_substring_dedup import brute as repeats

import corpus_pipeline
from logweave.llm import bpe, line_crf
from logweave.llm.queries import quality_model


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The smallest tables with copies, near copies, a leak and rows with nulls."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    item = spark.read.parquet(f"{path}/benchmark.parquet").first().text
    rows = docs.collect()
    good = [r for r in rows if r.text and len(r.text.split()) > 60][:12]
    more = [(10_000 + i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(good)]
    more += [(10_100, good[0].text + " and some words more " + item, "en", None, None), (10_101, item, None, "s", 1),
             (None, good[1].text, "en", "s", 1), (10_102, None, "en", "s", 0), (10_103, "", "en", "s", 0)]
    docs.union(spark.createDataFrame(more, docs.schema)).coalesce(3).write.parquet(f"{path}/documents.parquet")
    return path


def key(d):
    return (1 << 62) if d is None else d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "byte_bpe"]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    model = quality_model(spark, folder)
    kept = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in kept.collect()]
        after = stage(spark, kept, folder)
        if n < 4:
            assert after.columns == columns
        rows = after.collect()
        if n == 0:
            ok = line_crf.score_texts(__import__("pyarrow").array([t for _, t in before]), model) >= 0.3
            want = [b for b, k in zip(before, ok, strict=True) if k]
            assert 0 < len(want) < len(before)
        elif n == 1:
            fp = {}
            for d, t in before:
                fp.setdefault(plain_fingerprint(t), []).append((d, t))
            want = [min((x for f in g for x in fp[f]), key=lambda x: key(x[0])) for g in components_of(fp)]
            assert len(want) < len(before)
        elif n == 2:
            cut = {key(d): (removed, rest) for d, _, removed, rest in repeats([(key(d), t) for d, t in before])}
            want = [(d, cut[key(d)][1] if cut[key(d)][0] else t) for d, t in before]
            assert any(removed for removed, _ in cut.values())
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        elif n == 3:
            bad = {d for d, _ in leaks(before, items)}
            want = [b for b in before if b[0] not in bad]
            assert bad
        else:
            ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
            library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            ids = {key(d): library.encode_ordinary(t or "") for d, t in before}
            assert {key(r.doc_id): (r.n_tokens, r.ids_sha256) for r in rows} == {
                d: (len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for d, i in ids.items()}
            break
        assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(want, key=repr)
        after.write.parquet(f"{folder}/stage-{n}")
        kept = spark.read.parquet(f"{folder}/stage-{n}")
    assert corpus_pipeline.run(spark, folder).count() == len(rows)
