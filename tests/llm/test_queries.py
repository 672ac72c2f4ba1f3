"""The registered queries: columns, and a row for every row of their table."""

import pytest

import __spark_entry__ as entry

COLUMNS = {
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_simhash_near_dedup": "doc_id fingerprint component_id",
    "op4_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op5_gru_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op7_wavelet_tokens": "doc_id start n_tokens ids_crc32",
    "op8_html_extraction": "page_id url text n_chars",
    "op9_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_quality_classifier": "doc_id held_out score predicted",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op12_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_whole_table(spark, sf, name):
    table, key = next((t, k) for t, k in (("pages", "page_id"), ("embeddings", "vec_id"), ("documents", "doc_id")) if k in COLUMNS[name])
    df = entry.queries()[name](spark, sf)
    assert df.columns[:len(COLUMNS[name].split())] == COLUMNS[name].split()
    want = sorted(r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in df.select(key).collect()) == want


def test_leaks_are_pairs(spark, sf):
    df = entry.queries()["op1_benchmark_decontamination"](spark, sf)
    assert df.columns == ["doc_id", "item_id", "similarity", "start", "n_words"]
    assert all(0.8 <= r.similarity <= 1 for r in df.collect())
