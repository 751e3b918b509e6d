"""Every registered query of this subpackage on the smallest data; those with SQL against it."""

import pytest
from compare import connect, difference

import pairbench.llm.queries  # noqa: F401  (it registers queries)
from pairbench.workload.registry import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
    "op2_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_benchmark_decontamination": ["doc_id", "item_id", "edits", "start", "finish"],
    "op5_token_id_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_mixing_to_weights": ["doc_id", "source", "start_char", "block", "slot", "in_mix"],
    "op9_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op10_exact_top_k": ["query_id", "rank", "vec_id", "score"],
    "op11_ranked_lexical_search": ["item_id", "rank", "doc_id", "score"],
    "op12_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op13_phrase_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


def test_names():
    assert set(COLUMNS) == {q for q in QUERIES if q.startswith("op")}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns == COLUMNS[name]
    if name in CHECKS:
        assert difference(df, connect(FOLDER), CHECKS[name]) is None
    elif "doc_id" in df.columns and name != "op4_benchmark_decontamination":
        assert df.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    else:
        assert df.count() > 0
