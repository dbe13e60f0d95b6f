"""All queries are registered, give their contract's columns, and equal their SQL twins."""

import pytest

import __spark_entry__ as entry
import oracle

COLUMNS = {
    "op1_license_scan": {"doc_id", "license", "template", "containment", "first_word", "windows"},
    "op2_exact_topk": {"query_id", "rank", "vec_id", "score"},
    "op3_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op7_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op8_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op9_simhash_dedup": {"doc_id", "fingerprint", "component_id"},
    "op10_jump_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op11_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op12_conversation_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
    "op13_katz_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}
TWINS = ("op2_exact_topk", "op3_secret_scan", "op6_exact_dedup")


def test_registration():
    assert {n for n in entry.queries() if n.startswith("op")} - {"op"} >= set(COLUMNS) and "pipeline" in entry.queries()
    assert {n for n in entry.oracle_sql() if n in COLUMNS} == set(TWINS)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert set(df.columns) == COLUMNS[name]
    if name in TWINS:
        assert oracle.compare(df.toPandas(), oracle.connect(sf).execute(entry.oracle_sql()[name]).df()) is None
    elif "audit" in df.columns:
        assert df.count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    elif "piece" not in df.columns and name != "op1_license_scan":
        assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
