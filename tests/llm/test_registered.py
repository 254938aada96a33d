"""The registered queries themselves, on the smallest tables: their columns, kinds and rows."""

import pytest

from riskloom.llm import queries

SMALL = "/root/testdata/sf0.001"
#: Columns that each query must return, in this order and first; rows per row of the table, where that is fixed.
CONTRACT = {
    "op1_lm_score": ("documents", "doc_id held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double"),
    "op2_secret_scan": ("documents", "doc_id n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string"),
    "op3_toxicity": ("documents", "doc_id held_out:boolean score:double predicted:int"),
    "op4_warc": ("pages", "page_id payload_bytes:bigint payload_digest:string record_type:string refers_to"),
    "op7_top_k": (None, "query_id:bigint rank:int vec_id:bigint score:bigint"),
    "op9_mixing": ("documents", "doc_id size:bigint source_size:bigint target:double taken:bigint"),
    "op10_quality_rules": ("documents", "doc_id n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint "
                                        "base_failed:boolean kept:boolean"),
    "op11_substring_dedup": ("documents", "doc_id n_words:bigint n_removed:bigint kept_sha256:string"),
    "op12_fp_tree_search": (None, "item_id rank:int doc_id:bigint score:bigint"),
    "op13_hard_negatives": (None, "anchor_id:bigint positive_id:bigint rank:int negative_id:bigint positive_score:bigint negative_score:bigint"),
}


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_and_rows(spark, name):
    table, columns = CONTRACT[name]
    got = queries.queries()[name](spark, SMALL)
    kinds = dict(got.dtypes)
    for column in columns.split():
        column, _, kind = column.partition(":")
        assert column in kinds and kind in ("", kinds[column]), (column, kinds.get(column))
    rows = got.collect()
    if table:
        ids = sorted(r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(got.columns[0]).collect())
        assert sorted(r[got.columns[0]] for r in rows) == ids
    else:
        assert rows


def test_groups_and_bins_hold_every_document(spark):
    ids = sorted(r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())
    found = queries.queries()["op8_bagminhash"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in found) == ids and all(r.group_id <= r.doc_id for r in found)
    assert {r.doc_id for r in queries.queries()["op6_sharding"](spark, SMALL).collect()} == set(ids)
    assert {r.doc_id for r in queries.queries()["op5_packing"](spark, SMALL).collect()} <= set(ids)
