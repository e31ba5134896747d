"""The registered queries over the smallest tables: their columns, their rows, and op2's classes against all pairs."""

import itertools

import duckdb
import pytest

from foliant.llm import near_dedup, queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_files": "doc_id start n_tokens ids_crc32",
    "op2_near_dedup": "doc_id class_id",
    "op3_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op4_bpe_tree": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_preference_pairs": "pair_id prompt_turns prompt chosen rejected",
    "op6_html_text": "page_id url text n_chars",
    "op7_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op9_quality": "doc_id held_out score predicted",
    "op10_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.mark.parametrize("name", [n for n in COLUMNS if n != "op2_near_dedup"])
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    key = df.columns[0]
    got = {r[0] for r in df.select(key).collect()}
    table, own = {"pair_id": ("conversations", "conv_id"), "page_id": ("pages", "page_id")}.get(key, ("documents", "doc_id"))
    want = {r[0] for r in duckdb.sql(f"SELECT DISTINCT {own} FROM '{DATA}/{table}.parquet'").fetchall()}
    assert got == want if name != "op5_preference_pairs" else got and got <= want


def test_near_dedup_of_documents(spark):
    """No pair at 0.8 or more of the documents lies in two classes."""
    got = {r.doc_id: r.class_id for r in queries.op2_near_dedup(spark, DATA).collect()}
    bags = {d: near_dedup.shingles(t or "") for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}
    assert got.keys() == bags.keys()
    parent = {d: d for d in bags}
    links = [(a, b) for a, b in itertools.combinations(sorted(bags), 2) if near_dedup.overlap(bags[a], bags[b]) >= near_dedup.SIMILARITY]
    for a, b in links:
        low, high = sorted((parent[a], parent[b]))
        parent = {d: low if p == high else p for d, p in parent.items()}
    assert links and got == parent
