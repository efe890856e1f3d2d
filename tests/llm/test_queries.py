"""The registered queries on the smallest tables: columns in the order of their contract, and DuckDB's rows where SQL exists."""

import duckdb
import pytest

from chunkwright.llm import queries

SF = "/root/testdata/sf0.001"
# The first columns that each query returns, with their types.
COLUMNS = {
    "op1_html_wrappers": "page_id bigint, url string, text string, n_chars bigint",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_decontamination": "doc_id bigint, item_id bigint",
    "op4_warc_round_trip": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_token_tables": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_order_minhash": "doc_id bigint, class_id bigint, n_verified bigint",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}


def test_all_queries_have_columns():
    assert set(COLUMNS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    got = queries.QUERIES[name](spark, SF)
    want = COLUMNS[name].split(", ")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema.fields][: len(want)] == want
    tables = {"op1_html_wrappers": "pages", "op4_warc_round_trip": "pages"}
    if name not in ("op3_decontamination", "op10_best_fit_packing", "op11_hard_negatives", "op12_prefix_trie"):
        assert got.count() == spark.read.parquet(f"{SF}/{tables.get(name, 'documents')}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    names = sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted((tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall()), key=repr)
