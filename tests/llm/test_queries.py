"""The registered queries: contract columns, and the rows of their SQL."""

import duckdb
import pytest

import __spark_entry__

COLUMNS = {
    "op1": "doc_id n_shingles component_id",
    "op2": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3": "doc_id n_words n_removed kept_sha256",
    "op4": "doc_id size source_size target taken",
    "op5": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7": "query_id rank vec_id score",
    "op8": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9": "doc_id text",
    "op10": "doc_id held_out lang_pred score",
    "op11": "page_id payload_bytes payload_digest record_type refers_to",
    "op12": "lang rank phrase a l r n score",
    "op13": "item_id rank doc_id score",
}


def test_one_query_for_each_operator(spark, sf):
    found = {k.split("_")[0]: f for k, f in __spark_entry__.queries().items() if k.startswith("op")}
    assert found.keys() == COLUMNS.keys()
    for n, names in COLUMNS.items():
        assert set(names.split()) <= set(found[n](spark, sf).columns), n


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op3_substring_dedup", "op4_source_mixing", "op11_warc_archives", "op12_phrase_collocations", "op13_ranked_search"])
def test_rows_of_the_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf)
    order = ", ".join(df.columns)
    expected = con.execute(f"SELECT {order} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)
