"""Queries keep what the reference keeps, where the test tables have no such rows."""

from cadastra.plans import queries


def test_hash_prefix_keeps_rows_without_text(spark, tmp_path):
    rows = [(1, "a", "en"), (2, "A", "en"), (3, None, "en"), (4, None, "en"), (5, "  ", "en"), (6, "  ", "en"), (7, "a", "fr"), (8, "\t\n", "en"), (9, "\t\n", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["dedup_hash_prefix"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 3, 4, 5, 6, 7, 8, 9]
