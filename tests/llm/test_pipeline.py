"""The pipeline's stages against brute force on the smallest table."""

import corpus_pipeline
from cadastra.llm import mixing, ngram_join, pii


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        if name != "byte_bpe":
            assert spark.read.parquet(f"{tmp_path}/{name}").columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
    language, near, private, mixed, coded = kept
    assert language.count() == len(before)  # all of these texts have a language
    stay = {r["component_id"] for r in ngram_join.join(language, 5, 80).collect()}
    assert {r["doc_id"] for r in near.collect()} == stay
    for r in private.collect():
        own = list(pii.entities(before[r["doc_id"]]["text"]))
        assert (r["text"] == before[r["doc_id"]]["text"]) == (not own) and r["n_chars"] == len(r["text"])
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(private).collect() if r["copies"]}
    found = [r["doc_id"] for r in mixed.collect()]
    assert {d: found.count(d) for d in found} == taken
    rows = coded.collect()
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    assert all(r["text"] == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in rows) and len(rows) == len(found)


def test_run_gives_the_last_stage(spark, sf):
    assert "ids" in corpus_pipeline.run(spark, sf).columns


def test_stages_keep_clashing_columns(spark, sf):
    from pyspark.sql import functions as F

    names = ["_id", "_words", "_stay", "_again", "_text", "_key", "size", "copies", "component_id", "key", "kind"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (10_000, "", None, None, None), (10_001, "call 201-5550 and Mr Foo Bar", "en", None, 3)] * 2, docs.schema)
    docs = docs.union(odd).withColumns({n: F.lit(n) for n in names})
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.surrogates, corpus_pipeline.mixture):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and all(r[n] == n for r in out.collect() for n in names)
    assert set(docs.columns) < set(corpus_pipeline.tokens(spark, docs, sf).columns)
    assert corpus_pipeline.language(spark, docs, sf).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
