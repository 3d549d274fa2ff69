"""The registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from cadastra.llm import ann, bpe, collocations, langid, lexical, mixing, ngram_join, oracles, pii, pitman_yor, substrings, suffixes, warc
from cadastra.llm.fingerprints import fingerprint_pairs
from cadastra.llm.tables import table


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_suffix_array_dedup(spark, sf_dir):
    found = suffixes.dedup(table(spark, sf_dir, "documents"), window=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_substring_dedup(spark, sf_dir):
    found = substrings.dedup(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark, sf_dir):
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN)


def op6_pitman_yor_scores(spark, sf_dir):
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_document_fingerprints(spark, sf_dir):
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark, sf_dir):
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"), langid.pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op11_warc_archives(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


def op12_phrase_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"), longest=3, least=10, share=50, top=2000)


def op13_ranked_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": oracles.ngram_join(4, 85), "op3_substring_dedup": oracles.substring_dedup(35), "op4_source_mixing": mixing.oracle(), "op11_warc_archives": warc.oracle(), "op12_phrase_collocations": collocations.oracle(10, 50, 2000), "op13_ranked_search": lexical.oracle(10)}
