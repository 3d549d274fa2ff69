"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from cadastra.llm import bpe, langid, mixing, ngram_join, pii
from cadastra.llm.tables import shared_dir, table

#: A document whose language is less likely than this is rejected, as is one without letters.
LEAST_SCORE = 0.5


def language(spark, docs, sf_dir):
    """Language ID: documents without an identified language go."""
    names = langid.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    langs, model = langid.fit(docs.filter(~langid.held_out()), names)
    found = langid.predict(docs, names, langs, model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")


def near_duplicates(spark, docs, sf_dir):
    """N-gram Jaccard join on five words at 0.8: the smallest doc_id of each group stays."""
    return ngram_join.keep_first(docs, k=5, percent=80)


def surrogates(spark, docs, sf_dir):
    """PII: entities give way to surrogates; n_chars follows the text."""
    return pii.replace(docs).drop("n_entities", "entities").withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixture(spark, docs, sf_dir):
    """Mixing: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def tokens(spark, docs, sf_dir):
    """Byte-level BPE: the documents with the ids of their tokens, which decode to their texts."""
    vocabulary = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)
    decoded = coded.withColumn("text", F.decode("decoded", "UTF-8")).drop("decoded")
    return decoded.withColumn("n_tokens", F.size("ids").cast("long")).select(*docs.columns, "n_tokens", "ids")


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("pii", surrogates), ("mixing", mixture), ("byte_bpe", tokens)]
#: SQL cannot state language scores, keyed surrogates or subword ids; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
