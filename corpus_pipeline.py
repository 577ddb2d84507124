"""Corpus pipeline: quality filter, near-duplicate removal, secret redaction, source mixture, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kelvingrid.llm import bpe, mixing, ngram_join, quality, secrets
from kelvingrid.llm.common import table
from kelvingrid.llm.queries import domain
from kelvingrid.session import scratch_path, small_batches

#: The last filter takes nine tenths of the words that are left, no document twice.
RECIPE = mixing.Recipe(domain={"forum": 1.0, "web": 2.0, "print": 3.0}, lang={"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, share=0.9, max_epochs=1, seed=17)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    return quality.keep_good(docs, table(small_batches(spark), sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near duplicates."""
    small_batches(spark)
    del sf_dir
    return ngram_join.keep_representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret in their text replaced."""
    del spark, sf_dir
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a mixture with the recipe's weights."""
    del spark, sf_dir
    return mixing.take_mixture(docs, domain(), RECIPE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as digests."""
    small_batches(spark)
    del sf_dir
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, corpus_bytes=4 << 20, memo=0)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier is fitted on the fly, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
