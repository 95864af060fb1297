"""A corpus in five stages, each a function of (spark, docs, sf_dir) over what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, lang_id, mixing, ngram_join, secrets
from plumbline.llm.common import cut, read
from plumbline.llm.queries import vocabulary_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told."""
    return lang_id.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return ngram_join.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret that is found by its kind."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their targets."""
    return mixing.emit(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    return bpe.code_round_trip(docs, vocabulary_path())


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each),
    ("secret_scans", without_secrets),
    ("source_mixing", mixed),
    ("bpe_encoding_decoding", encoded),
]

#: SQL can express neither the language models nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the results between them are written to the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
