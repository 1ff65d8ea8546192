"""A training-data pipeline over `documents`: each stage works on all that the one before it kept.

Languages are labelled and documents without one go; of each group of near duplicates one document stays; byte strings that
repeat are removed; secrets are masked; what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import language, ngram_join, packing, secrets, suffix_dedup
from corpusforge.llm.common import Stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length that the text has now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and texts without a letter go. The model is fitted on the documents' own lang.
    Repeated rows stay, a very long text is labelled in stretches, an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest id. Rows of one id are told apart by their texts; repeated rows become one.
    A very long text is shingled whole; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    found = ngram_join.join(docs)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first")).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    rest = [F.first(c).alias(c) for c in COLUMNS if c != "doc_id"]
    return kept.groupBy("doc_id", F.md5("text").alias("of")).agg(*rest).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that repeat across or within documents; its text may become empty.

    A passage is a string of suffix_dedup.PASSAGE bytes, which fifty words of prose fill, however short they are: shorter than
    what the operator's own query removes. What a 400-byte string must repeat to go there goes here too."""
    return _documents(suffix_dedup.dedup(docs.select(*COLUMNS), suffix_dedup.PASSAGE, out="text", keep=("lang", "source")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in place of each secret; a null text stays null, repeated rows stay. The network is fitted on the
    documents' own findings. A very long text is searched whole; an empty table stays empty."""
    return _documents(secrets.redact_column(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. Repeated rows are packed each, a null text is its end alone, a very long text is cut over
    as many sequences as it fills, and an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests/llm holds their operators against brute-force versions, and the repeats stage itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Stored(stage(spark, docs, sf_dir), name).read()
    return STAGES[-1][1](spark, docs, sf_dir)
