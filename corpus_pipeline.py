"""From documents to token ids: language, exact copies, near copies, benchmark passages, encoding.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and
returns what it keeps, with the columns of documents in all but the last.
Each result is written to the shared folder and read again as the next docs.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, encoding, exact, language, minhash
from quillon.session import small_batches
from quillon.storage import scratch, shared_dir, written

VOCABULARY = "word_bpe_49k.json"


def _stage(f):
    """A stage in sessions of any batch size."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return f(small_batches(spark), docs, sf_dir)

    return run


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn profiles from all rows with a language; null texts and texts without a letter go.

    All stages but the last keep rows with null ids, extra columns and repeated
    rows as they are unless they say otherwise; an empty table gives an empty one.
    """
    return language.keep_known(docs, language.learn(docs))


@_stage
def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z and a-z the one with the largest id stays; null ids rank lowest, of repeated rows one stays."""
    return exact.drop_exact_duplicates(docs)


@_stage
def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 0.8 of their shingles of five words the one with the smallest id stays; null texts, and null ids linked with no other, stay."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


@_stage
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts a twentieth of whose words or more are in passages of 13 words of the benchmark go; null texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=5, window=13)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them, for every row; null texts have no tokens."""
    return encoding.encoding_digests(docs, public_tokenizers.path(VOCABULARY)).withColumnRenamed("__id", "doc_id")


STAGES = [("language", known_language), ("exact", one_of_equal), ("near", one_of_near), ("benchmark", no_benchmark), ("encode", encode)]

#: SQL can't express the language profiles and the encoding; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_dir(spark)
    for name, stage in STAGES:
        with scratch(spark):  # what a stage has written on its way goes
            docs = written(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
