"""A corpus from raw documents to packed sequences: five operators in a row, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm import language_id, mixing, near_dedup, packing, quality, queries
from reelmark.llm.common import given_back, shared_folder, table

#: The mix takes this part of the tokens that reach it, each document at most once.
MIX_SHARE = 0.8


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches the classifier's cut."""
    kept = quality.classify(docs, table(spark, sf_dir, "labels")).filter("quality_kept").select(*docs.columns)
    given_back()
    return kept


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit one of the languages; `lang` becomes the predicted one, by which the mix then weighs them."""
    kept = language_id.identify(docs).filter("lang_accepted").withColumn("lang", F.col("lang_pred")).select(*docs.columns)
    given_back()
    return kept


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by five-word shingles, the one of the smallest doc_id."""
    return near_dedup.keep_one(docs, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A part of the documents in the target weights of domain, language and source."""
    return mixing.mix(docs, queries.mix_domain(), queries.mix_weights(), MIX_SHARE, 1, queries.MIX_SEED).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", rate),
    ("language ID", identify),
    ("near-duplicates", deduplicate),
    ("source mixing", mix),
    ("packing", pack),
]

#: The classifier, the language models and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
