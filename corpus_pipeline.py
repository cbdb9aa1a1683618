"""From raw documents to packed sequences: five stages, each on all that its predecessor kept.

Each stage takes the session, the documents and the folder of the tables. All but the last
give rows of documents with all their columns; `run` writes what a stage gives and reads
it back for the next one. Stages handle nulls, empty and long texts, repeated rows, empty
tables and other columns as the operators they call say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from partforge.llm import curve_packing, exact_dedup, language_mixture, ngram_join, rule_forest
from partforge.llm.staging import staged


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go; those in several identified languages stay."""
    return language_mixture.with_language(docs, language_mixture.learn_from(docs))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the limits or are anomalous go."""
    return rule_forest.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five words, similarity 0.8) the one with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return curve_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0, with_ids=False)


STAGES = [
    ("language", in_a_language),
    ("quality", of_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: SQL can express neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
