"""The corpus pipeline: quality rules, classifier, near-duplicates, mixing, tokens.

Each stage reads what its predecessor kept, from Parquet, and all but the last give the columns of
``documents``. Models and statistics of labels come from the tables in ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apronflow.llm import bpe, classifier, mixing, rules, simhash
from apronflow.sources.scratch import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the likelihood ratio reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.quality_rules(docs, labels).filter("kept").select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted bad go. The network learns from the whole table's labelled documents:
    of those that the rules kept, hardly any are bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = classifier.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return classifier.classify(docs, net).filter("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn at its source's rate, in a global shuffle."""
    return mixing.poisson_mix(docs).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of ids and of the decoded bytes, and the ids."""
    path = public_tokenizers.path(VOCABULARY)
    decoded = bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return decoded.select("doc_id", *bpe.digests(decoded), F.col("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("bpe_encoding", encode_tokens),
]

# hashes and a trained network are beyond SQL; tests hold the pipeline against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
