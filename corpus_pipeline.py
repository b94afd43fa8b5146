"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, token files.

Every stage works on all its predecessor kept; stages before the last return the columns of
``documents``. Decisions: a document that fails a quality rule goes; of near-duplicates the one with the
smallest id stays; a document that holds a benchmark item goes; sources are repeated or thinned to their
target weights; the rest is written as token files, and read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelweave.llm.common import Stages
from panelweave.llm.mixing import mix_sources
from panelweave.llm.quality import keep_documents
from panelweave.llm.simhash import keep_first_similar
from panelweave.llm.templates import keep_clean
from panelweave.llm.token_output import token_round_trip


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_similar(docs)  # 5-word shingles, similarity 0.8: radius 2 is the contract of op8's query


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select("doc.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), words=100_000)  # workers of all stages share an executor's memory


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token output", token_files),
]
ORACLE_SQL = None  # fingerprints, components and tokens are beyond SQL; tests hold it against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again by the next."""
    stages = Stages(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stages.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
