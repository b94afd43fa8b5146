"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import conversations, embeddings, mixing, phrases, quality
from panelweave.llm.conversations import repair_conversations
from panelweave.llm.lines import dedup_lines
from panelweave.llm.sharding import shard_by_bytes
from panelweave.llm.simhash import near_duplicates
from panelweave.llm.substrings import remove_repeats
from panelweave.llm.templates import decontaminate
from panelweave.llm.token_counts import token_counts
from panelweave.llm.token_output import token_round_trip
from panelweave.llm.warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_warc_splittable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op4_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_suffix_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 100)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), radius=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc.doc_id", "doc.source", "copy", "order_key")


def op11_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_token_output, op3_warc_splittable, op4_differencing_shards, op5_suffix_ranks, op6_token_counts, op7_template_decontamination, op8_simhash, op9_quality_rules, op10_poisson_mixing,
                               op11_itq_embeddings, op12_phrase_collocations, op13_conversation_repair)
}
SQL: dict[str, str] = {"op9_quality_rules": quality.SQL, "op10_poisson_mixing": mixing.SQL, "op11_itq_embeddings": embeddings.SQL, "op12_phrase_collocations": phrases.SQL, "op13_conversation_repair": conversations.SQL}
