"""The operators with production parameters over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.llm import (
    alignment, byte_bpe, chat_format, collocations, embedding_dedup, fingerprint, packing, sharding, simhash,
    suffix_dedup, token_counts, token_output, toxicity,
)
from speechtab.llm.common import table
from speechtab.llm.sql import ORACLE_SQL  # noqa: F401
from speechtab.session import scratch_path

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, WORD_TOKENIZER, end_id=2)
    return token_output.read_digests(spark, path)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, end_id=2)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_MODEL)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    path = scratch_path(spark, "chats")
    chat_format.write_conversations(told.unionByName(more), path)
    return chat_format.read_digests(spark, path)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output, op2_packing, op3_fingerprint, op4_token_counts, op5_suffix_dedup,
        op6_toxicity, op7_simhash, op8_byte_bpe, op9_sharding, op10_embedding_dedup,
        op11_alignment, op12_chat_format, op13_collocations,
    )
}
