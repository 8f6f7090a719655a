"""From raw documents to packed training sequences: the stages of the training-data pipeline.

Each stage takes what its predecessor kept and returns the columns of ``documents``, but for the last,
which returns the packed pieces. Nulls, empty and repeated rows are kept as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechtab.llm import packing, simhash, suffix_dedup, toxicity
from speechtab.llm.common import cut, table
from speechtab.llm.queries import BYTE_TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays, once; rows without an id stay.

    Near copies are those of ``op7``, within 3 bits over three words; the README has what that misses.
    """
    first = simhash.link_documents(docs).filter("doc_id = component_id").select("doc_id").distinct()
    # Of rows that repeat as well; rows of one id with different texts may belong to different groups.
    same = Window.partitionBy("doc_id", "text").orderBy("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__place", F.row_number().over(same))
    return kept.filter("__place = 1").drop("__place").unionByName(docs.filter("doc_id IS NULL"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has as well go; texts that lose nothing stay as they are."""
    return suffix_dedup.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences."""
    return packing.pack_documents(docs, BYTE_TOKENIZER, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: scores, hashes and tokenizers have no counterpart in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
