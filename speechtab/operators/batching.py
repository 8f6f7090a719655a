"""Blocks, shuffled batches and padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtab import skew
from speechtab.session import random_key


def assign_blocks(df: DataFrame, order: str, size: int) -> DataFrame:
    """Block number and position (from 1) of each row in the order of ids of any type."""
    numbered = skew.number_by_range(df, [order])
    return numbered.withColumn("block_id", F.floor((F.col("position") - 1) / size))


def block_summary(blocks: DataFrame, failed: Column | None = None) -> DataFrame:
    bad = F.lit(False) if failed is None else failed
    return blocks.groupBy("block_id").agg(
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
        F.count_if(~bad).alias("results"),
        F.count_if(bad).alias("failures"),
    )


def epoch_batches(
    df: DataFrame, key: str, epochs: Sequence[int], *, seed: int = 42, size: int = 2,
    within: Sequence[str] = (), digits: int = 4, shuffled: bool = True,
) -> DataFrame:
    """(epoch, batch_id) per row, the last partial batch kept.

    ``shuffled`` draws a repeatable order for each epoch, else every epoch has the order of the keys.
    ``digits`` sets how many hash buckets (16^digits) of a shuffle are sorted independently.
    """
    every = F.explode(F.array(*[F.lit(e) for e in epochs]))
    if shuffled:
        keyed = df.withColumn("epoch", every).withColumn(
            "__k", random_key(F.col("epoch") + seed, F.col(key), seed="epoch")
        )
        numbered = skew.number_rows(
            keyed, [F.col("__k"), F.col(key)], skew.hash_bucket(F.col("__k"), digits), "position",
            within=[*within, "epoch"],
        ).drop("__k")
    else:
        numbered = skew.number_by_range(df, [key], within=within).withColumn("epoch", every)
    return numbered.withColumn("batch_id", F.floor((F.col("position") - 1) / size))


def batch_lengths(batches: DataFrame, by: Sequence[str], length: Column) -> DataFrame:
    return batches.groupBy(*by).agg(F.max(length).alias("max_length"))


def pad_to_batch(batches: DataFrame, by: Sequence[str], sequence: str, fill: int = 0) -> DataFrame:
    """Zero-pad each sequence to the longest of its batch and keep the true length.

    A batch holds a fixed small number of rows, which bounds the window.
    """
    size = F.size(sequence)
    longest = F.max(size).over(Window.partitionBy(*by))
    return batches.withColumns({"true_length": size, "padded_length": longest}).withColumn(
        "padded",
        F.concat(sequence, F.array_repeat(F.lit(fill), F.col("padded_length") - F.col("true_length"))),
    )


def pad_to_length(df: DataFrame, sequence: str, length: int, fill: int = 0) -> DataFrame:
    """Pad to a fixed length; longer sequences are flagged ``too_long`` and left null."""
    size = F.size(sequence)
    return df.withColumn("too_long", size > length).withColumn(
        "padded",
        F.when(size <= length, F.concat(
            sequence, F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - size, F.lit(0)))
        )),
    )
