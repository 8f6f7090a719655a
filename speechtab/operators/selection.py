"""Review samples, shortest clips, sorted reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_clips(results: DataFrame, speaker: str = "speaker_id", key: str = "sample_id"
                 ) -> DataFrame:
    """First and worst clip (most dropped frames, then highest id) of every speaker, no repeats.

    Both are aggregates that combine before the shuffle, so a dominant speaker costs nothing extra.
    """
    row = F.struct(*results.columns)
    picks = results.groupBy(speaker).agg(
        F.min_by(row, F.col(key)).alias("first"),
        F.max_by(row, F.struct("dropped_frames", key)).alias("worst"),
    )
    chosen = F.when(
        F.col(f"first.{key}") == F.col(f"worst.{key}"),
        F.array(F.struct(F.lit("first").alias("role"), F.col("first").alias("r"))),
    ).otherwise(F.array(
        F.struct(F.lit("first").alias("role"), F.col("first").alias("r")),
        F.struct(F.lit("worst").alias("role"), F.col("worst").alias("r")),
    ))
    return picks.select(F.explode(chosen).alias("c")).select("c.role", "c.r.*")


def quality_sample(manifest: DataFrame, count: int = 30, speaker: str = "speaker_id",
                   key: str = "sample_id") -> DataFrame:
    """First clip of every speaker, then the longest others until max(count, speakers) rows."""
    row = F.struct(*manifest.columns)
    firsts = manifest.groupBy(speaker).agg(F.min_by(row, F.col(key)).alias("r")).select("r.*")
    speakers = firsts.agg(F.count("*")).scalar()
    # At most `count` longest clips can be used, so the sort is a bounded top-k.
    longest = (
        manifest.join(firsts.select(key), key, "left_anti")
        .orderBy(F.col("num_frames").desc(), key)
        .limit(count)
    )
    ranked = longest.agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("num_frames")).alias("__o"), F.col(key).alias("__k"),
            F.struct(*manifest.columns).alias("r"),
        ))).alias("l")
    )
    room = F.greatest(F.lit(count) - speakers, F.lit(0)).cast("int")
    rest = ranked.select(F.explode(F.slice("l", F.lit(1), room)).alias("x")).select("x.r.*")
    return firsts.withColumn("role", F.lit("first")).unionByName(
        rest.select(*manifest.columns).withColumn("role", F.lit("longest"))
    )


def shortest_feasible(flagged: DataFrame, k: int, steps: str = "num_frames",
                      key: str = "sample_id") -> DataFrame:
    return flagged.filter("feasible").orderBy(steps, key).limit(k)


def examples(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first rows of a report."""
    return df.orderBy(order).limit(n)


def numeric_order(df: DataFrame, stem: str) -> DataFrame:
    """Sort numerically named items by number; a name that is no number sorts first, flagged."""
    return df.withColumn("number", F.expr(f"try_cast({stem} AS BIGINT)")).orderBy("number", stem)
