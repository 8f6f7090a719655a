"""Run histories: improvement, early stopping, best epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtab import skew

_METRICS = T.StructType([
    T.StructField(n, T.DoubleType()) for n in ("loss", "wer", "cer", "sentence_exact_match")
])
HISTORY_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("stage", T.StringType()),
    T.StructField("train", _METRICS),
    T.StructField("validation", _METRICS),
    T.StructField("learning_rates", T.MapType(T.StringType(), T.DoubleType())),
])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Histories in JSON: a line for each epoch of a stage, its metrics nested, learning rates by group."""
    return spark.read.schema(HISTORY_SCHEMA).json(path)


def stitch_stages(history: DataFrame, first: str, second: str) -> DataFrame:
    """One run of epochs: those of the second stage, counted from 0, follow the last of the first stage."""
    ends = history.groupBy("run_id").agg(F.max(F.when(F.col("stage") == first, F.col("epoch"))).alias("__end"))
    shift = F.when(F.col("stage") == second, F.coalesce(F.col("__end") + 1, F.lit(0))).otherwise(0)
    return history.filter(F.col("stage").isin(first, second)).join(ends, "run_id").withColumn(
        "epoch", F.col("epoch") + shift
    ).drop("__end")


def track(
    history: DataFrame, *, patience: int, warmup: int = 0, run: str = "run_id",
    epoch: str = "epoch", wer: str = "wer", chunk_size: int = 4096,
) -> DataFrame:
    """Per epoch: improved, best so far, epochs without improvement, and whether training stops.

    An epoch improves on a strictly lower finite error rate. During warm-up the count stays 0.
    Epochs may begin at any number and have gaps.
    """
    chunk = F.floor(F.col(epoch) / chunk_size)
    value = F.when(F.isnan(wer) | (F.col(wer) == float("inf")), None).otherwise(F.col(wer))
    prior = skew.running(
        history.withColumn("__w", value), [run], [epoch], chunk,
        {
            "best_before": ("min", F.col("__w")), "__before": ("sum", F.lit(1)),
        }, exclusive=True,
    ).withColumn(
        "improved",
        F.col("__w").isNotNull()
        & (F.col("best_before").isNull() | (F.col("__w") < F.col("best_before"))),
    )
    tracked = skew.running(
        prior, [run], [epoch], chunk,
        {
            "best_epoch": ("max", F.when(F.col("improved"), F.col(epoch))),
            "__best": ("max", F.when(F.col("improved"), F.col("__before") + 1)),
            "__warm": ("sum", F.when(F.col(epoch) < warmup, 1).otherwise(0)),
        },
    )
    # Rows since the last improvement or the warm-up, however the epochs are numbered.
    waited = F.col("__before") + 1 - F.greatest(F.coalesce("__best", F.lit(0)), F.col("__warm"))
    counted = tracked.withColumns({
        "best_so_far": F.least("best_before", "__w"),
        "without_improvement": waited.cast("bigint") if history.schema[epoch].dataType.simpleString() == "bigint" else waited.cast("int"),
    }).drop("__before", "__best", "__warm")
    return counted.withColumn(
        "stops",
        (F.col(epoch) >= warmup) & (F.col("without_improvement") >= patience),
    ).drop("__w", "best_before")


def until_stop(tracked: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """Epochs that really ran: up to and including the first stop."""
    stop = tracked.groupBy(run).agg(
        F.min(F.when(F.col("stops"), F.col(epoch))).alias("__stop")
    )
    return tracked.join(stop, run).filter(
        F.col("__stop").isNull() | (F.col(epoch) <= F.col("__stop"))
    ).drop("__stop")


def best_epochs(history: DataFrame, baseline: float, run: str = "run_id", epoch: str = "epoch",
                wer: str = "wer") -> DataFrame:
    """Epoch with the lowest error rate (the first on ties) and the gain over a baseline."""
    best = history.filter(F.col(wer).isNotNull()).groupBy(run).agg(
        F.min(F.struct(wer, epoch)).alias("b")
    )
    return best.select(
        run, F.col(f"b.{epoch}").alias("best_epoch"), F.col(f"b.{wer}").alias("best_wer"),
        (baseline - F.col(f"b.{wer}")).alias("absolute_gain"),
        ((baseline - F.col(f"b.{wer}")) / baseline).alias("relative_gain"),
    )
