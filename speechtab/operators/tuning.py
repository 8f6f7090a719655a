"""N-best rescoring over a grid of weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.operators import metrics, text


def best_per_text(candidates: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row per distinct text of a clip and weight: several paths may spell the same text.

    ``alpha`` is the weight of a candidate, or an array of all weights that it was decoded under. An array is
    not spread out before the texts are grouped, so each path is one row until then.
    """
    several = candidates.schema["alpha"].dataType.typeName() == "array"
    keys = [key, "text"] if several else [key, "alpha", "text"]
    base = F.col("am_score") + F.col("alpha") * F.col("lm_score")
    if not several:
        best = F.max_by(F.struct("am_score", "lm_score", base.alias("base_score")), F.struct(base, "am_score"))
        rows = candidates.filter("text <> ''").groupBy(*keys).agg(best.alias("b"))
        return _counted(rows, key)
    paths = candidates.filter("text <> ''").groupBy(*keys).agg(
        F.collect_list(F.struct("alpha", "am_score", "lm_score")).alias("paths"))

    def best_of(alpha: Column) -> Column:
        under = F.filter("paths", lambda p: F.array_contains(p["alpha"], alpha))
        return F.array_max(F.transform(under, lambda p: F.struct(
            (p["am_score"] + alpha * p["lm_score"]).alias("base_score"), p["am_score"].alias("am_score"),
            p["lm_score"].alias("lm_score"),
        )))

    weights = F.array_distinct(F.flatten(F.transform("paths", lambda p: p["alpha"])))
    rows = paths.select(key, "text", F.explode(F.transform(
        weights, lambda a: F.struct(a.alias("alpha"), best_of(a).alias("b")))).alias("w"))
    return _counted(rows.select(key, "text", "w.alpha", "w.b"), key)


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(
        key, "alpha", "text", "b.am_score", "b.lm_score", "b.base_score",
        F.size(text.words_micro(F.col("text"))).alias("word_count"),
    )


def select_best(candidates: DataFrame, betas: Sequence[float], key: str = "sample_id"
                ) -> DataFrame:
    """Text with the top total score for every clip, alpha and beta.

    The beta grid is a literal generator on each row; partial maxima combine before the shuffle.
    Equal scores resolve to the smaller text.
    """
    grid = candidates.withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in betas])))
    total = F.col("am_score") + F.col("alpha") * F.col("lm_score") + (
        F.col("beta") * F.col("word_count")
    )
    return (
        grid.groupBy(key, "alpha", "beta")
        .agg(F.min(F.struct((-total).alias("s"), "text")).alias("b"))
        .select(key, "alpha", "beta", F.col("b.text").alias("prediction"))
    )


def grid_rates(
    candidates: DataFrame, references: DataFrame, alphas: Sequence[float],
    betas: Sequence[float], key: str = "sample_id",
) -> DataFrame:
    """Micro error rates per (alpha, beta); a clip without candidates predicts the empty text.

    Most weights agree on a text, so each distinct (clip, text) is measured once.
    """
    chosen = select_best(candidates, betas, key)
    grid = F.array(*[
        F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"))
        for a in alphas for b in betas
    ])
    by_text = chosen.groupBy(key, "prediction").agg(
        F.collect_set(F.struct("alpha", "beta")).alias("cells")
    )
    picked = by_text.groupBy(key).agg(
        F.collect_list(F.struct("prediction", "cells")).alias("texts"),
        F.flatten(F.collect_list("cells")).alias("filled"),
    )
    complete = references.join(picked, key, "left").select(
        key, "reference",
        F.concat(
            F.coalesce("texts", F.array().cast(picked.schema["texts"].dataType)),
            F.array(F.struct(
                F.lit("").alias("prediction"),
                F.array_except(grid, F.coalesce(
                    "filled", F.array().cast(picked.schema["filled"].dataType)
                )).alias("cells"),
            )),
        ).alias("texts"),
    )
    rows = complete.select(key, "reference", F.explode("texts").alias("t")).select(
        key, "reference", "t.prediction", "t.cells"
    ).filter(F.size("cells") > 0)
    measured = metrics.score_pairs(rows.select("cells", "prediction", "reference"))
    return (
        measured.withColumn("cell", F.explode("cells"))
        .groupBy(F.col("cell.alpha").alias("alpha"), F.col("cell.beta").alias("beta"))
        .agg(
            F.try_divide(F.sum("word_errors_micro"), F.sum("words_micro")).alias("wer"),
            F.try_divide(F.sum("char_errors"), F.sum("chars")).alias("cer"),
        )
    )


def rank_grid(rates: DataFrame, top: int = 10) -> DataFrame:
    """Best weights first, by word then character error rate (a top-k report)."""
    return rates.orderBy("wer", "cer", "alpha", "beta").limit(top)
