"""Checks of annotations, manifests and measured values. Violations are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab import skew
from speechtab.operators import ctc, text


def speaker_from_id(sample_id: Column) -> Column:
    return F.split_part(sample_id, F.lit("_"), F.lit(1))


def speaker_mismatches(
    df: DataFrame, sample_id: str = "sample_id", path_speaker: str = "path_speaker"
) -> DataFrame:
    """Samples whose id names another speaker than their folder."""
    named = df.withColumn("speaker_id", speaker_from_id(F.col(sample_id)))
    return named.filter(~F.col("speaker_id").eqNullSafe(F.col(path_speaker)))


def interval_checks(
    lines: DataFrame,
    key: str,
    order: Sequence[str],
    chunk: Column,
    *,
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Speech lines with the previous speech end and a ``violation`` label (null when fine).

    Give speech lines only: silence neither gets checked nor moves the previous end.
    """
    seen = skew.running(
        lines, [key], order, chunk, {"previous_end": ("last", F.col(end))}, exclusive=True
    ).withColumn("previous_end", F.coalesce("previous_end", F.lit(-1).cast("long")))
    return seen.withColumn(
        "violation",
        F.when(F.col(start) < 0, "negative_start")
        .when(F.col(end) <= F.col(start), "empty_interval")
        .when(F.col(start) < F.col("previous_end"), "overlap"),
    )


def first_violations(checked: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First violating line per file."""
    place = F.struct(*order)
    return (
        checked.filter(F.col("violation").isNotNull())
        .groupBy(key)
        .agg(
            F.min(place).alias("__at"),
            F.min_by("violation", place).alias("violation"),
            F.count("*").alias("violations"),
        )
        .select(key, *[F.col(f"__at.{o}").alias(o) for o in order], "violation", "violations")
    )


def feasibility(
    df: DataFrame, transcript: str = "transcript", steps: str = "num_frames"
) -> DataFrame:
    """Flag rows whose transcript needs more decoding steps than the clip offers."""
    return df.withColumn("required_steps", ctc.minimum_steps(F.col(transcript))).withColumn(
        "feasible", F.col("required_steps") <= F.col(steps)
    )


def feasibility_report(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Valid and invalid counts; ``usable`` is false where no valid row remains."""
    return (
        flagged.groupBy(*by)
        .agg(
            F.count_if("feasible").alias("valid"),
            F.count_if(~F.col("feasible")).alias("invalid"),
        )
        .withColumn("usable", F.col("valid") > 0)
    )


def media_measures(df: DataFrame) -> DataFrame:
    """Duration and rate rounded half to even at 6 places, target length, required steps."""
    return df.withColumns({
        "duration_s": F.rint(F.try_divide(F.col("num_frames"), F.col("fps")) * 1e6) / 1e6,
        "fps": F.rint(F.col("fps") * 1e6) / 1e6,
        "target_length": F.length("transcript"),
        "min_ctc_frames": ctc.minimum_steps(F.col("transcript")),
        "media_valid": (F.col("num_frames") > 0)
        & (F.col("fps") > 0)
        & (F.col("width") > 0)
        & (F.col("height") > 0),
    })


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def transcript_checks(df: DataFrame, transcript: str, alphabet: str) -> DataFrame:
    """Label empty transcripts and characters outside the alphabet."""
    unknown = text.unknown_characters(F.col(transcript), alphabet)
    return df.withColumn("unknown", unknown).withColumn(
        "problem",
        F.when(F.length(transcript) == 0, "empty_transcript").when(
            F.size("unknown") > 0, "unknown_characters"
        ),
    )


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: rows checked and rows that break it. All rules in one pass."""
    sums = df.agg(
        F.count("*").alias("checked"),
        *[
            F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}")
            for i, rule in enumerate(rules.values())
        ],
    )
    return sums.select(
        "checked",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
            for i, name in enumerate(rules)
        ])).alias("r"),
    ).select("r.rule", "checked", "r.violations", (F.col("r.violations") == 0).alias("passed"))


def allow_list(
    df: DataFrame, speakers: Sequence[str] | None = None, limit: int | None = None,
    order: str = "sample_id",
) -> DataFrame:
    """Restrict to listed speakers and, as a feature, to the first ``limit`` samples."""
    if speakers:
        df = df.filter(F.col("speaker_id").isin(*speakers))
    return df if limit is None else df.orderBy(order).limit(limit)
