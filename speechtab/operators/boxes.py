"""Detection boxes: normalisation, medians, fallbacks, pixels, sampling positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab import constants as K
from speechtab import skew

COORDINATES = ("x1", "y1", "x2", "y2")


def box_from_extent(x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column) -> Column:
    """Struct box around an extent: at least the smallest size, margins, 2:1, inside the unit frame."""
    wide = F.greatest(x_hi - x_lo, F.lit(K.MIN_BOX_EXTENT[0])) * K.BOX_MARGIN[0]
    tall = F.greatest(y_hi - y_lo, F.lit(K.MIN_BOX_EXTENT[1])) * K.BOX_MARGIN[1]
    width = F.greatest(wide, tall * 2)

    def side(middle: Column, half: Column) -> tuple[Column, Column]:
        low, high = middle - half, middle + half
        shift = F.greatest(F.lit(0.0), -low) - F.greatest(F.lit(0.0), high - 1)
        return low + shift, high + shift

    x1, x2 = side((x_lo + x_hi) / 2, width / 2)
    y1, y2 = side((y_lo + y_hi) / 2, width / 4)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def frame_boxes(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """One box per frame from its detected points; frames without points have null coordinates."""
    extent = points.groupBy(*keys).agg(
        F.min(x).alias("__xl"), F.max(x).alias("__xh"), F.min(y).alias("__yl"),
        F.max(y).alias("__yh"), F.count(x).alias("points"),
    )
    box = F.when(
        F.col("points") > 0,
        box_from_extent(F.col("__xl"), F.col("__xh"), F.col("__yl"), F.col("__yh")),
    )
    return extent.withColumn("__box", box).select(
        *keys, "points", *[F.col(f"__box.{c}").alias(c) for c in COORDINATES]
    )


def clip_boxes(frames: DataFrame, clip: Sequence[str]) -> DataFrame:
    """Median box per clip and how many frames had a detection; all-null clips keep null."""
    counts = frames.groupBy(*clip).agg(
        F.count("x1").alias("valid_detections"), F.count("*").alias("sampled_frames")
    )
    found = frames.filter("x1 IS NOT NULL").select(*clip, *COORDINATES)
    return counts.join(skew.exact_median(found, clip, COORDINATES), list(clip), "left")


def fallback_boxes(clips: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Clip box, else the speaker's median, else the global median; ``source`` says which.

    ``source`` is null when no clip at all has a box, which callers treat as an error.
    """
    found = clips.filter("x1 IS NOT NULL").select(speaker, *COORDINATES)
    per_speaker = skew.exact_median(found, [speaker], COORDINATES).select(
        speaker, *[F.col(c).alias(f"s_{c}") for c in COORDINATES]
    )
    overall = skew.exact_median(found, [], COORDINATES)
    everywhere = overall.select(F.struct(*COORDINATES).alias("__g")).scalar()
    joined = clips.join(per_speaker, speaker, "left").withColumn("__g", everywhere)
    source = (
        F.when(F.col("x1").isNotNull(), "detected")
        .when(F.col("s_x1").isNotNull(), "speaker_median")
        .when(F.col("__g.x1").isNotNull(), "global_median")
    )
    return joined.select(
        *[c for c in clips.columns if c not in COORDINATES],
        *[F.coalesce(c, f"s_{c}", F.col(f"__g.{c}")).alias(c) for c in COORDINATES],
        source.alias("source"),
    )


def speaker_and_global_medians(clips: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Medians of the clip medians per speaker and overall; ``scope`` tells them apart."""
    found = clips.filter("x1 IS NOT NULL").select(speaker, *COORDINATES)
    overall = skew.exact_median(found, [], COORDINATES)
    return skew.exact_median(found, [speaker], COORDINATES).withColumn("scope", F.lit("speaker")).unionByName(
        overall.withColumn(speaker, F.lit(None).cast(clips.schema[speaker].dataType)).withColumn("scope", F.lit("overall"))
    )


def pixel_box(width: Column, height: Column) -> Column:
    """Pixel box of a relative one, truncated toward zero."""
    return F.struct(
        (F.col("x1") * width).cast("int").alias("px1"),
        (F.col("y1") * height).cast("int").alias("py1"),
        (F.col("x2") * width).cast("int").alias("px2"),
        (F.col("y2") * height).cast("int").alias("py2"),
    )


def detection_scale(width: Column, height: Column, max_side: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))


def sample_positions(frames: Column, samples: int = 5) -> Column:
    """Evenly spaced frame numbers in the middle band, rounded half to even."""
    offset, width = K.SAMPLE_BAND
    steps = [offset + width * i / max(samples - 1, 1) for i in range(samples)]
    return F.array(*[
        F.least(F.rint(frames * F.lit(s)).cast("long"), frames - 1) for s in steps
    ])


def spread_positions(frames: Column, count: int = 3) -> Column:
    """``count`` positions from the first to the last frame, truncated."""
    last = frames - 1
    inner = [(last / F.lit(max(count - 1, 1)) * F.lit(i)).cast("long") for i in range(count)]
    if count > 1:
        inner[-1] = last.cast("long")
    return F.array(*inner)


def sampled_frames(frames: DataFrame, clips: DataFrame, clip: str, positions: Column
                   ) -> DataFrame:
    """Frames at the sampled positions of their clip."""
    wanted = clips.select(clip, F.explode(F.array_distinct(positions)).alias("frame"))
    return frames.join(wanted, [clip, "frame"], "left_semi")
