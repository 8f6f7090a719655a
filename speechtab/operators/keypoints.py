"""Landmark tables: template, extents, similarity fit, gap filling, renumbering, pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab import constants as K
from speechtab import skew
from speechtab.session import random_key


def _scaled(values: Sequence[float], size: int, padding: float) -> Column:
    return F.array(*[F.lit((v + padding) / (2 * padding + 1) * size) for v in values])


def match_template(points: DataFrame, size: int = K.TEMPLATE_SIZE,
                   padding: float = K.TEMPLATE_PADDING) -> DataFrame:
    """Points next to their template position; the template is a literal, so nothing is joined."""
    return points.filter(F.col("point") < len(K.TEMPLATE_X)).withColumns({
        "u": F.get(_scaled(K.TEMPLATE_X, size, padding), F.col("point")),
        "v": F.get(_scaled(K.TEMPLATE_Y, size, padding), F.col("point")),
    })


def extents(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        *[f(c).alias(f"{c}_{n}") for c in ("x", "y")
          for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        F.count("x").alias("points"),
    )


def crop_windows(points: DataFrame, keys: Sequence[str], *, first_point: int,
                 size: int = K.TEMPLATE_SIZE, crop: tuple[int, int] = K.MOUTH_CROP) -> DataFrame:
    """Crop around the truncated mean of the points from ``first_point`` on; flag windows outside."""
    centre = points.filter(F.col("point") >= first_point).groupBy(*keys).agg(
        F.avg("x").cast("int").alias("cx"), F.avg("y").cast("int").alias("cy")
    )
    half_w, half_h = crop[0] // 2, crop[1] // 2
    return centre.select(
        *keys, "cx", "cy",
        (F.col("cx") - half_w).alias("left"), (F.col("cx") + half_w).alias("right"),
        (F.col("cy") - half_h).alias("top"), (F.col("cy") + half_h).alias("bottom"),
    ).withColumn("inside", F.expr(
        f"left >= 0 AND top >= 0 AND right <= {size} AND bottom <= {size}"
    ))


def fit_similarity(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares similarity per group of matched points (x, y) -> (u, v).

    Only sums are aggregated, so huge groups combine map-side. The rotation is the orthogonal polar
    factor of the 2x2 cross-covariance, reflections allowed. A group without spread has a null
    matrix.
    """
    shifted = matched.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in "xyuv"],
        *[F.var_pop(c).alias(f"s_{c}") for c in "xyuv"],
        *[F.covar_pop(p, q).alias(f"c_{p}{q}") for p in "xy" for q in "uv"],
    )
    a, b, c, d = (F.col(k) for k in ("c_xu", "c_xv", "c_yu", "c_yv"))
    source = (F.col("s_x") + F.col("s_y")) / 2
    target = (F.col("s_u") + F.col("s_v")) / 2
    turn = (a * d - b * c) > 0
    p = F.when(turn, a + d).otherwise(a - d)
    q = F.when(turn, c - b).otherwise(b + c)
    norm = F.sqrt(p * p + q * q)
    unit = F.when(
        (source > 0) & (target > 0) & (norm > 0), F.sqrt(target / source) / norm
    )
    m = shifted.withColumns({
        "m00": unit * p,
        "m01": unit * q,
        "m10": F.when(turn, -unit * q).otherwise(unit * q),
        "m11": F.when(turn, unit * p).otherwise(-unit * p),
    })
    return m.select(
        *keys, F.col("n").cast("long").alias("points"), "m00", "m01", "m10", "m11",
        (F.col("m_u") - F.col("m00") * F.col("m_x") - F.col("m01") * F.col("m_y")).alias("tx"),
        (F.col("m_v") - F.col("m10") * F.col("m_x") - F.col("m11") * F.col("m_y")).alias("ty"),
    )


def apply_similarity(points: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points moved by the matrix of their group."""
    moved = points.join(fitted, list(keys))
    return moved.select(
        *points.columns,
        (F.col("m00") * F.col("x") + F.col("m01") * F.col("y") + F.col("tx")).alias("moved_x"),
        (F.col("m10") * F.col("x") + F.col("m11") * F.col("y") + F.col("ty")).alias("moved_y"),
    )


def fill_gaps(
    frames: DataFrame, keys: Sequence[str], frame: str, values: Sequence[str], *,
    chunk_size: int = 65_536,
) -> DataFrame:
    """Linear interpolation over the frame number; ends take the nearest value.

    Values stay null where a clip has none. Long clips are worked on in chunks.
    """
    chunk = F.floor(F.col(frame) / chunk_size)

    def known(v: str) -> Column:
        return F.when(F.col(v).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(v).alias("v")))

    back = skew.running(
        frames, keys, [frame], chunk, {f"__b_{v}": ("last", known(v)) for v in values}
    )
    both = skew.running(
        back, keys, [frame], chunk, {f"__n_{v}": ("last", known(v)) for v in values}, reverse=True
    )

    def filled(v: str) -> Column:
        b, n = F.col(f"__b_{v}"), F.col(f"__n_{v}")
        share = (F.col(frame) - b["f"]) / (n["f"] - b["f"])
        return (
            F.when(F.col(v).isNotNull(), F.col(v))
            .when(b.isNull(), n["v"])
            .when(n.isNull(), b["v"])
            .otherwise(b["v"] + share * (n["v"] - b["v"]))
        )

    return both.select(
        *frames.columns, *[filled(v).alias(f"{v}_filled") for v in values]
    )


def renumber(
    frames: DataFrame, keys: Sequence[str], frame: str, detected: Column, *,
    chunk_size: int = 65_536, name: str = "frame_no",
) -> DataFrame:
    """Keep detected frames and number them from 1 in their old order; six-digit file stem."""
    kept = frames.filter(detected)
    numbered = skew.running(
        kept, keys, [frame], F.floor(F.col(frame) / chunk_size), {name: ("sum", F.lit(1))}
    )
    # Longer numbers keep all their digits.
    digits = F.col(name).cast("string")
    return numbered.withColumn(
        "stem", F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))
    )


def frame_summary(frames: DataFrame, keys: Sequence[str], detected: Column) -> DataFrame:
    """Decoded, landmark and dropped frames."""
    return frames.groupBy(*keys).agg(
        F.count("*").alias("decoded_frames"), F.count_if(detected).alias("landmark_frames")
    ).withColumn("dropped_frames", F.col("decoded_frames") - F.col("landmark_frames"))


def scale_pixels(pixels: Column) -> Column:
    return F.transform(pixels, lambda x: x.cast("double") / 255)


def mirror_coin(clip: Column, seed: int, p: float = 0.5) -> Column:
    """True when the clip gets mirrored; one repeatable draw per clip, mirrored above ``p``."""
    draw = F.conv(F.substring(random_key(clip, seed=seed), 1, 8), 16, 10).cast("double")
    return draw / F.lit(float(2**32)) > p


def mirror_rows(pixels: Column, width: int) -> Column:
    """Reverse every row of a flat picture."""
    rows = F.sequence(F.lit(0), F.floor(F.size(pixels) / width) - 1)
    return F.flatten(F.transform(
        rows, lambda r: F.reverse(F.slice(pixels, (r * width + 1).cast("int"), F.lit(width)))
    ))


