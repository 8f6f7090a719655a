"""The next row in the order of a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which the ids are cut by their quantiles, and rows of a part of such a range.
RANGES = 256
PART_ROWS = 2048


#: Columns by which rows are parted; grouping by them and more needs no further shuffle.
PART = ("range", "piece")


def with_next(docs: DataFrame, order: str, value: str, rows: int | None = None, parts: bool = False) -> DataFrame:
    """Add ``next_`` + value: the value of the next row in ascending ``order``; after the last, the first's.

    Rows are parted by ranges of ``order``; windows run inside a part, and the first row of each part is
    handed to the part before. Equal ``order`` is told apart by the value; rows without one come first, parted by
    their hash, which then is their order. ``parts`` keeps the columns of ``PART``.
    """
    low, high, cuts, counted = docs.agg(
        F.min(order), F.max(order),
        F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 100 * RANGES), F.count("*"),
    ).first()
    cuts = sorted(set(cuts or []))
    rows = counted if rows is None else rows
    pieces = max(1, rows // ((len(cuts) + 1) * PART_ROWS))
    nameless = F.pmod(F.xxhash64(value), F.lit(max(1, rows // PART_ROWS))).cast("int")
    parted = docs.withColumn(
        "range", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(_range_of(F.col(order), cuts))
    ).withColumn(
        "piece", F.when(F.col(order).isNull(), nameless).otherwise(
            _piece_of(F.col(order), F.col("range"), [low, *cuts, high], pieces)
        )
    )
    part = list(PART)
    position = F.struct(order, value)
    inside = Window.partitionBy(*part).orderBy(order, value)
    led = parted.withColumn("following", F.lead(F.struct(F.col(value).alias("v"))).over(inside))
    firsts = parted.groupBy(*part).agg(F.min_by(F.struct(F.col(value).alias("v")), position).alias("first"))
    # Within a range its parts, then the ranges: both tables are small.
    by_part = firsts.withColumn("after", F.lead("first").over(Window.partitionBy("range").orderBy("piece")))
    heads = firsts.groupBy("range").agg(F.min_by("first", "piece").alias("head"))
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_range = heads.select(
        "range",
        F.coalesce(F.lead("head").over(Window.orderBy("range")), F.first("head").over(everything)).alias("after_range"),
    )
    handed = by_part.join(by_range, "range").select(*part, F.coalesce("after", "after_range").alias("handed"))
    return led.join(handed, part).select(
        *docs.columns, F.coalesce(F.col("following.v"), F.col("handed.v")).alias(f"next_{value}"),
        *(part if parts else []),
    )


def _range_of(key: Column, cuts: list) -> Column:
    """How many cuts are at or below the key, as a search among literals."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(key < cuts[middle], _range_of(key, cuts[:middle])).when(
        key >= cuts[middle], F.lit(middle + 1) + _range_of(key, cuts[middle + 1:])
    ).otherwise(F.lit(0))


def _piece_of(key: Column, range_: Column, edges: list, pieces: int) -> Column:
    """Even parts of a range by the key's value; range i lies between edges i and i + 1."""
    if pieces == 1 or edges[0] is None:
        return F.lit(0)
    bounds = F.array(*[F.lit(e) for e in edges])
    low, high = F.get(bounds, range_), F.get(bounds, range_ + 1)
    # A range of one value has no width; the last key of the last range would be one part further.
    share = F.try_divide((key - low).cast("double"), (high - low).cast("double"))
    return F.coalesce(F.least(F.floor(share * pieces).cast("int"), F.lit(pieces - 1)), F.lit(0))
