"""Ordered and order-statistic operators that hold when one key owns a large share of the rows.

* ``running`` evaluates prefix aggregates over (key, chunk) windows and carries one summary row per
  chunk forward, so no task ever sorts a whole hot key.
* ``number_rows`` numbers a whole table without a single-partition sort.
* ``exact_median`` ranks counted values in pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtab.session import cut_lineage


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    specs: dict[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Add prefix aggregates in ``order`` within ``keys``.

    ``specs`` maps an output name to (kind, value); kind is one of ``min``, ``max``, ``sum``,
    ``last`` (latest non-null value; wrap nullable values in a struct to keep nulls).
    ``chunk`` must never decrease along ``order``. ``exclusive`` leaves the current row out and
    ``reverse`` walks the order backwards.
    """
    part = "__chunk"
    order_cols = [c.desc() if reverse else c.asc() for c in _columns(order)]
    position = F.struct(*_columns(order))
    stop = -1 if exclusive else 0
    inside = (
        Window.partitionBy(*keys, part)
        .orderBy(*order_cols)
        .rowsBetween(Window.unboundedPreceding, stop)
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.col(part).desc() if reverse else F.col(part).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    base = df.withColumn(part, chunk)
    for name, (_, value) in specs.items():
        base = base.withColumn(f"__v_{name}", value)

    over_rows, totals, over_chunks = [], [], []
    for name, (kind, _) in specs.items():
        value, total = F.col(f"__v_{name}"), F.col(f"__t_{name}")
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            over_rows.append(F.last(value, ignorenulls=True).over(inside).alias(f"__i_{name}"))
            totals.append(pick(value, F.when(value.isNotNull(), position)).alias(f"__t_{name}"))
            over_chunks.append(F.last(total, ignorenulls=True).over(before).alias(f"__c_{name}"))
        else:
            fold = {"min": F.min, "max": F.max, "sum": F.sum}[kind]
            over_rows.append(fold(value).over(inside).alias(f"__i_{name}"))
            totals.append(fold(value).alias(f"__t_{name}"))
            over_chunks.append(fold(total).over(before).alias(f"__c_{name}"))

    rows = base.select("*", *over_rows)
    carry = base.groupBy(*keys, part).agg(*totals).select(*keys, part, *over_chunks)
    joined = rows.join(carry, [*keys, part], "left")
    merged = []
    for name, (kind, _) in specs.items():
        inner, outer = F.col(f"__i_{name}"), F.col(f"__c_{name}")
        if kind == "last":
            merged.append(F.coalesce(inner, outer).alias(name))
        elif kind == "sum":
            both = F.coalesce(inner, F.lit(0)) + F.coalesce(outer, F.lit(0))
            merged.append(both.alias(name))
        else:
            merged.append((F.least if kind == "min" else F.greatest)(inner, outer).alias(name))
    return joined.select(*_columns(df.columns), *merged)


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    name: str = "row_no",
    within: Sequence[str] = (),
) -> DataFrame:
    """Number rows 1..n by ``order`` over the table (or inside each ``within`` group).

    ``bucket`` never decreases along ``order``. Only one count per bucket meets in one place; rows
    are sorted inside their bucket, so the table itself is never gathered.
    """
    part = "__bucket"
    based = df.withColumn(part, bucket)
    before = (
        Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    ).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        based.groupBy(*within, part)
        .agg(F.count("*").alias("__n"))
        .select(*within, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip"))
    )
    local = F.row_number().over(Window.partitionBy(*within, part).orderBy(*order))
    return (
        based.withColumn("__local", local)
        .join(offsets, [*within, part])
        .select(*_columns(df.columns), (F.col("__skip") + F.col("__local")).alias(name))
    )


def number_by_range(
    df: DataFrame, order: Sequence[str], name: str = "position", within: Sequence[str] = ()
) -> DataFrame:
    """Number rows 1..n by columns of any type over the table (or inside each ``within`` group).

    Rows are dealt by ranges of the order, so one count per range (and group) meets in one place. The
    deal is written, as two samplings of the ranges may differ.
    """
    part = "__part"
    dealt = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in (*order, *within)]).withColumn(part, F.spark_partition_id())
    )
    return number_rows(dealt, _columns(order), F.col(part), name, within).drop(part)


def hash_bucket(key: Column, digits: int = 3) -> Column:
    """Leading hex digits of an md5 key as a number; uniform, and monotone in the key."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def exact_median(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact median of every value column per key (mean of the middle two for even counts).

    Equal values of a key are counted before they are shuffled; a running count over them, in pieces by magnitude,
    tells the values of the middle ranks. No task sorts a whole key, whatever its share of the rows. Null values
    don't count; a key without others has a null median. A null key is a key.
    """
    group = ["__key", "__which"]
    named = F.array(*[
        F.struct(F.lit(i).alias("__which"), F.col(v).cast("double").alias("__v")) for i, v in enumerate(values)
    ])
    # As a struct, a null key equals itself in joins.
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    counts = df.select(key.alias("__key"), F.inline(named)).groupBy(*group, "__v").agg(F.count("*").alias("__n"))
    ranked = running(
        counts.filter("__v IS NOT NULL"), group, ["__v"], _magnitude(F.col("__v")), {"__upto": ("sum", F.col("__n"))}
    )
    totals = counts.groupBy(*group).agg(F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))).alias("__total"))
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor((F.col("__total") + 2) / 2)
    middle = totals.join(ranked, group, "left").groupBy(*group).agg(
        F.min(F.when(F.col("__upto") >= low, F.col("__v"))).alias("__a"),
        F.min(F.when(F.col("__upto") >= high, F.col("__v"))).alias("__b"),
    ).withColumn("__m", F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(0.5 * F.col("__a") + 0.5 * F.col("__b")))
    return middle.groupBy("__key").agg(*[
        F.max(F.when(F.col("__which") == i, F.col("__m"))).alias(v) for i, v in enumerate(values)
    ]).select(*[F.col("__key")[k].alias(k) for k in keys], *values)


def _magnitude(value: Column) -> Column:
    """Whole number that never falls as the value rises: 256 for each power of two, either sign."""
    size = F.floor(F.log2(F.abs(value)) * 256) + 300_000
    beyond = F.lit(1 << 40)
    return (
        F.when(F.isnan(value) | (value == float("inf")), beyond).when(value == float("-inf"), -beyond)
        .when(value == 0, 0).when(value > 0, size).otherwise(-size)
    )
