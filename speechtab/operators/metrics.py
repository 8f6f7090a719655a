"""Edit distances and error rates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtab.functions import distance


def char_distance(left: Column, right: Column) -> Column:
    """Unit-cost edit distance over characters; one form, exact for every length."""
    return distance.string_distance(left, right)


def word_distance(left: Column, right: Column) -> Column:
    """Unit-cost edit distance over two word arrays."""
    return distance.array_distance(left, right)


def score_pairs(
    pairs: DataFrame, prediction: str = "prediction", reference: str = "reference"
) -> DataFrame:
    """Distances and lengths per pair, under both word conventions, all in one pass over Arrow batches.

    Hand over only the columns that are needed later.

    ``*_macro`` splits at single spaces (the empty text is one word), ``*_micro`` at whitespace.
    """
    schema = T.StructType([*pairs.schema.fields, *distance.PAIR_FIELDS])
    names, of_pairs = schema.names, distance.pair_distances

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = of_pairs(batch[prediction], batch[reference])
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=names)

    p, r = F.col(prediction), F.col(reference)
    return pairs.mapInArrow(measure, schema).withColumns({"chars": F.length(r), "exact": p == r})


def rate_sums(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums from which both kinds of rates follow; sums of groups may be added up again."""
    def per_clip(errors: str, length: str) -> Column:
        return F.sum(F.col(errors) / F.greatest(length, F.lit(1)))

    return scored.groupBy(*by).agg(
        per_clip("word_errors_macro", "words_macro").alias("wer_sum"),
        per_clip("char_errors", "chars").alias("cer_sum"),
        F.sum(F.col("exact").cast("double")).alias("exact_sum"),
        F.count("*").alias("clips"),
        F.sum("word_errors_micro").alias("word_errors"), F.sum("words_micro").alias("words"),
        F.sum("char_errors").alias("char_errors"), F.sum("chars").alias("chars"),
    )


_MACRO = {"macro_wer": "wer_sum", "macro_cer": "cer_sum", "sentence_exact_match": "exact_sum"}
_MICRO = {"micro_wer": ("word_errors", "words"), "micro_cer": ("char_errors", "chars")}


def rates_of(sums: DataFrame, by: Sequence[str] = (), macro: bool = True, micro: bool = True) -> DataFrame:
    """Rates per group of sums of ``rate_sums``, for groups as fine as those or wider."""
    columns = []
    if macro:
        columns += [F.try_divide(F.sum(total), F.sum("clips")).alias(name) for name, total in _MACRO.items()]
        columns.append(F.sum("clips").alias("clips"))
    if micro:
        columns += [F.try_divide(F.sum(a), F.sum(b)).alias(name) for name, (a, b) in _MICRO.items()]
        columns += [F.sum(c).alias(c) for pair in _MICRO.values() for c in pair]
    return sums.groupBy(*by).agg(*columns)


def macro_rates(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over clips of distance / max(length, 1), and the share of exact matches."""
    return rates_of(rate_sums(scored, by), by, micro=False)


def micro_rates(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total distance over total reference length; null where the total is zero."""
    return rates_of(rate_sums(scored, by), by, macro=False)


def error_rates(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and micro rates in one pass."""
    return rates_of(rate_sums(scored, by), by)


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value)
    )


def pair_predictions(
    predictions: DataFrame, references: DataFrame, key: str = "sample_id"
) -> DataFrame:
    """Predictions next to references by key; ``status`` reports what has no partner."""
    return predictions.withColumn("__p", F.lit(True)).join(
        references.withColumn("__r", F.lit(True)), key, "full_outer"
    ).withColumn(
        "status",
        F.when(F.col("__p").isNull(), "no_prediction")
        .when(F.col("__r").isNull(), "no_reference")
        .otherwise("paired"),
    ).drop("__p", "__r")


def run_parity(
    actual: DataFrame, expected: DataFrame, key: str, exact: Sequence[str], close: Sequence[str],
    *, atol: float = 1e-6, rtol: float = 1e-6,
) -> DataFrame:
    """Compare two runs row by row: equality for ``exact``, tolerance for ``close`` columns."""
    a = actual.select(key, *[F.col(c).alias(f"a_{c}") for c in (*exact, *close)],
                      F.lit(True).alias("__a"))
    e = expected.select(key, *[F.col(c).alias(f"e_{c}") for c in (*exact, *close)],
                        F.lit(True).alias("__e"))
    same = {c: F.col(f"a_{c}").eqNullSafe(F.col(f"e_{c}")) for c in exact}
    for c in close:
        left, right = F.col(f"a_{c}"), F.col(f"e_{c}")
        near = F.abs(left - right) <= atol + rtol * F.abs(right)
        same[c] = F.coalesce(near, left.isNull() & right.isNull())
    both = F.col("__a").isNotNull() & F.col("__e").isNotNull()
    joined = a.join(e, key, "full_outer")
    agree = both
    for c in same:
        agree = agree & same[c]
    return joined.select(
        key,
        F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra")
        .otherwise("both").alias("presence"),
        *[(both & flag).alias(f"{c}_equal") for c, flag in same.items()],
        agree.alias("equal"),
    )
