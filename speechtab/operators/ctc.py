"""Score tables: required steps, argmax, greedy collapse, log-softmax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab import constants as K
from speechtab import skew
from speechtab.operators import text


def minimum_steps(transcript: Column) -> Column:
    """Steps a transcript needs: its length plus one per pair of equal neighbours."""
    lone = F.regexp_replace(transcript, r"(?s)(.)(?=\1)", "")
    return F.length(transcript) * 2 - F.length(lone)


def minimum_steps_of_ids(ids: Column) -> Column:
    shifted = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    equal = F.filter(
        F.zip_with(ids, shifted, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda e: e
    )
    return F.size(ids) + F.size(equal)


def argmax(scores: Column) -> Column:
    """Index from 0 of the largest score, the lowest index on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_steps(logits: DataFrame, length: str = "length") -> DataFrame:
    """Best class per step, limited to the true length of the clip."""
    return logits.filter(F.col("t") < F.col(length)).withColumn("token", argmax(F.col("scores")))


def log_softmax(scores: Column) -> Column:
    doubles = F.transform(scores, lambda s: s.cast("double"))
    peak = F.array_max(doubles)
    total = F.aggregate(doubles, F.lit(0.0), lambda acc, s: acc + F.exp(s - peak))
    return F.transform(doubles, lambda s: s - (peak + F.ln(total)))


def collapse_ids(ids: Column, alphabet: str = K.SERBIAN_LETTERS) -> Column:
    """Greedy collapse of one id array: drop repeats and blanks, merge spaces, strip."""
    letters = text.string_array(list(alphabet))
    empty = F.struct(F.lit(-1).alias("last"), text.string_array([]).alias("out"))

    def step(acc: Column, token: Column) -> Column:
        emit = (token != acc["last"]) & (token >= 1)
        return F.struct(
            token.alias("last"),
            F.when(emit, F.concat(acc["out"], F.array(F.element_at(letters, F.when(emit, token)))))
            .otherwise(acc["out"])
            .alias("out"),
        )

    joined = F.aggregate(
        F.transform(ids, lambda i: i.cast("int")), empty, step,
        lambda acc: F.array_join(acc["out"], ""),
    )
    return squeeze_spaces(joined)


def squeeze_spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, " +", " "))


def collapse_steps(
    steps: DataFrame,
    key: str,
    alphabet: str = K.SERBIAN_LETTERS,
    *,
    merge_spaces: bool = True,
    chunk_size: int = 65_536,
) -> DataFrame:
    """Greedy collapse of a long table (key, t, token), split along very long clips.

    ``merge_spaces=False`` is the older form that leaves doubled spaces in place.
    """
    letters = text.string_array(list(alphabet))
    emitted = (
        skew.running(
            steps, [key], ["t"], F.floor(F.col("t") / chunk_size),
            {"previous": ("last", F.col("token"))}, exclusive=True,
        )
        .filter("token >= 1 AND NOT (token <=> previous)")
        .select(key, "t", F.element_at(letters, F.col("token")).alias("letter"))
    )
    texts = emitted.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("t", "letter"))), lambda p: p["letter"]
            ), ""
        ).alias("text")
    )
    finish = squeeze_spaces if merge_spaces else F.trim
    clips = steps.select(key).distinct()
    return clips.join(texts, key, "left").select(
        key, finish(F.coalesce("text", F.lit(""))).alias("text")
    )


def collapse_path(tokens: Column, alphabet: str = K.SERBIAN_LETTERS) -> Column:
    """Text of a decoder path: negative padding is skipped before the collapse."""
    return collapse_ids(F.filter(tokens, lambda t: t >= 0), alphabet)


def greedy_decode(
    logits: DataFrame, key: Sequence[str] = ("sample_id",), alphabet: str = K.SERBIAN_LETTERS
) -> DataFrame:
    """Clip rows with ``steps`` (array of score arrays) and ``length`` to text, without a shuffle."""
    ids = F.transform(
        F.slice(F.col("steps"), F.lit(1), F.least(F.col("length"), F.size("steps"))), argmax
    )
    return logits.select(*key, collapse_ids(ids, alphabet).alias("text"))
