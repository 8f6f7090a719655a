"""Transcript text: normalisation, vocabulary, encoding, token scans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab import constants as K


# One or more whitespace characters, as a pattern.
SPACES = f"[{K.WHITESPACE}]+"


def has_other_space(text: Column) -> Column:
    """Whether there is whitespace besides the space; in most texts words are parted by spaces alone.

    Searches for single characters took a fraction of the time of a pattern.
    """
    return reduce(or_, (F.contains(text, F.lit(c)) for c in K.WHITESPACE if c != " "))


def string_array(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def characters(text: Column) -> Column:
    """Characters of a string; an empty array for the empty string."""
    return F.when(F.length(text) == 0, string_array([])).otherwise(F.split(text, ""))


def words_macro(text: Column) -> Column:
    """Split at every single space, so the empty text is one empty word."""
    return F.split(text, " ", -1)


def words_micro(text: Column) -> Column:
    """Split at runs of whitespace; the empty text has no words."""
    return F.array_remove(
        F.when(has_other_space(text), F.split(text, SPACES, -1)).otherwise(F.split(text, " ", -1)), ""
    )


def compose_letters(text: Column) -> Column:
    """NFC for the corpus alphabet, on the JVM: base letter + combining mark to one letter."""
    for pair, letter in (
        ("c\u030c", "č"), ("c\u0301", "ć"), ("s\u030c", "š"), ("z\u030c", "ž"),
        ("C\u030c", "Č"), ("C\u0301", "Ć"), ("S\u030c", "Š"), ("Z\u030c", "Ž"),
    ):
        text = F.replace(text, F.lit(pair), F.lit(letter))
    return text


def normalize_token(token: Column) -> Column:
    return compose_letters(F.lower(F.btrim(token, F.lit(K.WHITESPACE))))


def is_silence(token: Column, silence: Sequence[str] = K.SILENCE_TOKENS) -> Column:
    return F.lower(F.btrim(token, F.lit(K.WHITESPACE))).isin(*silence)


def normalize_tokens(
    tokens: Column, silence: Sequence[str] = K.SILENCE_TOKENS, *, keep_empty: bool = False
) -> Column:
    """Transcript of a token array: normalise, drop silence, join with one space.

    The older annotation form keeps empty tokens (``keep_empty``), which doubles a space.
    """
    return _join_spoken(F.transform(tokens, normalize_token), silence, keep_empty)


def normalize_sentence(sentence: Column, silence: Sequence[str] = K.SILENCE_TOKENS) -> Column:
    """The same for words separated by spaces, case and letters settled on the whole string."""
    words = F.split(compose_letters(F.lower(sentence)), " ", -1)
    stripped = F.transform(words, lambda w: F.btrim(w, F.lit(K.WHITESPACE)))
    return F.when(
        has_other_space(sentence), _join_spoken(stripped, silence, False)
    ).otherwise(_join_spoken(words, silence, False))


def _join_spoken(clean: Column, silence: Sequence[str], keep_empty: bool) -> Column:
    def spoken(token: Column) -> Column:
        heard = ~token.isin(*silence) if silence else F.lit(True)
        return heard if keep_empty else heard & (F.length(token) > 0)

    return F.array_join(F.filter(clean, spoken), " ")


def unknown_characters(text: Column, alphabet: str = K.SERBIAN_LETTERS) -> Column:
    """Sorted distinct characters outside the alphabet."""
    return F.array_sort(
        F.array_except(F.array_distinct(characters(text)), string_array(list(alphabet)))
    )


def encode_text(text: Column, alphabet: str = K.SERBIAN_LETTERS, start: int = 1) -> Column:
    """Character ids from ``start``; -1 marks a character outside the alphabet."""
    table = F.create_map(*[
        item for i, c in enumerate(alphabet) for item in (F.lit(c), F.lit(i + start))
    ])
    return F.transform(
        characters(text), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(-1))
    )


def decode_ids(ids: Column, alphabet: str = K.SERBIAN_LETTERS, start: int = 1) -> Column:
    """Text of an id array; ids below ``start`` vanish and the ends are stripped."""
    letters = string_array(list(alphabet))
    shown = F.transform(
        F.filter(ids, lambda i: i >= start), lambda i: F.element_at(letters, i - start + 1)
    )
    return F.trim(F.array_join(shown, ""))


def vocabulary(spark: SparkSession, alphabet: str = K.SERBIAN_LETTERS) -> DataFrame:
    """Dimension table (symbol, id); a fixed handful of rows."""
    symbols = string_array([K.BLANK_SYMBOL, *alphabet])
    return spark.range(1).select(F.posexplode(symbols).alias("id", "symbol")).select("symbol", "id")


def language_model_tokens(text: Column) -> Column:
    """One token per character, the space spelled out."""
    return F.transform(
        characters(text), lambda c: F.when(c == " ", F.lit(K.LM_SPACE)).otherwise(c)
    )


def find_tokens(df: DataFrame, keys: Sequence[str], text: str, tokens: Sequence[str]) -> DataFrame:
    """(key, token) for every listed token a text contains; one pass, no join."""
    hits = F.filter(string_array(tokens), lambda t: F.contains(F.col(text), t))
    return df.select(*keys, F.explode(hits).alias("token"))


def strip_prefix(name: Column, prefix: str = "module.") -> Column:
    return F.when(
        F.startswith(name, F.lit(prefix)), F.substr(name, F.lit(len(prefix) + 1))
    ).otherwise(name)


def prefix_group(
    name: Column, groups: dict[str, tuple[str, ...]] = K.PARAMETER_GROUPS
) -> Column:
    """Group of a name by its prefix; ``error`` when no group claims it."""
    out = F.lit("error")
    for group, prefixes in reversed(list(groups.items())):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith(name, F.lit(p))
        out = F.when(hit, F.lit(group)).otherwise(out)
    return out


def transcripts(
    tokens: DataFrame, keys: Sequence[str], order: str, token: str, name: str = "transcript"
) -> DataFrame:
    """Tokens of a clip in line order as one string (one output row per clip)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(token))))
    return tokens.groupBy(*keys).agg(
        F.array_join(F.transform(pairs, lambda p: p[token]), " ").alias(name)
    )


def word_count_histogram(df: DataFrame, text: str) -> DataFrame:
    return df.groupBy(F.size(words_micro(F.col(text))).alias("n_words")).agg(
        F.count("*").alias("sentences")
    )


def words_by_position(df: DataFrame, text: str) -> DataFrame:
    """(position from 1, word, occurrences): the vocabulary seen at every word position."""
    return (
        df.select(F.posexplode(words_micro(F.col(text))).alias("position", "word"))
        .groupBy((F.col("position") + 1).alias("position"), "word")
        .agg(F.count("*").alias("occurrences"))
    )


def position_sizes(by_position: DataFrame) -> DataFrame:
    """Number of different words per position."""
    return by_position.groupBy("position").agg(
        F.count("*").alias("distinct_words"), F.sum("occurrences").alias("words")
    )
