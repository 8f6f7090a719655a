"""Time-aligned annotations: tab form (start, end, token) and space form."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab import constants as K
from speechtab.operators import text
from speechtab.sources.files import file_stem

# Line ends as Python's splitlines sees them, the two-character form first; and those besides it and the line feed.
OTHER_ENDS = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _split_lines(content: Column) -> Column:
    """Lines of a text without its byte-order mark; most texts have no line ends but the common two."""
    clean = F.when(F.startswith(content, F.lit("\ufeff")), F.substr(content, F.lit(2))).otherwise(content)
    plain = F.replace(clean, F.lit("\r\n"), F.lit("\n"))
    return F.when(F.rlike(plain, F.lit(OTHER_ENDS)), F.split(clean, LINE_ENDS, -1)).otherwise(F.split(plain, "\n", -1))


def _says_something(line: Column) -> Column:
    """Whether a line has more than whitespace; one that begins with a visible character needs no search."""
    return _visible(line) | (F.length(F.btrim(line, F.lit(K.WHITESPACE))) > 0)


def _visible(text: Column) -> Column:
    """Whether a text begins with a visible character of ASCII; false for many others that do as well."""
    return (text >= "!") & (text < "\x7f")


def _trimmed(line: Column) -> Column:
    """Most lines have nothing to trim, which their ends tell."""
    bare = _visible(line) & _visible(F.substring(line, F.lit(-1), F.lit(1)))
    return F.when(bare, line).otherwise(F.btrim(line, F.lit(K.WHITESPACE)))


def _lines(files: DataFrame, content: str, read: Callable[[Column], Column]) -> DataFrame:
    """One row per line with its number from 1 and what ``read`` makes of it, ``__p``; blank lines are dropped.

    A line is read inside the generator, so filters do not read it again.
    """
    parts = F.transform(_split_lines(F.col(content)), lambda line: F.when(_says_something(line), read(line)))
    others = [c for c in files.columns if c != content]
    return (
        files.select(*others, F.posexplode(parts).alias("__i", "__p"))
        .filter("__p IS NOT NULL")
        .withColumn("line_no", F.col("__i") + 1)
        .drop("__i")
    )


def parse_alignment(
    files: DataFrame, content: str = "value", *, silence: Sequence[str] = K.SILENCE_TOKENS,
    legacy: bool = False,
) -> DataFrame:
    """Annotation text to rows (..., line_no, start, end, token, is_silence, error).

    Every line needs three tab-separated columns. The current form reads numbers only on speech
    lines; the older one (``legacy``) on every line.
    """
    rows = _lines(files, content, lambda line: F.split(line, "\t", -1))
    three = F.size("__p") == 3
    token = F.when(three, text.normalize_token(F.get("__p", F.lit(2))))
    rows = rows.withColumn("token", token).withColumn("is_silence", F.col("token").isin(*silence))
    timed = F.lit(True) if legacy else ~F.col("is_silence")
    rows = rows.withColumns({
        "start": F.when(three, _number(F.get("__p", F.lit(0)))), "end": F.when(three, _number(F.get("__p", F.lit(1)))),
    })
    numbers = F.col("start").isNotNull() & F.col("end").isNotNull()
    return rows.withColumn(
        "error",
        # The token is only looked at where a number is missing.
        F.when(~three, "column_count").when(~numbers & timed, "not_a_number"),
    ).drop("__p")


def _number(field: Column) -> Column:
    """The cast strips spaces itself; other whitespace goes only where it fails."""
    return F.coalesce(
        field.try_cast("bigint"), F.btrim(field, F.lit(K.WHITESPACE)).try_cast("bigint")
    )


def read_alignment_tsv(spark: SparkSession, path: str, **options: object) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path")
    )
    named = files.withColumn("sample_id", file_stem(F.col("path")))
    return parse_alignment(named, **options)


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) by the error column."""
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL")


def speech_lines(rows: DataFrame) -> DataFrame:
    return rows.filter("error IS NULL AND NOT is_silence")


def parse_spaced(
    files: DataFrame, content: str = "value", *, last_field: bool = False,
    silence: Sequence[str] = K.SILENCE_TOKENS,
) -> DataFrame:
    """Space form: third field of lines with at least three, silence dropped, upper case.

    ``last_field`` is the variant that takes the last whitespace-separated field instead.
    """
    pattern = text.SPACES if last_field else " "
    rows = _lines(files, content, lambda line: F.split(_trimmed(line), pattern, -1))
    if last_field:
        kept = rows.withColumn("token", F.element_at("__p", -1))
    else:
        kept = rows.filter(F.size("__p") >= 3).withColumn("token", F.get("__p", F.lit(2)))
    return (
        kept.filter(~F.lower("token").isin(*silence))
        .withColumn("token", F.upper("token"))
        .drop("__p")
    )


def read_alignment_spaced(spark: SparkSession, path: str, **options: object) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path")
    )
    return parse_spaced(files.withColumn("sample_id", file_stem(F.col("path"))), **options)


def clip_transcripts(
    files: DataFrame, content: str = "value", *, silence: Sequence[str] = K.SILENCE_TOKENS,
    keep_empty: bool = False,
) -> DataFrame:
    """Transcript per file straight from its text: no explode, no shuffle.

    For files already held in one row each; malformed lines are ignored here and reported by
    ``parse_alignment``.
    """
    lines = F.filter(
        F.transform(_split_lines(F.col(content)), lambda l: F.split(l, "\t", -1)),
        lambda p: F.size(p) == 3,
    )
    tokens = F.transform(lines, lambda p: F.get(p, F.lit(2)))
    return files.withColumn(
        "transcript", text.normalize_tokens(tokens, silence, keep_empty=keep_empty)
    )
