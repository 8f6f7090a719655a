"""Homomorphic multiset fingerprints of documents, in DataFrame functions.

A text is a multiset of paragraphs: lines, and sentences and clauses within them. Each is hashed; the hash picks a
level (a level has half the paragraphs of the one above), a lane of the level and a value, which is a
wide vector with one lane set. The fingerprint is the sum of these vectors with each lane modulo 2^32,
behind two lanes that sum over all paragraphs. Sums don't depend on the order, equal multisets have
equal sums, and a paragraph is inserted or deleted by adding or subtracting its vector.

Lanes that only differ where paragraphs differ measure likeness: over the levels that are sparse enough
for a lane to hold few paragraphs, twice the equal lanes against those and the lanes that either text
uses (1 for the same paragraphs, 0 for none in common). Texts of any size have sparse levels; for short
texts the upper levels are zero.

A null text counts as the empty one (one empty paragraph). Repeated rows keep a row each and equal
doc_ids follow each other in the order of their texts. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import whole_text
from speechtab.llm.neighbours import PART, with_next

#: The last level has one of 2^23 paragraphs, so it is sparse in the longest text that a row can hold.
LEVELS = 24
#: Lanes of a level; a level counts for likeness if either text leaves a third of them free.
WIDTH = 12
MODULUS = 1 << 32
TOTALS = 2
LANES = TOTALS + LEVELS * WIDTH


def paragraphs(text: Column) -> Column:
    """Lines, cut behind sentences and clauses; every character is in one part or is a line end."""
    return F.split(text, r"\n|(?<=[.!?,;|])(?= )")


def lane_sums(parts: DataFrame, keys: list[str], part: str, kept: list[str]) -> DataFrame:
    """``lanes`` of the multiset of ``part`` of each ``keys``: sums, combined before the shuffle."""
    summed = level_sums(parts, keys, part, kept)
    levels = F.collect_list(F.struct("level", "sums"))
    return summed.groupBy(*keys).agg(levels.alias("levels"), *[F.first(c, True).alias(c) for c in kept]).select(
        *keys, *kept, lanes_of(F.col("levels")).alias("lanes")
    )


def level_sums(parts: DataFrame, keys: list[str], part: str, kept: list[str]) -> DataFrame:
    """``sums`` of each ``level`` that occurs: its share of the totals, then its lanes."""
    valued = parts.withColumn("hashed", F.xxhash64(part)).withColumn("other", F.xxhash64(part, F.lit(1))).select(
        *keys, *kept, _level(F.col("hashed")).alias("level"), "other",
        # Level and value use the first hash up.
        (F.shiftrightunsigned("other", 8).bitwiseAND(0xFFFFFF) % WIDTH).alias("lane"),
        F.shiftrightunsigned("hashed", 32).bitwiseAND(MODULUS - 1).alias("value"),
    )
    names = [f"sum_{i}" for i in range(TOTALS + WIDTH)]
    sums = [
        F.sum(F.col("other").bitwiseAND(MODULUS - 1)), F.sum(F.shiftrightunsigned("other", 32).bitwiseAND(MODULUS - 1)),
        *[F.sum(F.when(F.col("lane") == i, F.col("value")).otherwise(0)) for i in range(WIDTH)],
    ]
    return valued.groupBy(*keys, "level").agg(
        *[s.alias(n) for s, n in zip(sums, names)], *[F.first(c, True).alias(c) for c in kept]
    ).select(
        *keys, *kept, "level", F.array(*[F.col(n).bitwiseAND(MODULUS - 1) for n in names]).alias("sums")
    )


def lanes_of(levels: Column) -> Column:
    """Lanes of a text from the (level, sums) that it has."""
    by_level = F.map_from_entries(levels)
    total = lambda i: F.aggregate(
        levels, F.lit(0).cast("long"), lambda s, x: (s + x["sums"][i]).bitwiseAND(MODULUS - 1)
    )
    none = F.array_repeat(F.lit(0).cast("long"), WIDTH)
    lanes = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda k: F.coalesce(F.slice(F.try_element_at(by_level, k), TOTALS + 1, WIDTH), none),
    )
    return F.concat(F.array(*[total(i) for i in range(TOTALS)]), F.flatten(lanes))


def _level(hashed: Column) -> Column:
    # Level k with a chance of 2^-(k+1); the last takes the rest.
    last = 1 << LEVELS - 1
    marked = hashed.bitwiseAND(last - 1).bitwiseOR(F.lit(last).cast("long"))
    return F.bit_count(marked.bitwiseAND(-marked) - 1)


def add(a: Column, b: Column) -> Column:
    """Lanes of two multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(MODULUS - 1))


def subtract(a: Column, b: Column) -> Column:
    """Lanes of a multiset without a part of it."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(MODULUS - 1))


def to_hex(sums: Column) -> Column:
    return F.lower(F.array_join(F.transform(sums, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 1).otherwise(1 << 16))
    # Each level as one number: lanes that are used and equal below 2^16, used and different above.
    levels = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda k: F.aggregate(F.slice(pairs, k * WIDTH + TOTALS + 1, WIDTH), F.lit(0), lambda s, x: s + x),
    )
    same = lambda x: x.bitwiseAND(0xFFFF)
    used = lambda x: same(x) + F.shiftright(x, 16)
    # (equal, used) over the sparse levels, and over all for texts that have none.
    counted = F.aggregate(
        levels, F.array(*[F.lit(0)] * 4),
        lambda s, x: F.when(used(x) <= WIDTH * 2 // 3, F.array(s[0] + same(x), s[1] + used(x), s[2] + same(x), s[3] + used(x)))
        .otherwise(F.array(s[0], s[1], s[2] + same(x), s[3] + used(x))),
        lambda s: F.when(s[1] > 0, 2 * s[0] / (s[0] + s[1])).when(s[3] > 0, 2 * s[2] / (s[2] + s[3])).otherwise(F.lit(0.0)),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(counted)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to that and the next document's.

    The edited text has its last quarter replaced by as many first characters of the next document.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = with_next(texts, "doc_id", "text", parts=True).withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(
            F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")),
            F.substring("next_text", F.lit(1), quarter),
        )
    )
    pieces = edited.withColumn("row", F.monotonically_increasing_id()).select(
        *PART, "row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited", "next_text")).alias("which", "whole"),
    )
    kept = ["doc_id", "n_chars", "edited_sha256"]
    # Only one of a row's three texts carries the other columns through the shuffles.
    split = pieces.select(
        *PART, "row", "which", *[F.when(F.col("which") == 0, F.col(c)).alias(c) for c in kept],
        F.explode(paragraphs(F.col("whole"))).alias("part"),
    )
    # Rows lie parted as their neighbours were found, so these sums need no shuffle.
    summed = level_sums(split, [*PART, "row", "which"], "part", kept)
    of = lambda which: lanes_of(F.collect_list(
        F.when(F.col("which") == which, F.struct("level", "sums"))
    ))
    beside = summed.groupBy(*PART, "row").agg(
        *[F.max(c).alias(c) for c in kept], of(0).alias("own"), of(1).alias("changed"), of(2).alias("next")
    )
    return beside.select(
        *kept, to_hex(F.col("own")).alias("fingerprint"), to_hex(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
