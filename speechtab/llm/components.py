"""Connected components of a link table, by alternating large and small stars.

Each round attaches nodes to smaller neighbours of their neighbourhood; the rounds end when the links
stop changing, after about the logarithm of the longest chain. Links are written after each round, so
no plan grows and a lost executor costs one round's tasks. Hubs are aggregated before the shuffle and
their joins can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its smallest node.

    Loops, repeated and reversed links and links with a null end are allowed and say nothing.
    """
    now = cut(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    while (state := _state(now)) != before:
        before = state
        now = cut(_small_star(_large_star(now)), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first())


def _attach(pairs: DataFrame) -> DataFrame:
    """Each pair (node, other) with the smallest other of its node."""
    return pairs.join(pairs.groupBy("node").agg(F.min("other").alias("least")), "node")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    return _attach(both).filter("other > node").select(
        F.col("other").alias("a"), F.least("node", "least").alias("b")
    ).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = _attach(links.select(F.col("a").alias("node"), F.col("b").alias("other")))
    return down.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(
        down.select(F.col("node").alias("a"), F.col("least").alias("b"))
    ).filter("a <> b").distinct()
