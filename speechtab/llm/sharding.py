"""Minimax contiguous partition into shards, in DataFrame operations.

Documents with equal texts are an atom, and atoms are ordered by the digest of the text. The smallest
feasible shard capacity is found by binary search with a greedy check over atom sizes, and the shards
are cut within it, as even ranges of digests; so a document's shard needs no join.

The search sees sizes by prefixes of the digests, a bounded table. A prefix with several atoms may hide
a cut, so bounds come from two checks: cutting at prefixes only (feasible for atoms too) and cutting
anywhere inside such prefixes (infeasible for atoms as well if it fails). Only prefixes between the two
ways of each cut are then split by a longer prefix, until both bounds meet. Every round is one
aggregation; hot atoms are summed before the shuffle.

A null text has no bytes and counts as equal to the empty one. Repeated rows are documents of their own.
An atom beyond an even share is a shard of its own. With fewer
atoms than shards some shards are empty. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtab.llm.common import cut, whole_text

#: Hexadecimal digits of the first prefixes: 4,096 of them.
DIGITS = 3
#: Rows that one task numbers.
NUMBERED = 4096


def shard_documents(docs: DataFrame, shards: int = 40, extra_bytes: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = whole_text()
    sized = cut(
        docs.select(
            "doc_id", (F.octet_length(text) + extra_bytes).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest"),
        ),
        "sized",
    )
    edges = shard_edges(sized, shards)
    placed = sized.withColumn("shard", _rank(F.col("digest"), edges))
    return _numbered(placed, sized.count(), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_edges(sized: DataFrame, shards: int) -> list[str]:
    """Digests at which each shard but the first begins.

    An atom above an even share of all bytes has a shard of its own, as its size would otherwise be the
    capacity of all. The others are dealt to the stretches between such atoms by size, and each stretch is cut
    by a search of its own.
    """
    total = sized.agg(F.sum("size")).first()[0] or 0
    # Fewer than there are shards.
    heavy = sorted(tuple(r) for r in sized.groupBy("digest").agg(F.sum("size").alias("size")).filter(
        F.col("size") * shards > total
    ).collect())
    while True:
        digests = [d for d, _ in heavy]
        stretch = _rank(F.col("digest"), digests)
        sizes = dict(map(tuple, sized.filter(~F.col("digest").isin(digests) if digests else F.lit(True)).groupBy(
            stretch.alias("stretch")
        ).agg(F.sum("size")).collect()))
        if len(sizes) <= shards - len(heavy):
            break
        heavy.remove(min(heavy, key=lambda a: a[1]))
    given = {s: 1 for s in sizes}
    for _ in range(shards - len(heavy) - len(sizes) if sizes else 0):
        given[max(sizes, key=lambda s: sizes[s] / given[s])] += 1
    edges = []
    for s in range(len(heavy) + 1):
        if s in sizes:
            if s:
                edges.append(digests[s - 1] + "0")  # behind the atom, before any other
            inside = sized.filter((stretch == s) & ~F.col("digest").isin(digests)) if digests else sized
            edges += cut_points(inside, given[s])
        if s < len(heavy):
            edges.append(digests[s])
    # The first shard begins with the first atom.
    return edges[1:] if heavy and 0 not in sizes else edges


def cut_points(sized: DataFrame, shards: int) -> list[str]:
    """The prefix of digests at which each shard but the first begins (``size``, ``digest``)."""
    atoms = _by_prefix(sized, DIGITS)
    digits = DIGITS
    while True:
        sizes = [a[1] for a in atoms]
        starts = [0, *accumulate(sizes)]
        solid = [a[2] for a in atoms]
        high = _least_capacity(starts, [True] * len(atoms), shards)
        low = _least_capacity(starts, solid, shards)
        ends = _ends(starts, solid, shards, low, high) if low < high else []
        split = [
            a[0] for i, a in enumerate(atoms)
            if not a[2] and any(early < starts[i + 1] and starts[i] <= late for early, late in ends)
        ]
        if not split:
            return [atoms[i][0] for i in _even(starts, high, shards)]
        digits += 1
        finer = sized.filter(_prefix_in(split, digits - 1))
        kept = [a for a in atoms if a[0] not in set(split)]
        atoms = sorted(kept + _by_prefix(finer, digits))


def _by_prefix(sized: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
    """(prefix, bytes, whether it is a single atom) in order; bounded by the prefixes asked for."""
    found = sized.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(
        F.sum("size").alias("size"), (F.min("digest") == F.max("digest")).alias("solid")
    )
    return sorted((r["prefix"], r["size"], r["solid"]) for r in found.collect())


def _prefix_in(prefixes: list[str], digits: int) -> Column:
    """``prefixes`` may differ in length."""
    by_length: dict[int, list[str]] = {}
    for p in prefixes:
        by_length.setdefault(len(p), []).append(p)
    tests = [F.substring("digest", 1, n).isin(some) for n, some in by_length.items()]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _reach(starts: list[int], solid: list[bool], at: int, capacity: int) -> int:
    """How far a shard from byte ``at`` extends; only solid atoms must stay whole."""
    goal = at + capacity
    if goal >= starts[-1]:
        return starts[-1]
    i = bisect_right(starts, goal) - 1
    return starts[i] if solid[i] else goal


def _least_capacity(starts: list[int], solid: list[bool], shards: int) -> int:
    total = starts[-1]
    low, high = -(-total // shards), total
    while low < high:
        capacity, at = (low + high) // 2, 0
        for _ in range(shards):
            at = _reach(starts, solid, at, capacity)
        low, high = (low, capacity) if at == total else (capacity + 1, high)
    return low


def _even(starts: list[int], capacity: int, shards: int) -> list[int]:
    """Atoms at which the shards after the first begin; the empty ones at the end begin nowhere.

    Each shard ends near an even share of what remains, within the capacity and so that the others can hold
    the rest within it.
    """
    end = len(starts) - 1
    # The first atom from which so many shards reach the end.
    behind = [end]
    for _ in range(shards - 1):
        behind.append(bisect_left(starts, starts[behind[-1]] - capacity))
    at, cuts = 0, []
    for left in range(shards - 1, 0, -1):
        goal = starts[at] + (starts[end] - starts[at]) / (left + 1)
        near = bisect_left(starts, goal)
        if near and goal - starts[near - 1] < starts[near] - goal:
            near -= 1
        at = min(max(near, behind[left], at + 1), bisect_right(starts, starts[at] + capacity) - 1)
        if at >= end:
            break
        cuts.append(at)
    return cuts


def _ends(starts: list[int], solid: list[bool], shards: int, low: int, high: int) -> list[tuple[int, int]]:
    """Between which bytes each shard ends, for any capacity between the bounds."""
    whole, early, late, ends = [True] * len(solid), 0, 0, []
    for _ in range(shards - 1):
        early, late = _reach(starts, whole, early, low), _reach(starts, solid, late, high)
        ends.append((early, late))
    return ends


def _rank(digest: Column, edges: list[str]) -> Column:
    """Edges at or below the digest, as a search among literals."""
    if not edges:
        return F.lit(0)
    middle = len(edges) // 2
    return F.when(digest < edges[middle], _rank(digest, edges[:middle])).otherwise(
        F.lit(middle + 1) + _rank(digest, edges[middle + 1:])
    )


def _numbered(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Slots from 0 in each shard, in the order of the md5 of the doc_id.

    Rows are numbered in parts of a shard, behind the counts of the parts before.
    """
    parts = max(1, rows // (shards * NUMBERED))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    part = (F.conv(F.substring(order, 1, 6), 16, 10).cast("long") * parts / (1 << 24)).cast("int")
    based = placed.withColumn("order", order).withColumn("part", part)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    skips = based.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")
    )
    inside = Window.partitionBy("shard", "part").orderBy("order", "doc_id", "digest")
    return (
        based.withColumn("inside", F.row_number().over(inside))
        .join(skips, ["shard", "part"])
        .withColumn("slot", (F.col("skip") + F.col("inside") - 1).cast("long"))
    )
