"""Embedding near-duplicates by randomised-rotation binary codes.

A vector of unit length is rotated at random; the signs are its code, and the inner product of the
vector with its own code is the stored correction factor. Code times rotated query, divided by the
factor, estimates the cosine without bias, with an error that the factor bounds. A pair whose estimate
lies more than ``SIGMAS`` deviations below the limit is settled; all others are computed exactly, in
double precision, so no link is below the limit.

Pairs meet in tables of further sign bits. The bits of a table grow with the logarithm of the rows and
the number of tables is set so that a pair at the limit itself is missed with a chance of ``MISSED``.
A pair counts in the first table in which it meets, so no pairs are gathered: tasks return each vector's
count and links that connect its group. Equal vectors are one class with a multiplicity. Buckets of many
rows are split into parts, and every two parts meet in a task of their own.

Null vectors, zero vectors and vectors with null or non-finite components link with nothing; vectors of
different length neither. Repeated rows are vectors of their own, and so are different vectors of one vec_id.
A row without vec_id links as any other and gives its component no id; a component of such rows alone has a
null id and keeps them all. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import cut, map_batches, whole_groups
from speechtab.llm.components import components

LIMIT = 0.95
MISSED = 1e-4
SIGMAS = 4.0
#: Rows of a bucket that meet in one task.
PART = 4096
_BLOCK = 512


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def link_vectors(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    classes = cut(
        rows.filter(usable(F.col("vector"))).groupBy("vector").agg(
            F.min("vec_id").alias("first_id"), F.count("*").alias("members")
        ).withColumn("class_id", F.monotonically_increasing_id()),
        "classes",
    )
    found = cut(_meetings(classes, limit), "met")
    named = components(found.filter("b IS NOT NULL").select("a", "b"))
    counted = found.groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("others"))
    known = cut(
        classes.join(counted, "class_id", "left")
        .join(named.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select(
            "vector", "first_id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "class_id").alias("component"),
        ),
        "known",
    )
    firsts = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(firsts, "component").select("vector", "n_links", "component_id", F.lit(True).alias("used"))
    # A vector that can't be used equals none of the classes.
    return rows.join(known, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("used"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def table_shape(rows: int, limit: float) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = max(4, math.ceil(math.log2(max(2, rows))) - 3)
    alike = (1 - math.acos(limit) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - alike))


@lru_cache(maxsize=64)
def rotation(size: int, number: int) -> np.ndarray:
    """Random orthogonal matrix ``number`` for vectors of a length."""
    drawn = np.random.default_rng([size, number]).standard_normal((size, size))
    q, r = np.linalg.qr(drawn)
    return q * np.sign(np.diag(r))


def _meetings(classes: DataFrame, limit: float) -> DataFrame:
    """(a, b, links): a count of links of a (b null) or a link between a and b (0 links)."""
    bits, tables = table_shape(classes.count(), limit)

    def place(batches):
        for batch in batches:
            vectors = [np.array(v, float) for v in batch["vector"].to_pylist()]
            keys = [_table_keys(v, bits, tables) for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [batch["class_id"], batch["members"], batch["vector"], pa.array(keys, pa.list_(pa.int32()))],
                names=["class_id", "members", "vector", "keys"],
            )

    placed = map_batches(
        classes.select("class_id", "members", "vector"), place,
        "class_id long, members long, vector array<double>, keys array<int>",
    )
    spread = cut(placed, "placed").select("*", F.posexplode("keys").alias("number", "key")).withColumn(
        "bucket", F.xxhash64("number", "key", F.size("vector"))
    )
    full = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > PART).select(
        "bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts")
    )
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = spread.join(full, "bucket", "left").withColumn(
        "part", F.pmod(F.xxhash64("class_id", F.lit(7)), parts).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("group"),
        (F.col("part") != F.col("other")).alias("across"), "part", "number", "class_id", "members", "vector", "keys",
    )

    def meet(batches):
        for rows in whole_groups(batches, "group", PART):
            yield from _groups(rows, limit)

    return map_batches(
        dealt.repartition("group").sortWithinPartitions("group"), meet, "a long, b long, links long"
    )


def _table_keys(vector: np.ndarray, bits: int, tables: int) -> np.ndarray:
    size = len(vector)
    turns = -(-bits * tables // size)
    # Rotation 0 makes the code; the tables have rotations of their own.
    signs = np.concatenate([rotation(size, 1 + t) @ vector > 0 for t in range(turns)])[:bits * tables]
    return (signs.reshape(tables, bits) @ (1 << np.arange(bits))).astype(np.int32)


def _groups(rows: pa.Table, limit: float):
    groups = rows["group"].to_numpy()
    edges = np.concatenate(([0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]))
    several = np.flatnonzero(np.diff(edges) > 1)
    if not len(several):
        return
    ids, members = rows["class_id"].to_numpy(), rows["members"].to_numpy()
    number, part = rows["number"].to_numpy(), rows["part"].to_numpy()
    across = rows["across"].to_numpy()
    vectors_, keys = rows["vector"].combine_chunks(), rows["keys"].combine_chunks()
    offsets, flat = vectors_.offsets.to_numpy(), vectors_.values.to_numpy(zero_copy_only=False)
    tables = len(keys[0])
    keys = keys.values.to_numpy()[keys.offsets[0].as_py():].reshape(-1, tables)
    out = []
    for g in several:
        a, b = edges[g], edges[g + 1]
        size = offsets[a + 1] - offsets[a]
        vectors = flat[offsets[a]:offsets[b]].reshape(b - a, size)
        out += _pairs(vectors, ids[a:b], members[a:b], keys[a:b], number[a], part[a:b], across[a], limit)
    if out:
        left, right, links = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays(
            [pa.array(left), pa.array(right, mask=right == left), pa.array(links)], names=["a", "b", "links"]
        )


def _join(label, x, y):
    """Join the groups of x and y; ``label`` has each row's smallest row, that of earlier pairs as well."""
    while len(x):
        # Only these stand for their groups, so what joined earlier moves along.
        a, b = label[x], label[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label[:] = up


def _pairs(vectors, ids, members, keys, number, part, across, limit):
    """Triples of arrays a, b, links; b equal to a stands for a count."""
    count, size = vectors.shape
    unit = vectors / np.linalg.norm(vectors / np.abs(vectors).max(axis=1, keepdims=True), axis=1, keepdims=True)
    unit /= np.abs(vectors).max(axis=1, keepdims=True)
    turned = unit @ rotation(size, 0).T
    codes = np.where(turned > 0, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(size))
    factor = np.abs(turned).sum(axis=1) / math.sqrt(size)
    slack = SIGMAS * np.sqrt(np.maximum(0, 1 - factor**2) / max(1, size - 1)) / factor
    turned = turned.astype(np.float32)
    total = np.zeros(count, np.int64)
    label = np.arange(count)
    for start in range(0, count, _BLOCK):
        stop = min(count, start + _BLOCK)
        estimate = (codes[start:stop] @ turned[start:].T) / factor[start:stop, None]
        x, y = np.nonzero(estimate >= limit - slack[start:stop, None] - 1e-5)
        x, y = x + start, y + start
        new = (x < y) & ((part[x] != part[y]) if across else True)
        x, y = x[new], y[new]
        close = np.einsum("ij,ij->i", unit[x], unit[y]) >= limit
        x, y = x[close], y[close]
        # Met in an earlier table already.
        new = ~(keys[x, :number] == keys[y, :number]).any(axis=1)
        x, y = x[new], y[new]
        np.add.at(total, x, members[y])
        np.add.at(total, y, members[x])
        _join(label, x, y)
    out = []
    seen = np.flatnonzero(total)
    if len(seen):
        out.append((ids[seen], ids[seen], total[seen]))
        moved = np.flatnonzero(label != np.arange(count))
        out.append((ids[moved], ids[label[moved]], np.zeros(len(moved), np.int64)))
    return out
