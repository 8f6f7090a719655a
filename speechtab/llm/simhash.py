"""SimHash near-duplicates through vantage-point trees.

Fingerprints that occur are partitioned by Hamming distance. Of two fingerprints within three bits, one
of four blocks of 16 bits is equal, so in that block both have the same distance to any vantage point.
The distances to eight of them are the cell of a block; by the triangle bound the cells' boundaries have
a width of zero there, and each fingerprint goes to its four cells. Cells above a limit are split by the
distances of the other bits in four parts in the same way. Inside a cell a vantage-point tree over whole
fingerprints prunes by the triangle bound; points within three bits of a node's boundary are searched
on both sides. Only links that connect each group leave a task.

Empty texts (and nulls, which count as empty) have fingerprint zero and link like any other. Repeated
rows share a fingerprint. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import cut, map_batches, whole_groups, whole_text
from speechtab.llm.components import components

BITS = 64
#: Differing bits of a link.
RADIUS = 3
SEED = 42
#: Fingerprints of a shard that is not split further, and of a leaf that is compared directly.
SHARD = 20_000
LEAF = 128
#: Vantage points of each block; eight distances tell nearly all values of 16 bits apart.
VANTAGE_POINTS = 8


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and the SimHash of the whole text over shingles of ``width`` words, as a signed long."""

    def step(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            found = np.zeros(batch.num_rows, np.uint64)
            for row, text in enumerate(batch["text"].to_pylist()):
                words = text.encode().lower().split()
                if not words:
                    continue
                parts = [w + b" " for w in words[:-1]] + [words[-1]]
                count = max(1, len(words) - width + 1)
                if width == 3 and count > 1:
                    shingles = (a + b + c for a, b, c in zip(parts, parts[1:], words[2:]))
                else:
                    shingles = (b" ".join(words[i:i + width]) for i in range(count))
                hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, count)
                ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                found[row:row + 1] = np.packbits(2 * ones > count).view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"]
            )

    return map_batches(
        docs.select("doc_id", whole_text().alias("text")), step, "doc_id long, fingerprint long"
    )


def link_documents(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    prints = cut(fingerprints(docs, width), "fingerprints")
    classes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")), "classes")
    # A fingerprint stands for its documents, which may all be without an id.
    joined = components(close_pairs(classes.select(F.col("fingerprint").alias("first_id"), "fingerprint")))
    grouped = cut(
        classes.join(joined, F.col("fingerprint") == F.col("node"), "left").select(
            "fingerprint", "smallest", F.coalesce("component", "fingerprint").alias("component")
        ),
        "grouped",
    )
    firsts = grouped.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = cut(grouped.join(firsts, "component").select("fingerprint", "component_id"), "named")
    return prints.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def close_pairs(classes: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between ``first_id`` that connect all ``fingerprint`` within the radius."""
    print_ = F.col("fingerprint")
    placed = classes.select("first_id", "fingerprint", F.explode(_cells(print_, 16)).alias("cell"))
    crowded = placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > shard).select(
        "cell", F.lit(True).alias("crowded")
    )  # four blocks have 4 * 65,536 cells at most
    # In a crowded cell of a block, one of four parts of the other 48 bits is equal.
    finer = F.coalesce(*[
        F.when(_block_of(F.col("cell")) == b, _cells(_without(print_, b), 12)) for b in range(4)
    ])
    cells = F.when(F.col("crowded"), finer).otherwise(F.array(F.lit(-1).cast("long")))
    spread = placed.join(crowded, "cell", "left").select(
        "first_id", "fingerprint",
        F.explode(F.transform(cells, lambda inner: F.xxhash64("cell", inner))).alias("shard"),
    )

    def step(batches):
        for rows in whole_groups(batches, "shard"):
            yield _links(rows)

    return map_batches(
        spread.repartition("shard").sortWithinPartitions("shard"), step, "a long, b long"
    )


def _without(print_: Column, block: int) -> Column:
    """The other 48 bits."""
    low = print_.bitwiseAND((1 << 16 * block) - 1) if block else F.lit(0).cast("long")
    high = F.shiftrightunsigned(print_, 16 * (block + 1)) if block < 3 else F.lit(0).cast("long")
    return F.shiftleft(high, 16 * block).bitwiseOR(low)


def _cells(bits: Column, width: int) -> Column:
    """For each of four blocks of ``width`` bits its number and its distances to the vantage points."""
    mask = (1 << width) - 1
    cells = []
    for block in range(4):
        value = F.shiftrightunsigned(bits, width * block).bitwiseAND(mask)
        cell = F.lit(block).cast("long")
        for j in range(1, VANTAGE_POINTS + 1):
            point = (j * 0x9E3779B97F4A7C15 >> 20) & mask
            cell = F.shiftleft(cell, 5).bitwiseOR(F.bit_count(value.bitwiseXOR(F.lit(point).cast("long"))).cast("long"))
        cells.append(cell)
    return F.array(*cells)


def _block_of(cell: Column) -> Column:
    return F.shiftright(cell, 5 * VANTAGE_POINTS)


def _links(rows: pa.Table) -> pa.RecordBatch:
    keys, ids = rows["shard"].to_numpy(), rows["first_id"].to_numpy()
    prints = rows["fingerprint"].to_numpy().view(np.uint64)
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(keys)]))
    small = ends - starts <= LEAF
    pairs = [_short_groups(prints, starts[small], ends[small])]
    for a, b in zip(starts[~small], ends[~small]):
        pairs += [np.stack([x, y]) + a for x, y in _search(prints[a:b], np.arange(b - a))]
    left, right = np.concatenate(pairs, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right])], names=["a", "b"])


def _short_groups(prints: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Links inside many small groups, all groups at once, by the distance in the row order."""
    sizes = ends - starts
    rows = np.arange(sizes.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    last = np.repeat(ends, sizes)
    found, step = [np.zeros((2, 0), np.int64)], 1
    while len(rows):
        inside = rows + step < last
        rows, last = rows[inside], last[inside]
        close = np.bitwise_count(prints[rows] ^ prints[rows + step]) <= RADIUS
        found.append(np.stack([rows[close], rows[close] + step]))
        step += 1
    return np.concatenate(found, axis=1)


def _search(prints: np.ndarray, at: np.ndarray):
    """Links that connect the close points among ``at``; a tree walked from node to leaf."""
    todo = [at]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            yield _spanning(prints[at], at)
            continue
        # The vantage point farthest from the first one separates clusters best.
        pick = at[np.argmax(np.bitwise_count(prints[at] ^ prints[at[0]]))]
        far = np.bitwise_count(prints[at] ^ prints[pick]).astype(np.int64)
        # The boundary with the fewest points near it; those go to both sides.
        count = np.bincount(far, minlength=BITS + 2)
        upto = np.cumsum(count)
        near = upto - np.concatenate(([0] * RADIUS, upto[:-RADIUS]))
        work = upto.astype(float) ** 2 + (len(at) - upto + near).astype(float) ** 2
        edge = int(np.argmin(work))
        inner, outer = at[far <= edge], at[far > edge - RADIUS]
        if work[edge] > 0.9 * float(len(at)) ** 2:
            yield from _direct(prints, at)
        else:
            todo += [inner, outer]


def _direct(prints: np.ndarray, at: np.ndarray):
    """Points that no boundary separates: each block of rows against all rows behind it."""
    for start in range(0, len(at), LEAF):
        own = at[start:start + LEAF]
        x, y = np.nonzero(np.bitwise_count(prints[own][:, None] ^ prints[at[start:]][None, :]) <= RADIUS)
        keep = x < y
        yield own[x[keep]], at[start:][y[keep]]


def _spanning(prints: np.ndarray, at: np.ndarray):
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= RADIUS
    label = np.arange(len(at))
    while True:
        least = np.where(close, label[None, :], len(at)).min(axis=1)
        least = np.minimum(label, least[least])
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(at)))
    return at[moved], at[label[moved]]
