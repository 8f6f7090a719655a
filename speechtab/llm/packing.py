"""Best-fit packing of token sequences with certified bin counts.

Documents are cut into pieces of at most ``capacity`` tokens. Whole pieces fill sequences of their own;
all others are dealt over partitions of a bounded number of pieces and packed there by best-fit
decreasing. Dual feasible functions give each partition a lower bound of its bins. A partition that
meets the bound is certified and closed. The others have gaps: they close their full bins, and the
pieces of their other bins are exchanged, dealt over other partitions, and packed again. The rounds end
when no exchange saves a bin, or after ``ROUNDS``.

The best packing so far is kept, so a round never costs bins. Only lengths and ids move, never tokens.

A null text counts as the empty one, which has the end token alone. Repeated rows
and rows with equal ``doc_id`` have pieces of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechtab.llm import tokens
from speechtab.llm.common import cut, map_batches, whole_text

CAPACITY = 1024
#: Pieces that one task packs.
PARTITION = 200_000
ROUNDS = 6


def split_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: number, doc_id, piece, start, length, ids_crc32.

    The first piece is the shorter one, the others are whole.
    """
    end = struct.pack("<I", end_id)

    def step(batches):
        encoder = tokens.byte_encoder(tokenizer)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encoder(text) + end
                size = len(ids) // 4
                edges = [0, *range(size % capacity or capacity, size + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((doc, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a:4 * b])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_batches(
        docs.select("doc_id", whole_text().alias("text")), step,
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    ).withColumn("number", F.monotonically_increasing_id())


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound among dual feasible functions: at least so many bins are needed.

    For each threshold t up to half: pieces above capacity - t count as whole bins, those below t not at
    all (Martello and Toth), and the rounding functions of k equal shares.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    for t in range(1, capacity // 2 + 1):
        big = int(counts[capacity - t + 1:].sum())
        middle = int((counts * sizes)[t:capacity - t + 1].sum())
        best = max(best, big + -(-middle // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        # The share is kept where it is a whole number, and rounded down otherwise.
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; bins that are open are found by the room that they have left."""
    bins = np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            waiting = by_room[room]
            chosen = waiting.pop()
            if not waiting:
                del by_room[room], rooms[at]
        else:
            room, chosen, made = capacity, made, made + 1
        bins[i] = chosen
        left = room - size
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(chosen)
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition: int = PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """``pieces``, a written table with a ``number`` each, with sequence_id and offset."""
    whole = pieces.filter(F.col("length") == capacity).select(
        "number", (-1 - F.col("number")).alias("sequence_id")
    )
    open_ = pieces.filter(F.col("length") < capacity).select("number", "length")
    closed, left, most = [], None, None
    for turn in range(rounds):
        parts = max(1, -(-open_.count() // partition))
        # Another deal in each round, whatever partition a piece came from.
        dealt = open_.repartition(parts, F.xxhash64("number", F.lit(turn)))
        packed = cut(
            map_batches(dealt, _packer(capacity, turn), "number long, length long, sequence_id long, closed boolean"),
            "packed",
        )
        used, spare = packed.agg(
            F.count_distinct("sequence_id"), F.count_distinct(F.when(~F.col("closed"), F.col("sequence_id")))
        ).first()
        if left is not None and used >= most:
            break  # the exchange saved nothing: what it was to better stays
        closed.append(packed.filter("closed"))
        left, most = packed.filter("NOT closed"), spare
        if not spare or parts == 1:
            break
        open_ = left.select("number", "length")
    placed = whole
    for some in [*closed, left]:
        placed = placed.unionByName(some.select("number", "sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.join(placed, "number").withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    )


def _packer(capacity: int, turn: int):
    """Packs what lies in a partition; sequences are numbered by round, partition and place."""

    def step(batches):
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        taken = pa.Table.from_batches(rows).sort_by("number")
        lengths = taken["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        # A partition at its bound is closed, and so is any full sequence; the others are exchanged.
        closed = fill == (fill if len(fill) == lower_bound(lengths, capacity) else capacity)
        first = (turn + 1 << 56) + (TaskContext.get().partitionId() << 32)
        yield from pa.table({
            "number": taken["number"], "length": taken["length"],
            "sequence_id": pa.array(first + bins), "closed": pa.array(closed[bins]),
        }).to_batches(max_chunksize=10_000)

    return step


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = cut(split_documents(docs, tokenizer, end_id, capacity), "pieces")
    return pack(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
