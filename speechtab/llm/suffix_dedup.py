"""Suffix-array dedup of repeated byte strings across documents.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts in a document with a smaller id.
Every such string (window) belongs to the bucket of the smallest hash among its grams, which is a
function of its bytes alone, so equal windows meet. Consecutive windows of one bucket are a segment.

1. Buckets are aggregated: those of one document only can hold no repeat, in those with a single
   segment every document but the first loses it whole. The others are mixed. Each task aggregates what it has
   read, and sends it by parts of the buckets as packed arrays.
2. The distinct segments of each mixed bucket are suffix sorted, from each window's start to the
   windows' width, by deep-shallow sorting: multikey quicksort, eight bytes at a time, to a shallow
   depth, then blind tries order the groups that still have a common prefix. Neighbours that are equal
   are one string, and the smallest id among them owns it. Buckets of many segments don't go to one
   task: their segments are cut where windows lie differently about the least gram, and the pieces are dealt
   by the bytes that all of their windows share. In the largest buckets a piece is a single window.
3. Each document joins its segments with the owners, and the covered bytes go.

The segments of a document are found anew in each pass instead of being moved. Passes after the first
leave out what bit maps rule out; those have some bits for each key and let few others through, which
the joins then drop. Keys too many for maps that fit in memory are taken in rounds, part by part. Passages in very
many documents are aggregated before the shuffle.

A null text counts as the empty one. Documents below ``WIDTH`` bytes lose nothing, nor do rows with a
null id. Rows with equal ids don't remove from each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtab.llm.common import cut, discard, map_batches, release, whole_groups, whole_text

WIDTH = 50
#: Bytes of a gram; a window has ``WIDTH - GRAM + 1`` of them.
GRAM = 24
#: Windows of a segment at most; their marks fill a long.
SEGMENT = 32
SHALLOW = 24
#: Segments of a bucket, counted once a document, beyond which they are cut into pieces.
CROWDED = 2_000
#: And beyond which each of their windows is a piece.
TEEMING = 100_000
#: Windows of a piece at most.
PIECE = 9
#: Bits of a bit map for each key at least, more where what it lets through carries bytes.
KEY_BITS, MIXED_BITS = 6, 24
#: log2 of the bits of a bit map at most: 128 MiB. More keys are taken in rounds.
MAP_BITS = 30
#: Segments that a task holds in its first pass before it sends them.
HELD = 1 << 19
#: Parts of the buckets at least, and log2 of the bytes of text whose segments come to one, about.
PARTS, PART_BITS = 256, 25

_A, _B, _C, _D = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_C), -1, 1 << 64))
    return tuple(
        np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (_C, inverse)
    )


def _grams(text: bytes) -> np.ndarray:
    """Hashes of a text's grams."""
    words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    grams = len(text) - GRAM + 1
    x = words[:grams] * _A + (words[8:8 + grams] ^ _D) * _B + words[16:16 + grams] * _C
    x ^= x >> np.uint64(32)
    x *= _D
    x ^= x >> np.uint64(29)
    return x


def segments(text: bytes):
    """First windows, numbers of windows, buckets and content hashes of a text's segments."""
    windows = len(text) - WIDTH + 1
    if windows < 1:
        return np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
    x = _grams(text)
    grams = len(x)
    least, span, need = x, 1, WIDTH - GRAM + 1
    while 2 * span <= need:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[:windows], least[need - span:need - span + windows])
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    sizes = np.diff(np.append(starts, windows))
    if sizes.max() > SEGMENT:
        parts = -(-sizes // SEGMENT)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + within * SEGMENT
        sizes = np.diff(np.append(starts, windows))
    up, down = _powers(1 << max(16, grams.bit_length()))
    total = np.concatenate(([np.uint64(0)], np.cumsum(x * up[:grams])))
    content = (total[starts + sizes + need - 1] - total[starts]) * down[starts] + sizes.astype(np.uint64) * _B
    content ^= content >> np.uint64(31)
    return np.stack([starts, sizes]), np.stack([least[starts].view(np.int64), (content * _A).view(np.int64)])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", whole_text().alias("text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return _removed(docs, [F.col("doc_id")], with_text=False).select(
        F.col("kept_0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with all their columns; ``text`` without what was removed, ``n_chars`` counted anew.

    A character that lost some of its bytes goes as a whole.
    """
    own = {"text": F.col("text").isNull()}  # the text itself comes back as kept_text
    done = _removed(docs, [own.get(c, F.col(f"`{c}`")) for c in docs.columns], with_text=True)
    lost = F.col("n_removed") > 0
    columns = []
    for i, c in enumerate(docs.columns):
        column = F.col(f"kept_{i}")
        if c == "text":
            column = F.when(~column, F.col("kept_text"))
        elif c == "n_chars":
            column = F.when(lost, F.length("kept_text")).otherwise(column).cast(docs.schema[c].dataType)
        columns.append(column.alias(c))
    return done.select(*columns)


def _removed(docs: DataFrame, kept: list[Column], with_text: bool) -> DataFrame:
    """``kept`` as kept_0, kept_1 and so on, the counts and, ``with_text``, what is left of the text."""
    lists = find_repeats(docs)
    carried = [f"kept_{i}" for i in range(len(kept))]
    joined = docs.select(
        F.col("doc_id").alias("id"), whole_text().alias("text"), *[c.alias(n) for c, n in zip(kept, carried)]
    ).join(lists, "id", "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in carried)

    def step(batches):
        for batch in batches:
            out, texts = [], []
            bounds = batch["contents"].offsets.to_pylist()
            contents, masks = (batch[c].values.to_numpy() for c in ("contents", "masks"))
            for data, i, j in zip(_bytes(batch), bounds, bounds[1:]):
                removed = _covered(data, contents[i:j], masks[i:j]) if i < j else np.zeros(len(data), bool)
                rest = np.frombuffer(data, np.uint8)[~removed].tobytes() if removed.any() else data
                spans = int(np.count_nonzero(removed[1:] & ~removed[:-1]) + (len(removed) > 0 and removed[0]))
                out.append((len(data), int(removed.sum()), spans, hashlib.sha256(rest).hexdigest()))
                if with_text:
                    texts.append(rest.decode(errors="ignore"))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in carried), *(pa.array(c, k) for c, k in zip(columns, kinds)),
                    *([pa.array(texts, pa.string())] if with_text else []),
                ],
                names=[*carried, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])],
            )

    return map_batches(
        joined, step,
        f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text,
    )


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch["text"].cast(pa.binary()).to_pylist()


def _covered(data: bytes, contents: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Bytes of a text that lie in a marked window."""
    order = np.argsort(contents)
    contents = contents[order]
    fresh = np.flatnonzero(np.append(True, contents[1:] != contents[:-1]))
    contents, masks = contents[fresh], np.bitwise_or.reduceat(masks[order], fresh)
    (starts, sizes), keys = segments(data)
    at = np.minimum(np.searchsorted(contents, keys[1]), len(contents) - 1)
    found = np.flatnonzero(contents[at] == keys[1])
    place = np.arange(SEGMENT)
    segment, within = np.nonzero((masks[at[found], None] >> place & 1).astype(bool) & (place < sizes[found, None]))
    windows = starts[found[segment]] + within  # each once, as no two segments share a window
    change = np.zeros(len(data) + 1, np.int32)
    change[windows] += 1
    change[windows + WIDTH] -= 1
    return np.cumsum(change[:-1]) > 0


def find_repeats(docs: DataFrame) -> DataFrame:
    """(id, contents, masks) of documents: which windows of a segment start in an earlier one as well."""
    texts = _texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(PARTS, size >> PART_BITS)

    def outline(batches):
        rows, held = [], 0
        for batch in batches:
            for doc, data in zip(batch["doc_id"].to_pylist(), _bytes(batch)):
                if doc is not None:
                    _, keys = segments(data)
                    rows.append((np.full(keys.shape[1], doc), *keys))
                    held += keys.shape[1]
            if held >= HELD:
                columns = [np.concatenate(c) for c in zip(*rows)]
                rows, held = [], 0
                yield _packed(*columns, n_parts)
        if held:
            yield _packed(*(np.concatenate(c) for c in zip(*rows)), n_parts)

    outlined = map_batches(texts, outline, _PACKED)
    shared = cut(
        map_batches(
            outlined.repartition("part").sortWithinPartitions("part"),
            partial(_shared, limits=(CROWDED, TEEMING), n_parts=n_parts),
            "key long, owner long, mixed boolean, crowd int, part int",
        ),
        "shared",
    )
    tally = shared.agg(*[F.count_if(F.expr(m)).alias(k) for k, m in _KINDS.items()]).first().asDict()
    wanted = {k: n * (KEY_BITS if k == "plain" else MIXED_BITS) for k, n in tally.items()}
    rounds = max(1, -(-max(wanted.values()) >> MAP_BITS))
    marks = []
    for i in range(rounds):
        share = {k: -(-n // rounds) for k, n in wanted.items()}
        marks += _marks(texts, shared.filter(f"part % {rounds} = {i}"), share, n_parts, rounds, i)
    discard(shared)
    lists = cut(
        reduce(DataFrame.unionByName, marks).groupBy(F.col("doc_id").alias("id")).agg(
            F.collect_list("content").alias("contents"), F.collect_list("mask").alias("masks")
        ),
        "marks",
    )
    discard(*marks)
    return lists


#: Keys with a bit map each: of single-content buckets their content, of mixed and of large ones the bucket.
_KINDS = {
    "plain": "NOT mixed", "mixed": "mixed", "many": "mixed IS NULL", "crowded": "mixed AND crowd > 0",
    "teeming": "mixed AND crowd > 1",
}
_PACKED = (
    "part int, n int, first long, least long, buckets binary, owners binary, contents binary, counts binary, "
    "lasts binary, others binary"
)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, as far as any number has them; they compress well."""
    return x.view(np.uint8).reshape(-1, 8)[:, :(int(x.max(initial=0)).bit_length() + 7) // 8].T.tobytes()


def _numbers(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if planes:
        out[:, :len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
    return out.view(np.uint64)[:, 0]


def _part(mixed_up: np.ndarray, n_parts: int) -> np.ndarray:
    """The parts of buckets, which ascend with these; a bucket itself is a minimum, so it is multiplied by ``_B`` first."""
    return ((mixed_up >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)


def _packed(doc: np.ndarray, bucket: np.ndarray, content: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """A row for each part: its buckets, their first and last documents and contents, and how many segments they have."""
    bucket = bucket.view(np.uint64) * _B
    order = np.argsort(bucket)
    again = bucket[order[1:]] == bucket[order[:-1]]
    several = np.flatnonzero(np.append(again, False) | np.append(False, again))
    some = order[several]
    order[several] = some[np.lexsort((content[some], doc[some], bucket[some]))]
    # A segment counts once a document.
    order = order[np.append(True, np.any([x[order[1:]] != x[order[:-1]] for x in (bucket, doc, content)], axis=0))]
    bucket, owner, last, low, high, count = _by_bucket(
        order, bucket, doc, doc, content, content, np.ones(len(doc), np.int64)
    )
    part = _part(bucket, n_parts)
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    rows = []
    for i, j in zip(edges, edges[1:]):
        least = owner[i:j].min()
        more = np.flatnonzero(count[i:j] > 1) + i
        rows.append((
            int(part[i]), j - i, bucket[i].view(np.int64), least, _planes(np.diff(bucket[i:j], prepend=bucket[i])),
            _planes((owner[i:j] - least).view(np.uint64)), _planes(low[i:j].view(np.uint64)),
            _planes((count[i:j] - 1).view(np.uint64)), _planes((last[more] - owner[more]).view(np.uint64)),
            _planes((high[more] - low[more]).view(np.uint64)),
        ))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _PACKED.split(", ")]
    )


def _by_bucket(order, bucket, owner, last, low, high, count) -> tuple[np.ndarray, ...]:
    """One entry for each bucket; ``order`` sorts them."""
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    kinds = ((owner, np.minimum), (last, np.maximum), (low, np.minimum), (high, np.maximum), (count, np.add))
    return bucket[first], *(kind.reduceat(x[order], first) for x, kind in kinds)


def _shared(batches, limits: tuple[int, int], n_parts: int):
    """The buckets of more than one document, from packed rows; large ones of a single content also by themselves."""
    inverse = np.uint64(pow(int(_B), -1, 1 << 64))
    for rows in whole_groups(batches, "part", 1):
        found = []
        for row in rows.to_pylist():
            n = row["n"]
            bucket = np.cumsum(_numbers(row["buckets"], n), dtype=np.uint64) + np.int64(row["first"]).view(np.uint64)
            owner = _numbers(row["owners"], n).view(np.int64) + row["least"]
            low = _numbers(row["contents"], n).view(np.int64)
            count = _numbers(row["counts"], n).view(np.int64) + 1
            last, high, more = owner.copy(), low.copy(), np.flatnonzero(count > 1)
            last[more] += _numbers(row["lasts"], len(more)).view(np.int64)
            high[more] += _numbers(row["others"], len(more)).view(np.int64)
            found.append((bucket, owner, last, low, high, count))
        columns = [np.concatenate(c) for c in zip(*found)]
        del found, rows
        bucket, owner, last, low, high, count = _by_bucket(np.argsort(columns[0]), *columns)
        del columns
        take = np.flatnonzero(owner < last)
        bucket, owner, low, high, count = (c[take] for c in (bucket, owner, low, high, count))
        mixed, crowd = low != high, sum((count > x).astype(np.int32) for x in limits)
        many = np.flatnonzero(~mixed & (crowd > 0))
        part, itself = _part(bucket, n_parts), (bucket * inverse).view(np.int64)
        both = lambda x: np.append(x, x[many])
        yield pa.RecordBatch.from_arrays(
            [
                # The only segment of a bucket stands for it.
                pa.array(np.append(np.where(mixed, itself, low), itself[many])), pa.array(both(owner)),
                pa.array(both(mixed), mask=np.arange(len(mixed) + len(many)) >= len(mixed)), pa.array(both(crowd)),
                pa.array(both(part)),
            ],
            names=["key", "owner", "mixed", "crowd", "part"],
        )


def _marks(texts: DataFrame, shared: DataFrame, wanted: dict[str, int], n_parts: int, rounds: int, turn: int) -> list[DataFrame]:
    """doc_id, content and mask of repeated segments in the parts of one round."""
    sent = texts.sparkSession.sparkContext.broadcast(
        {k: _bit_map(shared.filter(m), wanted[k]) for k, m in _KINDS.items()}
    )
    release(texts.sparkSession)  # what the first pass shuffled goes before the second one writes

    def members(batches):
        maps = {k: np.frombuffer(m, np.uint8) for k, m in sent.value.items()}
        for batch in batches:
            rows = [
                (doc, data, *segments(data))
                for doc, data in zip(batch["doc_id"].to_pylist(), _bytes(batch)) if doc is not None
            ]
            if not rows:
                continue
            row = np.repeat(np.arange(len(rows)), [r[2].shape[1] for r in rows])
            (start, size), (bucket, content) = (np.concatenate([r[k] for r in rows], axis=1) for k in (2, 3))
            asked = np.arange(len(row))
            if rounds > 1:
                asked = np.flatnonzero(_part(bucket.view(np.uint64) * _B, n_parts) % rounds == turn)
            plain, mixed = _among(maps["plain"], content[asked]), _among(maps["mixed"], bucket[asked])
            take, more = asked[plain | mixed], mixed[plain | mixed]
            order = np.lexsort((content[take], row[take]))
            take, more = take[order], more[order]
            once = np.append(True, (np.diff(row[take]) != 0) | (np.diff(content[take]) != 0))[:len(take)]
            take, more = take[once], more[once]
            row, start, end, bucket, content = (
                x[take] for x in (row, start, start + size + WIDTH - 1, bucket, content)
            )
            teeming = _among(maps["teeming"], bucket)
            # The map of the mixed ones may let a segment of very many documents through. All of a bucket go one way.
            crowd = (teeming | _among(maps["crowded"], bucket) | _among(maps["many"], bucket)).astype(np.int32) + teeming
            cuts = [
                rows[r][1][i:j] if m else None
                for r, i, j, m in zip(row.tolist(), start.tolist(), end.tolist(), more.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()).take(pa.array(row)), pa.array(content),
                    pa.array(bucket, mask=~more), pa.array(cuts, pa.binary()), pa.array(np.where(more, crowd, 0)),
                ],
                names=["doc_id", "content", "bucket", "bytes", "crowd"],
            )

    found = cut(
        map_batches(texts, members, "doc_id long, content long, bucket long, bytes binary, crowd int"), "members"
    )
    sent.destroy()
    whole = cut(
        found.join(shared.filter("NOT mixed").select(F.col("key").alias("content"), "owner"), "content").filter(
            "doc_id > owner"
        ).select("doc_id", "content", F.lit(-1).cast("long").alias("mask")),
        "whole",
    )
    mixed = found.filter("bytes IS NOT NULL")
    least = [F.min("doc_id").alias("owner"), F.min("bytes").alias("bytes")]
    # Dealt by bucket at once, as few rows of such a bucket are equal; those of the others meet before they are dealt.
    distinct = mixed.filter("crowd = 0").repartition("bucket").groupBy("bucket", "content").agg(*least)
    crowded, teeming = (
        mixed.filter(m).groupBy("bucket", "content").agg(*least) for m in ("crowd = 1", "crowd > 1")
    )
    sorted_ = map_batches(
        distinct.sortWithinPartitions("bucket", "content"), _own_windows, "content long, owners array<long>"
    )
    owners = cut(sorted_.unionByName(_owners_of_pieces(crowded, teeming)), "owners")
    earlier = F.aggregate(
        F.sequence(F.lit(0), F.size("owners") - 1), F.lit(0).cast("long"),
        lambda mask, i: F.when(
            F.get("owners", i) < F.col("doc_id"), mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))
        ).otherwise(mask),
    )
    parts = cut(
        mixed.join(owners, "content").select("doc_id", "content", earlier.alias("mask")).filter("mask <> 0"), "parts"
    )
    discard(found, owners)
    return [whole, parts]


def _spots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each key in a map of 2^bits bits."""
    x = keys.view(np.uint64)
    return tuple((x * odd >> np.uint64(64 - bits)).astype(np.int64) for odd in (_C, _D))


def _among(bit_map: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a map has; of others it has few."""
    out = np.ones(len(keys), bool)
    for spots in _spots(keys, len(bit_map).bit_length() + 2):
        out &= (bit_map[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _bit_map(keys: DataFrame, wanted: int) -> bytes:
    """Two bits for each key, among at least as many as are wanted."""
    bits = max(9, (wanted - 1).bit_length())
    size = 1 << bits - 6  # bits of one of 64 parts

    def deal(batches):
        held: list[np.ndarray] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch["key"].to_numpy())
            if held and (batch is None or sum(map(len, held)) >= HELD):
                spots = np.sort(np.concatenate(_spots(np.concatenate(held), bits)))
                edges = np.searchsorted(spots, np.arange(65) * size).tolist()
                inside = (spots % size).astype(np.uint32)
                cuts = [inside[i:j].tobytes() for i, j in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(cuts)], names=["part", "spots"])
                held = []

    def step(batches):
        for rows in whole_groups(batches, "part", 1):
            made: dict[int, np.ndarray] = {}
            for part, spots in zip(rows["part"].to_pylist(), rows["spots"].to_pylist()):
                made.setdefault(part, np.zeros(size, bool))[np.frombuffer(spots, np.uint32)] = True
            bits_ = [np.packbits(x, bitorder="little").tobytes() for x in made.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array(bits_)], names=["part", "bits"])

    if not wanted:
        return bytes(1 << bits - 3)
    dealt = map_batches(keys.select("key"), deal, "part int, spots binary").repartition("part").sortWithinPartitions("part")
    made = dict.fromkeys(range(64), bytes(size >> 3)) | {row["part"]: row["bits"] for row in map_batches(dealt, step, "part int, bits binary").collect()}
    return b"".join(made[k] for k in range(64))


def _own_windows(batches):
    """For each distinct segment the smallest id that owns each of its windows."""
    for rows in whole_groups(batches, "bucket", 20_000):
        parts = rows["bytes"].to_pylist()
        owner, bucket = rows["owner"].to_numpy(), rows["bucket"].to_numpy()
        sizes = np.array([len(p) for p in parts], np.int64)
        first = np.cumsum(sizes) - sizes
        counts = sizes - WIDTH + 1
        segment = np.repeat(np.arange(len(parts)), counts)
        starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[segment]
        group = np.concatenate(([0], np.cumsum(np.diff(bucket) != 0)))[segment]
        order, fresh = suffix_sort(b"".join(parts), starts, group)
        least = np.minimum.reduceat(owner[segment[order]], np.flatnonzero(fresh))
        owners = np.empty(len(order), np.int64)
        owners[order] = least[np.cumsum(fresh) - 1]
        ends = np.concatenate(([0], np.cumsum(counts)))
        named = [c for c in ("content", "at") if c in rows.column_names]
        yield pa.RecordBatch.from_arrays(
            [
                *(rows[c].combine_chunks() for c in named),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(owners)),
            ],
            names=[*named, "owners"],
        )


def _pieces(batches, windows: int):
    """Segments cut into pieces of at most so many windows; ``at`` is a piece's first window.

    A window's kind is how far its first gram of the bucket's hash lies from its start, in steps of the piece. Equal
    windows have equal kinds and the same ``shared`` bytes, which lie about the gram in all windows of the kind.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch["bytes"].to_pylist()
        text = b"".join(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        first, counts = ends - sizes, sizes - WIDTH + 1
        hashes = _grams(text).view(np.int64)
        row = np.repeat(np.arange(len(parts)), sizes)[:len(hashes)]
        inside = np.arange(len(hashes)) + GRAM <= ends[row]
        grams = np.flatnonzero(inside & (hashes == batch["bucket"].to_numpy()[row]))
        segment = np.repeat(np.arange(len(parts)), counts)
        start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[segment]
        gram = grams[np.searchsorted(grams, start)]
        kind = (gram - start) // windows
        edges = np.flatnonzero((np.diff(segment) != 0) | (np.diff(gram) != 0) | (np.diff(kind) != 0)) + 1
        begin, end = np.append(0, edges), np.append(edges, len(start)) - 1
        gram, kind, segment = gram[begin], kind[begin], segment[begin]
        near = gram - kind * windows
        far = near + WIDTH - windows + 1
        cuts = lambda a, b: pa.array([text[i:j] for i, j in zip(a.tolist(), b.tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                batch["content"].take(pa.array(segment)), pa.array(start[begin] - first[segment]),
                batch["owner"].take(pa.array(segment)), pa.array(kind), cuts(near, far), cuts(start[begin], start[end] + WIDTH),
            ],
            names=["content", "at", "owner", "kind", "shared", "bytes"],
        )


def _owners_of_pieces(crowded: DataFrame, teeming: DataFrame) -> DataFrame:
    """The same for crowded buckets; no segment becomes more rows than it has pieces, and no window is joined."""
    made = "content long, at long, owner long, kind long, shared binary, bytes binary"
    pieces, single = (
        map_batches(x, lambda batches, n=n: _pieces(batches, n), made) for x, n in ((crowded, PIECE), (teeming, 1))
    )
    dealt = pieces.select("content", "at", "owner", "bytes", F.xxhash64("kind", "shared").alias("bucket"))
    several = map_batches(
        dealt.repartition("bucket").sortWithinPartitions("bucket"), _own_windows, "content long, at long, owners array<long>"
    )
    one = single.select("content", "at", F.array(F.min("owner").over(Window.partitionBy("bytes"))).alias("owners"))
    found = several.unionByName(one).groupBy("content").agg(
        F.array_sort(F.collect_list(F.struct("at", "owners"))).alias("owners")  # ``SEGMENT`` windows at most
    )
    return found.select("content", F.flatten("owners.owners").alias("owners"))


def suffix_sort(text: bytes, starts: np.ndarray, group: np.ndarray, width: int = WIDTH, shallow: int = SHALLOW):
    """Order of the suffixes at ``starts`` by group and their first ``width`` bytes, and where a new
    string begins in that order. Every suffix has ``width`` bytes; ``shallow`` is a multiple of eight.
    """
    words = np.ndarray(len(text) - 7, ">u8", text, strides=(1,))
    order = np.arange(len(starts))
    fresh = np.zeros(len(starts), bool)
    fresh[0] = True
    kind = group
    for depth in range(0, shallow, 8):
        # Only suffixes that share all bytes so far with another one are still to be ordered.
        alone = fresh & np.append(fresh[1:], True)
        slots = np.flatnonzero(~alone) if depth else np.arange(len(order))
        some = order[slots]
        key = words[starts[some] + depth].astype(np.uint64)
        sorted_ = np.lexsort((key, kind[some]))
        some, key = some[sorted_], key[sorted_]
        order[slots] = some
        fresh[slots[1:]] |= (key[1:] != key[:-1]) | (kind[some[1:]] != kind[some[:-1]])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(fresh)
    edges = np.append(np.flatnonzero(fresh), len(order))
    for a, b in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist()):
        block = order[a:b].copy()
        tails = [text[s + shallow:s + width] for s in starts[block].tolist()]
        at = a
        for equal in blind_trie(tails):
            order[at:at + len(equal)] = block[equal]
            fresh[at] = True
            at += len(equal)
    return order, fresh


def blind_trie(tails: list[bytes]) -> list[list[int]]:
    """Positions of equal strings together, in the order of the strings (of one length).

    A branch knows the byte at which its strings part, a leaf the places of one string. A string goes
    down without being compared, is compared once with the leaf it reaches, and branches off where they
    part.
    """
    size = len(tails[0])
    root: list = [tails[0], int.from_bytes(tails[0], "big"), [0]]  # a leaf: string, number, places
    for place in range(1, len(tails)):
        tail = tails[place]
        node = root
        while len(node) == 2:  # a branch: byte, children
            node = node[1].get(tail[node[0]]) or next(iter(node[1].values()))
        number = int.from_bytes(tail, "big")
        part = number ^ node[1]
        if not part:
            node[2].append(place)
            continue
        byte, other = size - (part.bit_length() + 7) // 8, node[0]
        above, node = None, root
        while len(node) == 2 and node[0] < byte:
            above, node = node, node[1][tail[node[0]]]
        leaf = [tail, number, [place]]
        if len(node) == 2 and node[0] == byte:
            node[1][tail[byte]] = leaf
            continue
        branch = [byte, {other[byte]: node, tail[byte]: leaf}]
        if above is None:
            root = branch
        else:
            above[1][tail[above[0]]] = branch
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if len(node) == 2:
            todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            found.append(node[2])
    return found
