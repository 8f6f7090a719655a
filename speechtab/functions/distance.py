"""Unit-cost edit distance of two sequences, in bit vectors of table columns.

Common ends are trimmed. What is left goes through blocks of pattern symbols: a block's column is two integers
whose bits say where the distance rises or falls, and each symbol of the other side moves the whole
column in a dozen integer operations. The change along a block's last row is handed to the block below.
The cost is one operation for some thousand cells of the table, memory is linear, and the result is exact for all lengths.

Short pairs would spend their time on single operations, so those of a batch advance together: a block is then
64 symbols, a lane of an array, and each step moves a column of all lanes, a block one symbol behind the block above it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pattern symbols of a block.
BLOCK = 4096
#: Symbols beyond which a pair advances alone.
LONG = 1024
#: Lanes that advance together, and symbols that all of their patterns may share a table of.
LANES, ALPHABET = 4096, 256


def _trimmed(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    shorter = min(len(a), len(b))
    start = 0
    while start < shorter and a[start] == b[start]:
        start += 1
    end = 0
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[start:len(a) - end], b[start:len(b) - end]


def _block(pattern: Sequence, text: Sequence, above: list[int]) -> list[int]:
    """Change along the last row of a block for each text symbol, from that along the row above."""
    where: dict = {}
    for i, symbol in enumerate(pattern):
        where[symbol] = where.get(symbol, 0) | 1 << i
    mask, last = (1 << len(pattern)) - 1, len(pattern) - 1
    rises, falls, below = mask, 0, []
    for symbol, change in zip(text, above):
        equal = where.get(symbol, 0)
        vertical = equal | falls
        if change < 0:
            equal |= 1
        across = (((equal & rises) + rises) ^ rises) | equal
        up = falls | mask & ~(across | rises)
        down = rises & across
        below.append((up >> last & 1) - (down >> last & 1))
        up, down = up << 1 & mask | (change > 0), down << 1 & mask | (change < 0)
        rises = down | mask & ~(vertical | up)
        falls = up & vertical
    return below


def edit_distance(a: Sequence, b: Sequence) -> int:
    if a == b:
        return 0
    a, b = _trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    change = [1] * len(b)
    for start in range(0, len(a), BLOCK):
        change = _block(a[start:start + BLOCK], b, change)
    return len(a) + sum(change)


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts as numbers, one text behind the other, and the lengths."""
    whole = "".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(whole, np.uint32).astype(np.int64), pc.utf8_length(texts).to_numpy().astype(np.int64)


def _items(left: pa.ListArray, right: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for the items of lists; equal items have equal numbers on both sides."""
    flat = [x.flatten() for x in (left, right)]
    numbers = pa.concat_arrays(flat).dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    lengths = [pc.list_value_length(x).to_numpy().astype(np.int64) for x in (left, right)]
    return list(zip(np.split(numbers, [len(flat[0])]), lengths))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of spans of an array, one span behind the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def edit_distances(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]
) -> np.ndarray:
    """Distance of each pair of sequences; a side has the symbols of all its sequences and their lengths."""
    symbols = np.concatenate([left[0], right[0]])
    start = [np.cumsum(n) - n for _, n in (left, right)]
    start[1] += len(left[0])
    swap = left[1] > right[1]
    m, n = np.minimum(left[1], right[1]), np.maximum(left[1], right[1])
    pattern, text = np.where(swap, start[1], start[0]), np.where(swap, start[0], start[1])
    found = n.copy()
    for i in np.flatnonzero((n > LONG) & (m > 0)).tolist():
        found[i] = edit_distance(*(symbols[s:s + k].tolist() for s, k in ((pattern[i], m[i]), (text[i], n[i]))))
    open_ = np.flatnonzero((m > 0) & (n <= LONG))
    blocks = (m + 63) // 64
    open_ = open_[np.argsort(-(n + blocks)[open_], kind="stable")]
    if len(open_):
        for some in np.split(open_, np.flatnonzero(np.diff(np.cumsum(blocks[open_]) // LANES)) + 1):
            found[some] = _together(symbols, pattern[some], m[some], text[some], n[some])
    return found


def _local(symbols: np.ndarray, heard: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols of patterns and texts as numbers below a third; 0: not in the pattern."""
    number = np.zeros(max(int(symbols.max()), int(heard.max())) + 1, np.int64)
    number[symbols] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(1, len(used) + 1)
    symbols, heard, size = number[symbols], number[heard], len(used) + 1
    if size <= ALPHABET:
        return symbols, heard, size
    # Each pattern has its own numbers.
    pair = np.arange(len(m))
    inside, asked = symbols + np.repeat(pair, m) * size, heard + np.repeat(pair, n) * size
    keys, place = np.unique(inside, return_inverse=True)
    first = np.searchsorted(keys, pair * size)
    at = np.searchsorted(keys, asked)
    known = keys[np.minimum(at, len(keys) - 1)] == asked
    return (
        place - np.repeat(first, m) + 1, np.where(known, at - np.repeat(first, n) + 1, 0),
        int(np.diff(np.append(first, len(keys))).max()) + 1,
    )


def _together(
    symbols: np.ndarray, patterns: np.ndarray, m: np.ndarray, texts: np.ndarray, n: np.ndarray
) -> np.ndarray:
    """Distances of pairs that advance at once; no pattern is empty, and pairs that need more steps come first."""
    pattern, text, size = _local(symbols[_spans(patterns, m)], symbols[_spans(texts, n)], m, n)
    blocks = (m + 63) // 64
    # A pair's blocks are lanes side by side. A block below starts a step later and hears nothing before.
    ends = np.cumsum(blocks)
    first = np.repeat(ends - blocks, blocks)
    block = np.arange(ends[-1]) - first
    at = np.arange(len(pattern)) - np.repeat(np.cumsum(m) - m, m)
    where = np.zeros(ends[-1] * size, np.uint64)
    np.add.at(
        where, (np.repeat(ends - blocks, m) + at // 64) * size + pattern, np.uint64(1) << (at % 64).astype(np.uint64)
    )
    room = n + blocks
    begin = np.cumsum(room) - n
    heard = np.zeros(room.sum() + blocks.max(), np.int64)
    heard[np.arange(len(text)) + np.repeat(begin - (np.cumsum(n) - n), n)] = text
    place, row = np.repeat(begin, blocks) - block, np.arange(ends[-1]) * size
    last = (np.minimum(np.repeat(m, blocks) - block * 64, 64) - 1).astype(np.uint64)
    one, top = np.uint64(1), (block == 0).astype(np.uint64)
    below = one - top
    rises, falls, over, under = (np.full(ends[-1], x, np.uint64) for x in (~np.uint64(0), 0, 0, 0))
    total = np.zeros(ends[-1], np.int64)
    deep, steps = blocks.max() > 1, n + blocks - 1
    left = ends[len(m) - 1 - np.searchsorted(steps[::-1], np.arange(steps[0]), "right")]
    for step, k in enumerate(left.tolist()):
        if k < len(rises):
            rises, falls, over, under, top, below, last, row, place = (
                x[:k] for x in (rises, falls, over, under, top, below, last, row, place)
            )
        equal = where.take(heard.take(place + step) + row)
        above, under_above = top, None
        if deep:
            above, under_above = top.copy(), np.zeros(k, np.uint64)
            above[1:] |= over[:-1] & below[1:]
            under_above[1:] = under[:-1] & below[1:]
        vertical = equal | falls
        if deep:
            equal |= under_above
        across = (((equal & rises) + rises) ^ rises) | equal
        up, down = falls | ~(across | rises), rises & across
        over, under = up >> last & one, down >> last & one
        total[:k] += (over - under).view(np.int64)
        up <<= one
        up |= above
        down <<= one
        if deep:
            down |= under_above
        rises = down | ~(vertical | up)
        falls = up & vertical
    return m + total[ends - 1]


def _distances(left: pa.Array, right: pa.Array) -> pa.Array:
    """Distances of two columns of texts or of lists; to or from null they are null."""
    known = pc.and_(left.is_valid(), right.is_valid())
    places = np.flatnonzero(known.to_numpy(zero_copy_only=False))
    sides = [x.take(pa.array(places)) for x in (left, right)]
    words = pa.types.is_list(left.type)
    found = np.zeros(len(left), np.int32)
    if len(places):
        found[places] = edit_distances(*(_items(*sides) if words else map(_characters, sides)))
    return _masked(found, known)


def _masked(values: np.ndarray, known: pa.Array) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=~known.to_numpy(zero_copy_only=False))


@F.arrow_udf(T.IntegerType())
def string_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    return _distances(left, right)


@F.arrow_udf(T.IntegerType())
def array_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    return _distances(left, right)


#: Distances of a pair of texts and the reference's words; words at single spaces (macro) and white space (micro).
PAIR_FIELDS = tuple(T.StructField(n, T.IntegerType()) for n in (
    "word_errors_macro", "words_macro", "word_errors_micro", "words_micro", "char_errors",
))


def pair_distances(predictions: pa.Array, references: pa.Array) -> list[pa.Array]:
    """Columns in the order of ``PAIR_FIELDS``; distances to or from null are null."""
    heard, known = references.is_valid(), pc.and_(predictions.is_valid(), references.is_valid())
    texts = [x.fill_null("") for x in (predictions, references)]
    macro, chars = _items(*(pc.split_pattern(t, " ") for t in texts)), [_characters(t) for t in texts]
    # Without other white space the words are those that aren't empty.
    plain = all(not _OTHER_SPACE[c[c < len(_OTHER_SPACE)]].any() for c, _ in chars)
    if plain:
        empty = pa.concat_arrays([pc.split_pattern(t, " ").flatten() for t in texts])
        full = np.split(pc.not_equal(empty, "").to_numpy(zero_copy_only=False), [len(macro[0][0])])
        micro = [(x[f], _sums(f, n)) for (x, n), f in zip(macro, full)]
    else:
        micro = _items(*(pa.array([t.split() for t in side.to_pylist()], pa.list_(pa.string())) for side in texts))
    differ = np.flatnonzero(pc.not_equal(*texts).to_numpy(zero_copy_only=False))
    found = [_where(differ, sides) for sides in (macro, chars)]
    word_errors = found[0].copy()
    same = np.logical_and(*(a[1] == b[1] for a, b in zip(macro, micro))) if plain else np.zeros(len(word_errors), bool)
    other = differ[~same[differ]]
    word_errors[other] = _where(other, micro)[other]
    return [_masked(*x) for x in (
        (found[0], known), (macro[1][1], heard), (word_errors, known), (micro[1][1], heard), (found[1], known),
    )]


#: White space besides the space, for ``str.split``.
_OTHER_SPACE = np.array([chr(c).isspace() and c != 32 for c in range(0x3001)])


def _sums(flags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(flags)))
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]


def _where(places: np.ndarray, sides: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distances of the pairs at these places, zero for the others."""
    found = np.zeros(len(sides[0][1]), np.int64)
    if len(places):
        found[places] = edit_distances(*(
            (x[_spans((np.cumsum(n) - n)[places], n[places])], n[places]) for x, n in sides
        ))
    return found
