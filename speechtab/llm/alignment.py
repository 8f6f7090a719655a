"""Alignment of two tokenizers' ids over the same bytes.

Tokenizer A is a byte-level file of the tokenizers library, B a sentencepiece model that puts a space before
a text; both see the text with a space before it. Where a token of A and one of B end at the same byte a group
ends. Two tokens are linked where their bytes overlap. Counts of linked ids come in two ways:

* The identity map names for each id of A the id of B with the same bytes. A group of one token on each side
  that are so mapped is counted in a vector as long as A's vocabulary, one for each task.
* Links of all other groups are added up by (A id, B id) inside a block of documents; only these sums are
  shuffled.

The counts of all pairs go back to the blocks that hold them; the counts of mapped pairs are a vector again,
as long as the vocabulary whatever the corpus, and are broadcast. So no link travels on its own.

A null or empty text has no tokens, and neither has one whose bytes A or B doesn't give back (it holds U+2581,
which B reads as a space). Their counts are zero. Repeated rows keep a row each and count each; a null doc_id
is kept. An empty table gives no rows. Other columns are ignored.

No token of A or B lies across a space between other characters, so no group does. A text is cut there; each
distinct chunk is encoded and aligned once while its worker remembers it, and a text is its chunks in a row. A
text with white space at its ends or in a row is one chunk. Of a long one B encodes parts, cut in the same way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import cut, map_batches
from speechtab.llm.tokens import SPACES, ChunkEncoder, byte_characters

#: Characters of a text that B encodes at a time.
PART = 1 << 15
#: Links of a block, after which the next document starts another.
BLOCK_LINKS = 1 << 25

#: Chunks that A encodes at a time.
RUN = 1_000
#: Characters of the chunks that a worker remembers, with ``ROOM`` more for each; beyond it the memory starts anew.
REMEMBERED = 10_000_000
ROOM = 16

_ENDS_IN_SPACE = re.compile(f"[{SPACES}]\\Z")
_CUT = re.compile(r"(?<=[^ ])(?= .)", re.DOTALL)


class Vocabularies(NamedTuple):
    #: Ids of texts with a space before each; A's in a row.
    encode_a: Callable[[list[str]], np.ndarray]
    encode_chunks_a: Callable[[list[str]], np.ndarray]
    encode_b: Callable[[str], list[int]]
    encode_all_b: Callable[[list[str]], list[list[int]]]
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    #: For each id of A the id of B with the same bytes, or -1.
    same: np.ndarray

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A pair of ids as one number."""
        return a.astype(np.int64) * len(self.bytes_b) + b

    def pair_type(self) -> str:
        return "int" if len(self.bytes_a) * len(self.bytes_b) < 1 << 31 else "long"


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from array import array

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True  # their strings are plain text
    written = byte_characters()
    plain = {c: n for n, c in written.items()}
    bytes_a = [b""] * a.get_vocab_size(with_added_tokens=True)
    for token, number in a.get_vocab(with_added_tokens=True).items():
        bytes_a[number] = bytes(plain[c] for c in token) if all(c in plain for c in token) else token.encode()
    bytes_b = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
        else b.id_to_piece(i).replace("▁", " ").encode()
        for i in range(b.get_piece_size())
    ]
    by_bytes = {}
    for number in range(len(bytes_b) - 1, -1, -1):
        if not b.is_byte(number) or bytes_b[number] not in by_bytes:
            by_bytes[bytes_b[number]] = number

    def encode(chunk: str) -> bytes:
        return array("I", a.encode(chunk, add_special_tokens=False).ids).tobytes()

    encoder = ChunkEncoder(encode, encode, spaces_matter=True)

    def encode_a(texts: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join([encoder(" " + t) for t in texts if t]), np.uint32).astype(np.int64)

    def encode_chunks_a(chunks: list[str]) -> np.ndarray:
        runs = [" " + " ".join(chunks[i:i + RUN]) for i in range(0, len(chunks), RUN)]
        return np.array([i for e in a.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], np.int64)

    def encode_all_b(texts: list[str]) -> list[list[int]]:
        if max(map(len, texts), default=0) <= PART:
            return b.encode(texts, num_threads=1)
        # B puts a space before each part, so a part goes without its own.
        split = [_parts(t) for t in texts]
        ids = iter(b.encode([p if not i else p[1:] for parts in split for i, p in enumerate(parts)], num_threads=1))
        return [next(ids) if len(parts) == 1 else [i for _ in parts for i in next(ids)] for parts in split]

    def encode_b(text: str) -> list[int]:
        return encode_all_b([text])[0]

    same = np.array([by_bytes.get(t, -1) for t in bytes_a], np.int64)
    return Vocabularies(encode_a, encode_chunks_a, encode_b, encode_all_b, bytes_a, bytes_b, same)


def _parts(text: str) -> list[str]:
    """Parts of a text that each but the first start at a space behind another character."""
    parts, start = [], 0
    while len(text) - start > PART:
        found = _CUT.search(text, start + PART)
        if not found:
            break
        parts.append(text[start:found.start()])
        start = found.start()
    return [*parts, text[start:]]


class Aligned(NamedTuple):
    """Tokens and links of texts side by side."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    #: What each text's digest is of.
    listed: list[bytes]
    #: Whether both sides give a text back; it has no tokens otherwise.
    whole: np.ndarray
    #: For each link its text, its pair and whether the identity map has it as a group of its own.
    text: np.ndarray
    pair: np.ndarray
    mapped: np.ndarray


@lru_cache(maxsize=2)
def _written(sizes: tuple[int, int]) -> np.ndarray:
    """Each id of A, then of B, with the sign that follows it inside a group, then at its end."""
    a, b = sizes
    signs = [(range(a), ","), (range(a), "|"), (range(b), ","), (range(b), ";")]
    return np.array([f"{i}{sign}".encode() for ids, sign in signs for i in ids], "S")


def _joined(tokens: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def align(vocabulary: Vocabularies, texts: list[str], chunks: bool = False) -> Aligned:
    """Each text with a space before it; an empty one has no tokens. ``chunks``: no token of A lies across two texts."""
    spaced = [(" " + t).encode() if t else b"" for t in texts]
    expected, stops = b"".join(spaced), np.cumsum(np.fromiter(map(len, spaced), np.int64, len(texts)))
    lists_b = vocabulary.encode_all_b(texts)
    sizes_b = np.fromiter(map(len, lists_b), np.int64, len(texts))
    b = np.fromiter(chain.from_iterable(lists_b), np.int64)
    a = vocabulary.encode_chunks_a(texts) if chunks else vocabulary.encode_a(texts)
    length_a, length_b = (np.fromiter(map(len, side), np.int64) for side in (vocabulary.bytes_a, vocabulary.bytes_b))
    ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    # Where A gives all bytes back its tokens are told apart by where texts end.
    sizes_a = np.diff(np.searchsorted(ends_a, stops, "right"), prepend=0)
    found_a, found_b = _joined(vocabulary.bytes_a, a.tolist()), _joined(vocabulary.bytes_b, b.tolist())
    whole = np.ones(len(texts), bool)
    stops_a, stops_b = (np.append(0, ends)[np.cumsum(n)] for ends, n in ((ends_a, sizes_a), (ends_b, sizes_b)))
    if found_a != expected or found_b != expected or (stops_a != stops).any() or (stops_b != stops).any():
        lists_a = [vocabulary.encode_a([t]) for t in texts] if found_a != expected else np.split(a, np.cumsum(sizes_a)[:-1])
        for i, text in enumerate(spaced):
            whole[i] = _joined(vocabulary.bytes_a, lists_a[i].tolist()) == text and _joined(vocabulary.bytes_b, lists_b[i]) == text
        sizes_a = np.fromiter(map(len, lists_a), np.int64, len(texts)) * whole
        a, b = np.concatenate([x[:n] for x, n in zip(lists_a, sizes_a.tolist())]), b[np.repeat(whole, sizes_b)]
        sizes_b = sizes_b * whole
        ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    # Texts end at the same byte on both sides, so no group crosses from one to the next.
    last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())
    count_a, count_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    # Two tokens overlap in one run of bytes, and it ends where one of them does.
    stops = np.sort(np.concatenate((ends_a, ends_b[~last_b])), kind="stable")
    in_a, in_b = np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)
    linked_a, linked_b, group = a[in_a], b[in_b], group_a[in_a]
    mapped = (count_a[group] == 1) & (count_b[group] == 1) & (vocabulary.same[linked_a] == linked_b)
    text_a = np.repeat(np.arange(len(texts)), sizes_a)
    text = text_a[in_a]
    # The tokens of a group, A's before B's.
    seen_a, seen_b = np.cumsum(count_a), np.cumsum(count_b)
    place_a = np.arange(len(a)) + (seen_b - count_b)[group_a]
    place_b = np.arange(len(b)) + seen_a[group_b]
    table = _written((len(vocabulary.bytes_a), len(vocabulary.bytes_b)))
    rows = np.empty(len(a) + len(b), np.int64)
    rows[place_a] = a + last_a * len(vocabulary.bytes_a)
    rows[place_b] = 2 * len(vocabulary.bytes_a) + b + last_b * len(vocabulary.bytes_b)
    written = table[rows].tobytes().replace(b"\0", b"")
    cuts = np.append(0, np.cumsum(np.char.str_len(table)[rows]))[np.append(0, np.cumsum(sizes_a + sizes_b))].tolist()
    listed = [written[i:j - 1] if i < j else b"" for i, j in zip(cuts, cuts[1:])]
    return Aligned(
        sizes_a, sizes_b, np.bincount(text_a[last_a], minlength=len(texts)), np.bincount(text, minlength=len(texts)),
        listed, whole, text, vocabulary.code(linked_a, linked_b), mapped,
    )


class _Rows:
    """An array that rows are added to."""

    def __init__(self, kind):
        self.held, self.size = np.zeros(1 << 10, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.held):
            self.held = np.concatenate((self.held[:self.size], np.zeros(self.size + 2 * len(values), self.held.dtype)))
        self.held[self.size:self.size + len(values)] = values
        self.size += len(values)


class _Lists:
    """Lists of numbers in a row, one for each chunk."""

    def __init__(self, kind):
        self.sizes, self.starts, self.values = _Rows(np.int32), _Rows(np.int64), _Rows(kind)

    def add(self, of: np.ndarray, values: np.ndarray, lists: int) -> None:
        """``of`` names the list of each value and ascends."""
        sizes = np.bincount(of, minlength=lists)
        self.starts.add(self.values.size + np.cumsum(sizes) - sizes)
        self.sizes.add(sizes)
        self.values.add(values)

    def rows(self, chunks: np.ndarray, stops: np.ndarray) -> pa.Array:
        """The lists of ``chunks`` in a row, a new one after each of ``stops`` chunks."""
        sizes = self.sizes.held[chunks].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        places = np.arange(ends[-1]) + np.repeat(self.starts.held[chunks] - ends[:-1], sizes)
        bounds = np.concatenate(([0], ends[stops])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(self.values.held[places]))


class Chunks(dict):
    """The number of each chunk that a worker remembers; -1 if the space beside it is no place to cut."""

    def __init__(self, vocabulary: Vocabularies, remembered: int):
        super().__init__()
        self.vocabulary, self.remembered = vocabulary, remembered
        self._start_anew()

    def _start_anew(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.listed: list[bytes] = []
        self.characters = self.count = 0
        self.whole = _Rows(bool)
        self.sums = [_Rows(np.int32) for _ in range(4)]
        self.mapped = _Lists(np.int32)
        self.others = _Lists(np.int32 if self.vocabulary.pair_type() == "int" else np.int64)

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = -1 if not chunk or _ENDS_IN_SPACE.search(chunk) else self._number(chunk)
        return number

    def _number(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self.characters += len(chunk) + ROOM
        self.count += 1
        return self.count - 1

    def aligned(self, texts: list[str | None]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, digest, mapped and other links of each text."""
        if self.characters > self.remembered:
            self._start_anew()
        lists = [list(map(self.__getitem__, text.split(" "))) if text else [] for text in texts]
        self._align_fresh(chunks=True)
        for i, text in enumerate(texts):
            if -1 in lists[i]:
                lists[i] = [self._number(text)]
        self._align_fresh(chunks=False)
        sizes = np.array([len(x) for x in lists], np.int64)
        chunks = np.array([i for x in lists for i in x], np.int64)
        broken = np.repeat(np.arange(len(texts)), sizes)[~self.whole.held[chunks]]
        if len(broken):
            for i in np.unique(broken).tolist():
                lists[i] = []
            sizes = np.array([len(x) for x in lists], np.int64)
            chunks = np.array([i for x in lists for i in x], np.int64)
        stops = np.cumsum(sizes)
        sums = []
        for rows in self.sums:
            total = np.concatenate(([0], np.cumsum(rows.held[chunks], dtype=np.int64)))
            sums.append(total[stops] - total[stops - sizes])
        listed = self.listed
        digests = [hashlib.sha256(b";".join([listed[i] for i in x])).hexdigest() if x else "" for x in lists]
        return [*map(pa.array, sums), pa.array(digests), self.mapped.rows(chunks, stops), self.others.rows(chunks, stops)]

    def _align_fresh(self, chunks: bool) -> None:
        fresh, self.fresh = self.fresh, []
        for start, stop in _by_length(fresh):
            n, found = stop - start, align(self.vocabulary, fresh[start:stop], chunks)
            for rows, values in zip(self.sums, found):
                rows.add(values)
            self.whole.add(found.whole)
            self.listed += found.listed
            mapped, b_size = found.mapped, len(self.vocabulary.bytes_b)
            self.mapped.add(found.text[mapped], found.pair[mapped] // b_size, n)
            self.others.add(found.text[~mapped], found.pair[~mapped], n)


@lru_cache(maxsize=2)
def _chunks(path_a: str, path_b: str) -> Chunks:
    return Chunks(vocabularies(path_a, path_b), REMEMBERED)


_COLUMNS = ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "mapped", "others")


def _aligned_schema(vocabulary: Vocabularies) -> str:
    return (
        "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        f"mapped array<int>, others array<{vocabulary.pair_type()}>"
    )


def _align_blocks(path_a: str, path_b: str, block_links: int):
    def step(batches):
        from pyspark import TaskContext

        chunks = _chunks(path_a, path_b)
        block, links = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            for start, stop in _by_length(texts):
                n, found = stop - start, chunks.aligned(texts[start:stop])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), ids.slice(start, n), *found], names=_COLUMNS
                )
                links += pc.sum(found[3]).as_py()
                if links >= block_links:
                    block, links = block + 1, 0

    return step


def _by_length(texts: list[str | None], characters: int = 1 << 20):
    """Runs of texts of about so many characters."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= characters:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: Links of a block that are held before they are added up.
_HELD_LINKS = 1 << 22


def _count_links(path_a: str, path_b: str):
    """Counts of a block's pairs; those of mapped groups, of block -1, from one vector for the task."""

    def step(batches):
        vocabulary = vocabularies(path_a, path_b)
        vector = np.zeros(len(vocabulary.same), np.int64)
        block, waiting, held = None, [], 0
        pairs = counts = np.zeros(0, np.int64)

        for batch in batches:
            vector += np.bincount(batch["mapped"].flatten().to_numpy(), minlength=len(vector))
            blocks, lists = batch["block"].to_numpy(), batch["others"]
            starts = np.concatenate(([0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]))
            for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if waiting and (blocks[start] != block or held >= _HELD_LINKS):
                    pairs, counts = _added(pairs, counts, waiting)
                    waiting, held = [], 0
                if blocks[start] != block:
                    yield _counts(block, pairs, counts)
                    pairs, counts = pairs[:0], counts[:0]
                block = int(blocks[start])
                links = lists.slice(start, stop - start).flatten().to_numpy()
                waiting.append(links)
                held += len(links)
        yield _counts(block, *_added(pairs, counts, waiting))
        ids = np.flatnonzero(vector)
        yield _counts(-1, vocabulary.code(ids, vocabulary.same[ids]), vector[ids])

    return step


def _added(pairs: np.ndarray, counts: np.ndarray, links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pairs, ascending, together with links that are pairs one by one."""
    more, times = np.unique(np.concatenate([pairs[:0], *links]), return_counts=True)
    both, place = np.unique(np.concatenate([pairs, more]), return_inverse=True)
    sums = np.zeros(len(both), np.int64)
    np.add.at(sums, place, np.concatenate([counts, times]))
    return both, sums


def _counts(block: int | None, pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(pairs), pa.int64()), pa.array(pairs, pa.int64()), pa.array(counts, pa.int64())],
        names=["block", "pair", "n"],
    )


def _sum_links(mapped):
    """Each document's sums; the counts of its block's pairs come before its documents."""

    def step(batches):
        vector = np.frombuffer(mapped.value, np.int64).reshape(2, -1)
        block, counts, table = None, [], None
        for batch in batches:
            blocks, documents = batch["block"].to_numpy(), batch["is_document"].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (documents[1:] != documents[:-1])) + 1
            bounds = [0, *edges.tolist(), len(blocks)]
            for start, stop in zip(bounds[:-1], bounds[1:]):
                rows = batch.slice(start, stop - start)
                if blocks[start] != block:
                    block, counts, table = blocks[start], [], None
                if not documents[start]:
                    counts.append(rows.select(["pair", "n", "is_best"]))
                    continue
                if table is None:
                    found = [
                        np.concatenate([c[name].to_numpy(zero_copy_only=False) for c in counts] or [np.zeros(0, np.int64)])
                        for name in ("pair", "n", "is_best")
                    ]
                    order = np.argsort(found[0])
                    table, counts = [x[order].astype(np.int64) for x in found], []
                pairs, ids = rows["others"].flatten().to_numpy(), rows["mapped"].flatten().to_numpy()
                at = np.searchsorted(table[0], pairs)
                best = _per_row(rows["others"], table[2][at]) + _per_row(rows["mapped"], vector[1][ids])
                sums = _per_row(rows["others"], table[1][at]) + _per_row(rows["mapped"], vector[0][ids])
                yield pa.RecordBatch.from_arrays([
                    *(rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
                    pa.array(best), pa.array(sums), rows["groups_sha256"],
                ], names=_DIGEST_NAMES)

    return step


_DIGESTS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
_DIGEST_NAMES = [c.split()[0] for c in _DIGESTS.split(", ")]


def _per_row(lists: pa.ListArray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each row's list."""
    sizes = np.diff(lists.offsets.to_numpy())
    sums = np.concatenate(([0], np.cumsum(values)))
    stops = np.cumsum(sizes)
    return sums[stops] - sums[stops - sizes]


def write_alignment(docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """A written table of documents with block, counts, digest of their groups and linked pairs.

    ``mapped`` has the A ids of groups that the identity map covers, ``others`` the pairs of all other links.
    """
    schema = _aligned_schema(vocabularies(path_a, path_b))
    return cut(map_batches(docs.select("doc_id", "text"), _align_blocks(path_a, path_b, block_links), schema), "aligned")


def count_pairs(block_counts: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, is_best): how many links hold a pair, and whether no pair of its B id has more."""
    totals = cut(block_counts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = (F.col("pair") % b_size).alias("b_id")
    most = totals.groupBy(b_id).agg(F.max("n").alias("most"))
    # As many rows as B has ids at most.
    return totals.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("is_best")
    )


def align_documents(docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Tokens, groups and links of each document, and what its links' pairs count in the whole table."""
    spark = docs.sparkSession
    vocabulary = vocabularies(path_a, path_b)
    b_size = len(vocabulary.bytes_b)
    aligned = write_alignment(docs, path_a, path_b, block_links)
    block_counts = cut(map_batches(
        aligned.select("block", "mapped", "others"), _count_links(path_a, path_b), "block long, pair long, n long"
    ), "block-pairs")
    pairs = cut(count_pairs(block_counts, b_size), "pair-counts")
    # Mapped pairs are as many as A has ids at most.
    mapped = block_counts.filter("block = -1").select("pair").distinct()
    vector = np.zeros((2, len(vocabulary.same)), np.int64)
    for pair, n, is_best in pairs.join(mapped, "pair", "left_semi").collect():
        vector[:, pair // b_size] = n, is_best
    beside = block_counts.filter("block >= 0").select("block", "pair").join(pairs, "pair").select(
        "block", F.lit(False).alias("is_document"), "pair", "n", "is_best"
    ).unionByName(aligned.withColumn("is_document", F.lit(True)), allowMissingColumns=True)
    return map_batches(
        beside.repartition("block").sortWithinPartitions("block", "is_document"),
        _sum_links(spark.sparkContext.broadcast(vector.tobytes())), _DIGESTS,
    )
