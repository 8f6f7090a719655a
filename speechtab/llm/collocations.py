"""Phrases whose words stand together more often than their parts suggest.

Texts are cut at punctuation and line ends into pieces and these into words; phrases of up to four words
are counted inside pieces, by language, in two passes:

1. Each task counts hashes of the phrases that it meets, in tables that are handed on when they are full, with
   the mass (occurrences) of each hash partition. A partition merges what comes for it into one Misra-Gries
   summary. Its capacity exceeds its mass divided by the threshold, so that what merging takes from a count
   stays below the threshold and each phrase that reaches it survives.
2. Phrases whose hash survived are counted exactly, as text. Which hashes survived is told by a map of
   2^26 bits whatever the corpus. A full map would let rarer phrases through to this count, which drops
   them, so the result is the same at any size.

Scores come from the exact counts. Arithmetic on them is decimal where products may pass 64 bits.

A null text has no words, a null language is ``und``. Repeated rows count again. Texts without words and an
empty table give no rows. Other columns are ignored. Texts of any length are taken in parts that overlap by
three words. A phrase that holds a third of all occurrences costs a task one entry.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechtab.llm.common import cut, map_batches, whole_text

LONGEST = 4
THRESHOLD = 30
TOP = 2_000
#: A longer phrase with this share of a candidate's occurrences, in hundredths, takes its place.
COVERED = 80
SCALE = 2_000_000

#: Bytes of text that are looked at together, and entries of a table before it is handed on.
PART_BYTES = 1 << 18
TABLE_ENTRIES = 1 << 20
PHRASES = 1 << 17
#: log2 of the bits of the map of surviving hashes: 8 MiB.
MAP_BITS = 26
#: Bytes of text of a hash partition, of which there are as many as shuffle partitions at least.
PARTITION_BYTES = 1 << 26

_CUT = re.compile(rb"[ \t.,;:!?\n-\r]")
_LOOK_AHEAD = re.compile(rb"(?:[ \t]++[^ \t.,;:!?\n-\r]++){0,3}")
#: 0 in words, 1 blanks, 2 ends of pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = 0xC2B2AE3D27D4EB4F


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


#: A number for each byte, so that words differ in more than small sums.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX[0])


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    return tuple(
        np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64))))
        for x in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))
    )


def _parts(text: bytes) -> Iterator[tuple[bytes, int]]:
    """Parts of a text with the number of bytes in which their phrases start; three more words follow."""
    start = 0
    while len(text) - start > PART_BYTES:
        end = _CUT.search(text, start + PART_BYTES)
        if not end:
            break
        end = end.start()
        yield text[start:_LOOK_AHEAD.match(text, end).end()], end - start
        start = end
    yield text[start:], len(text) - start


def _grouped(batches) -> Iterator[tuple[str, bytes, np.ndarray, np.ndarray]]:
    """Texts of a language side by side, with where each starts and where its own phrases end."""
    waiting: dict[str, list] = {}
    held = 0

    def taken():
        for lang, parts in waiting.items():
            starts = np.cumsum([0] + [len(p) + 1 for p, _ in parts[:-1]])
            yield lang, b"\n".join(p for p, _ in parts), starts, starts + [n for _, n in parts]
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            for part in _parts(text.encode().lower()):
                waiting.setdefault(lang, []).append(part)
                held += len(part[0]) + 1
                if held >= PART_BYTES:
                    yield from taken()
                    held = 0
    yield from taken()


class _Words:
    """Words of texts side by side: where they start and end, and whether the next is in the same piece."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray):
        codes = np.frombuffer(data, np.uint8)
        kinds = _KIND[codes]
        edges = np.diff((kinds == 0).astype(np.int8), prepend=0, append=0)
        self.codes = codes
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        cuts = np.cumsum(kinds == 2, dtype=np.int32)
        self.joined = cuts[self.starts[1:]] == cuts[self.ends[:-1] - 1]
        self.own = self.starts < ends[np.searchsorted(starts, self.starts, "right") - 1]

    def first_words(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each length the words with which phrases of it start."""
        together = self.own
        yield 1, np.flatnonzero(together)
        for n in range(2, LONGEST + 1):
            if len(self.starts) < n:
                return
            together = together[:len(self.starts) - n + 1] & self.joined[n - 2:]
            yield n, np.flatnonzero(together)

    def hashes(self, lang: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the first words of phrases and the phrases' hashes."""
        if not len(self.starts):
            return
        size = 1 << max(20, len(self.codes).bit_length())
        up, down = (p[:len(self.codes) + 1] for p in _powers(size))
        sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum(_BYTES[self.codes] * up[:-1], out=sums[1:])
        words = _mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])
        # A language is part of the hash, as if it were a word before the phrase.
        seed = np.uint64(hash_of(lang))
        for n, first in self.first_words():
            hashed = np.full(len(first), seed)
            for k in range(n):
                hashed = hashed * _MIX[0] + words[first + k]
            yield n, first, _mixed(hashed)


def hash_of(lang: str) -> int:
    found = 0
    for code in lang.encode():
        found = (found * _BASE + int(_BYTES[code])) % (1 << 64)
    return found


def _partition(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Never falls along ascending hashes."""
    return (hashes >> np.uint64(40)) * np.uint64(partitions) >> np.uint64(24)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with its sum."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# Rows of the first shuffle, in the order in which a partition reads them: masses, then counters.
_MASS, _ONCE, _OFTEN = range(3)
_SUMMARY = pa.schema({"part": pa.int64(), "kind": pa.int32(), "mass": pa.int64(), "keys": pa.binary(), "counts": pa.binary()})
_SUMMARY_SQL = "part long, kind int, mass long, keys binary, counts binary"


def _hand_on(hashes: list[np.ndarray], partitions: int) -> Iterator[pa.RecordBatch]:
    """A task's counts by hash partition; within one, half of the hash is the key."""
    all_ = np.concatenate(hashes)
    hashes.clear()
    all_.sort()
    first = np.flatnonzero(np.concatenate(([True], all_[1:] != all_[:-1])))
    counts = np.diff(np.append(first, len(all_)))
    found = all_[first]
    parts = _partition(found, partitions)
    bounds = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1], [True])))
    rows = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        part, keys, n = int(parts[a]), found[a:b].astype(np.uint32), counts[a:b]
        rows.append((part, _MASS, int(n.sum()), None, None))
        once = n == 1
        if once.any():
            rows.append((part, _ONCE, 0, keys[once].tobytes(), None))
        if not once.all():
            rows.append((part, _OFTEN, 0, keys[~once].tobytes(), n[~once].astype(np.int64).tobytes()))
    yield pa.RecordBatch.from_pylist([dict(zip(_SUMMARY.names, r)) for r in rows], _SUMMARY)


def _summarise(partitions: int):
    def step(batches):
        tables, held = [], 0
        for lang, data, starts, ends in _grouped(batches):
            for _, _, hashes in _Words(data, starts, ends).hashes(lang):
                tables.append(hashes)
                held += len(hashes)
            if held >= TABLE_ENTRIES:
                yield from _hand_on(tables, partitions)
                tables, held = [], 0
        if held:
            yield from _hand_on(tables, partitions)

    return step


class Summary:
    """A Misra-Gries summary that takes counters of other summaries.

    With a mass of at most ``mass`` its counts are too low by less than ``threshold``: lowering them all by
    one takes more than ``capacity`` occurrences, and capacity exceeds mass / threshold.
    """

    def __init__(self, mass: int, threshold: int):
        self.capacity, self.threshold = mass // threshold + 1, threshold
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.lowered = 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= max(self.capacity, 1 << 18):
            self.merge()

    def merge(self) -> None:
        keys, counts = _counted(
            np.concatenate([self.keys, *(k for k, _ in self.waiting)]),
            np.concatenate([self.counts, *(c for _, c in self.waiting)]),
        )
        self.waiting, self.held = [], 0
        if len(keys) > self.capacity:
            place = len(keys) - self.capacity - 1
            least = np.partition(counts, place)[place]
            self.lowered += int(least)
            counts = counts - least
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        """Keys that may have reached the threshold."""
        self.merge()
        return self.keys[self.counts + self.lowered >= self.threshold]


def _merge_summaries(threshold: int):
    def step(batches):
        part, mass, summary = None, 0, None

        def spots():
            if summary is None:
                return pa.RecordBatch.from_pydict({"spot": pa.array([], pa.int64())})
            return pa.RecordBatch.from_pydict({"spot": pa.array(_spots(part, summary.survivors()), pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    yield spots()
                    part, mass, summary = row["part"], 0, None
                if row["kind"] == _MASS:
                    mass += row["mass"]
                    continue
                summary = summary or Summary(mass, threshold)
                keys = np.frombuffer(row["keys"], np.uint32)
                counts = np.frombuffer(row["counts"], np.int64) if row["counts"] else np.ones(len(keys), np.int64)
                summary.add(keys, counts)
        yield spots()

    return step


def _spots(part: int | np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of a hash in the bit map, from its partition and key."""
    whole = np.uint64(1 << 32) * np.asarray(part, np.uint64) + keys.astype(np.uint64)
    return (_mixed(whole * _MIX[0]) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _bit_map(spots: DataFrame) -> bytes:
    """A bit for each spot; 2^20 rows at most come to the driver."""
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS int))")).alias("bits")
    ).toArrow()
    whole = np.zeros(1 << MAP_BITS - 6, np.int64)
    whole[words["word"].to_numpy()] = words["bits"].to_numpy()
    return whole.tobytes()


_PHRASES = pa.schema({"part": pa.int64(), "lang": pa.string(), "phrases": pa.binary(), "counts": pa.binary()})
_PHRASES_SQL = "part long, lang string, phrases binary, counts binary"


def _phrases(counters: dict[str, Counter], partitions: int) -> Iterator[pa.RecordBatch]:
    """A task's exact counts, phrases of a partition together. No phrase is empty; that entry counts all words."""
    for lang, counter in counters.items():
        phrases, counts = list(counter), np.array(list(counter.values()), np.int64)
        parts = np.fromiter(map(crc32, phrases), np.int64, len(phrases)) % partitions
        order = np.argsort(parts, kind="stable")
        bounds = np.flatnonzero(np.concatenate(([True], np.diff(parts[order]) != 0, [True]))) if len(order) else []
        rows = [
            (int(parts[order[a]]), lang, b"\n".join([phrases[i] for i in order[a:b]]), counts[order[a:b]].tobytes())
            for a, b in zip(bounds[:-1], bounds[1:])
        ]
        yield pa.RecordBatch.from_pylist([dict(zip(_PHRASES.names, r)) for r in rows], _PHRASES)


def _add_up(threshold: int):
    """Counts of a partition's phrases; those below the threshold go."""
    kinds = pa.schema({"lang": pa.string(), "phrase": pa.string(), "f": pa.int64()})

    def step(batches):
        part, sums = None, {}

        def kept():
            rows = [
                (lang, phrase.decode() or None, n) for lang, counter in sums.items() for phrase, n in counter.items()
                if n >= threshold or not phrase
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, kinds.types)], schema=kinds)

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    yield kept()
                    part, sums = row["part"], {}
                counter = sums.setdefault(row["lang"], Counter())
                for phrase, n in zip(row["phrases"].split(b"\n"), np.frombuffer(row["counts"], np.int64).tolist()):
                    counter[phrase] += n
        yield kept()

    return step


def _count_exactly(partitions: int, bits):
    def step(batches):
        map_ = np.frombuffer(bits.value, np.uint8)
        counters: dict[str, Counter] = {}
        for lang, data, starts, ends in _grouped(batches):
            words = _Words(data, starts, ends)
            counter = counters.setdefault(lang, Counter())
            for n, first, hashes in words.hashes(lang):
                if n == 1:
                    counter[b""] += len(first)
                spots = _spots(_partition(hashes, partitions), hashes.astype(np.uint32))
                first = first[map_[spots >> 3] >> (spots & 7).astype(np.uint8) & 1 == 1]
                begin, end = words.starts[first], words.ends[first + n - 1]
                letters = sum(words.ends[first + k] - words.starts[first + k] for k in range(n))
                close = (end - begin == letters + n - 1) & (n == 1 or _one_space(words, first, n))
                counter.update([data[a:b] for a, b in zip(begin[close].tolist(), end[close].tolist())])
                counter.update([
                    b" ".join(data[a:b].split()) for a, b in zip(begin[~close].tolist(), end[~close].tolist())
                ])
            if sum(map(len, counters.values())) >= PHRASES:
                yield from _phrases(counters, partitions)
                counters = {}
        yield from _phrases(counters, partitions)

    return step


def _one_space(words: _Words, first: np.ndarray, n: int) -> np.ndarray:
    """Whether a space, not a tab, follows each word but the last; they are known to be one apart."""
    spaced = np.ones(len(first), bool)
    for k in range(n - 1):
        spaced &= words.codes[words.ends[first + k]] == 0x20
    return spaced


def count_phrases(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, phrase, f) for phrases of up to four words with f >= threshold, and all words as a null phrase."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    summaries = map_batches(texts, _summarise(partitions), _SUMMARY_SQL).repartition(
        partitions, "part"
    ).sortWithinPartitions("part", "kind")
    spots = map_batches(summaries, _merge_summaries(threshold), "spot long")
    bits = spark.sparkContext.broadcast(_bit_map(spots))
    counted = map_batches(texts, _count_exactly(partitions, bits), _PHRASES_SQL).repartition(
        partitions, "part"
    ).sortWithinPartitions("part")
    return map_batches(counted, _add_up(threshold), "lang string, phrase string, f long")


def score(counts: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of the counts of ``count_phrases``."""
    known = counts.filter("phrase IS NOT NULL")
    candidates = known.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 1)
    cuts = candidates.select("lang", "phrase", "f", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "f", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"),
    )
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn(
        "score", F.expr(f"CAST({SCALE} AS decimal(18,0)) * CAST(f AS decimal(19,0)) DIV (CAST(l AS decimal(19,0)) + r)")
    ).groupBy("lang", "phrase").agg(
        F.first("f").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("least")
    )
    # Every phrase of two words or more inside a longer candidate, with the longer one's count.
    inside = candidates.select("lang", "f", "words", F.explode(F.sequence(F.lit(2), F.size("words"))).alias("n")).filter(
        F.col("n") < F.size("words")
    ).select("lang", "f", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("n") + 1),
        lambda i: F.array_join(F.slice("words", i, F.col("n")), " "),
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = F.expr(f"CAST(longer AS decimal(19,0)) * 100 >= CAST(a AS decimal(19,0)) * {COVERED}")
    totals = counts.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("least.score"), F.desc("a"), "phrase")
    return scored.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).withColumn(
        "rank", F.row_number().over(order)
    ).filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "least.l", "least.r", "n", "least.score"
    )


def mine(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    return score(cut(count_phrases(docs, threshold), "phrases"), top)
