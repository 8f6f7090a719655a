"""Token counts by overlap resynchronisation.

A document of at most ``chunk`` characters is encoded whole. A longer one is cut into chunks that
overlap; each is encoded with offsets, in any task. Both encodings of an overlap are spliced at its
last stable boundary: a space behind a non-space, where the tokenizer always cuts, with the ids
between the first and the last such place equal on either side. If an overlap has no two such places
or the sides differ, the document's overlaps (and chunks with them) are doubled until they agree or
one chunk holds it all.

A null text counts as the empty one: 0 tokens. Repeated rows and repeated ``doc_id`` keep a row each,
and so does a null ``doc_id``.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm import tokens
from speechtab.llm.common import cut, map_batches, whole_text

CHUNK = 32_768
OVERLAP = 512

_STABLE = re.compile(f"(?<=[^{tokens.SPACES}])[{tokens.SPACES}]")
_KEY = ["doc_id", "text_hash", "n_bytes"]


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every document.

    ``tokenizer`` is a file of the tokenizers library that drops white space.
    """
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn(
        "n_bytes", F.octet_length("text").cast("long")
    )
    short = map_batches(
        texts.filter(F.length("text") <= chunk), _count_short(tokenizer),
        "doc_id long, n_bytes long, n_tokens long",
    )
    long = texts.filter(F.length("text") > chunk).withColumn("text_hash", F.xxhash64("text"))
    counts = _count_long(long, tokenizer, chunk, overlap)
    spliced = _join(long.select(*_KEY), counts, "inner")
    return short.unionByName(spliced.select("doc_id", "n_bytes", "n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def _join(rows: DataFrame, by_key: DataFrame, how: str) -> DataFrame:
    """Join by the key; a null doc_id is one like any other."""
    other = by_key.withColumnsRenamed({k: f"other_{k}" for k in _KEY})
    same = [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in _KEY]
    return rows.join(other, same, how)


def _count_short(tokenizer: str):
    def step(batches):
        encoder = tokens.word_encoder(tokenizer)
        for batch in batches:
            counts = [len(encoder(t)) // 4 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return step


def _count_long(long: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """Counts by (doc_id, text_hash, n_bytes)."""
    done, rest = [], long
    while True:
        found = cut(_splice(_chunks(rest, chunk, overlap), tokenizer, overlap), "spliced")
        done.append(found.filter("agreed").select(*_KEY, "n_tokens"))
        failed = found.filter("NOT agreed").select(*_KEY)
        if failed.isEmpty():
            break
        rest = _join(rest, failed, "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap
    counts = done[0]
    for more in done[1:]:
        counts = counts.unionByName(more)
    return counts


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunk i starts at i * chunk and reaches ``overlap`` characters into the next."""

    def step(batches):
        for batch in batches:
            for doc, text, size, key in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "n_bytes", "text_hash"))):
                n = max(1, -(-len(text) // chunk))
                for i in range(n):
                    part = text[i * chunk:(i + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], k) for v, k in ((doc, pa.int64()), (key, pa.int64()), (size, pa.int64()), (i, pa.int32()), (n, pa.int32()), (part, pa.string()))],
                        names=[*_KEY, "i", "n", "part"],
                    )

    rows = map_batches(
        long.select("doc_id", "text", "n_bytes", "text_hash"), step,
        "doc_id long, text_hash long, n_bytes long, i int, n int, part string",
    )
    # Chunks of one document go to different tasks; repeated rows are counted once.
    return rows.repartition("text_hash", "i").withColumn("size", F.lit(chunk))


def _splice(chunks: DataFrame, tokenizer: str, overlap: int) -> DataFrame:
    def step(batches):
        library = tokens.load(tokenizer)
        for batch in batches:
            out = []
            for i, n, part, size in zip(*(batch[c].to_pylist() for c in ("i", "n", "part", "size"))):
                code = library.encode(part, add_special_tokens=False)
                ids = np.array(code.ids, "<u4")
                starts = np.array([a for a, _ in code.offsets], np.int64)
                head = _boundary(part, 0, overlap, ids, starts) if i else None
                tail = _boundary(part, size, size + overlap, ids, starts) if i + 1 < n else None
                # A document's first and last boundary are its ends.
                out.append((0 if i == 0 else head and head[0], 0 if i == 0 else head and head[1], len(ids) if i + 1 == n else tail and tail[0], 0 if i + 1 == n else tail and tail[1]))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in (*_KEY, "i", "n")), *columns],
                names=[*_KEY, "i", "n", "head", "head_check", "tail", "tail_check"],
            )

    coded = map_batches(
        chunks.select(*_KEY, "i", "n", "part", "size"), step,
        "doc_id long, text_hash long, n_bytes long, i int, n int, head long, head_check long, tail long, tail_check long",
    ).groupBy(*_KEY, "i", "n").agg(*[F.max(c).alias(c) for c in ("head", "head_check", "tail", "tail_check")])
    # Chunk i has boundaries i and i + 1; each but a document's ends has two sides.
    sides = coded.select(
        *_KEY, "n",
        F.explode(F.array(
            F.struct(F.col("i").alias("at"), (-F.col("head")).alias("tokens"), F.col("head_check").alias("check")),
            F.struct((F.col("i") + 1).alias("at"), F.col("tail").alias("tokens"), F.col("tail_check").alias("check")),
        )).alias("side"),
    ).select(*_KEY, "n", "side.*")
    boundaries = sides.groupBy(*_KEY, "n", "at").agg(
        F.sum("tokens").alias("tokens"),
        ((F.min("check") == F.max("check")) & (F.count("check") == F.count("*"))).alias("agreed"),
    )
    return boundaries.groupBy(*_KEY).agg(
        F.sum("tokens").alias("n_tokens"), F.every(F.coalesce("agreed", F.lit(False))).alias("agreed")
    )


def _boundary(part: str, start: int, stop: int, ids: np.ndarray, starts: np.ndarray):
    """Tokens before the last stable place of an overlap and a check of those since the first."""
    places = [m.start() for m in _STABLE.finditer(part, start + 1, min(stop, len(part)))]
    if len(places) < 2:
        return None
    first, last = np.searchsorted(starts, (places[0], places[-1]))
    return int(last), zlib.crc32(ids[first:last].tobytes()) ^ (places[-1] - start)
