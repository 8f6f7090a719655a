"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Each coordinate has its own learning rate, and L1 keeps all weights at zero but those that earn their
place, so the model is a short list that every task gets. It is fitted on at most ``SAMPLE`` labelled
rows outside the held-out part, in the order of a digest of their ids; scoring reads every whole text.
A feature counts once per text, so a few toxic words show in a long text as in a short one. Labels, ids,
languages and sources are no inputs of a score.

A null text counts as the empty one, whose score is that of the bias alone. Rows without a label (none or
null) are scored but not learnt from; with several labels the highest counts. Without any labelled row
every score is close to 0. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import map_batches, whole_text
from speechtab.llm.tokens import _Memory

#: The most labelled rows that are learnt from.
SAMPLE = 16_384
BITS = 20
EPOCHS = 4
#: L1 is for a full sample; it falls with the root of the rows, as the sums that it opposes do.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 11.0, 0.1
THRESHOLD = 0.3
#: The bias of a model that has learnt nothing.
NEVER = -35.0

_WORD = re.compile(r"\w+")
#: Odd multipliers that mix two word hashes into one.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _word_hashes() -> _Memory:
    import xxhash

    return _Memory(lambda word: xxhash.xxh64_intdigest(word.encode()))


def features(text: str, hashes: _Memory) -> np.ndarray:
    """Distinct coordinates of the words, of neighbours and of words with one between them."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    a, b, c, d = (np.uint64(m) for m in _MIX)
    every = np.concatenate((h * a, h[:-1] * b + h[1:] * c, h[:-2] * d + h[2:] * a))
    every ^= every >> np.uint64(29)
    return np.unique((every * b) >> np.uint64(64 - BITS)).astype(np.int32)


def learn(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and their weights that aren't zero, and the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = L1 * min(1.0, len(examples) / SAMPLE) ** 0.5

    def weights(at):
        return np.where(
            np.abs(z[at]) <= np.where(at == size, 0, l1), 0.0,
            -(z[at] - np.sign(z[at]) * np.where(at == size, 0, l1)) / ((BETA + np.sqrt(n[at])) / ALPHA + L2),
        )

    for _ in range(epochs):
        for at, label in examples:
            at = np.append(at, size)  # the bias is one more coordinate, free of L1
            w = weights(at)
            slope = _sigmoid(w.sum()) - label
            rate = (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / ALPHA
            z[at] += slope - rate * w
            n[at] += slope * slope
    w = weights(np.arange(size + 1))
    at = np.flatnonzero(w[:-1])
    return at.astype(np.int32), w[at], float(w[-1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[int, float]]:
    """(coordinate, weight) pairs, the bias last at coordinate 2^BITS; at most 2^BITS + 1 of them."""
    known = (
        labels.filter("toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("turn", F.md5(F.col("doc_id").cast("string")))
        .orderBy("turn", "doc_id").limit(sample)
    )
    rows = (
        docs.select("doc_id", whole_text().alias("text"))
        .join(F.broadcast(known), "doc_id")  # ``sample`` narrow rows at most
        .select("turn", "text", "toxic").repartition(1).sortWithinPartitions("turn", "text")
    )

    def step(batches):
        hashes, examples = _word_hashes(), []
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                examples.append((features(text, hashes), int(label)))
        at, weights, bias = learn(examples) if examples else ((), (), NEVER)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*at, 1 << BITS], pa.int32()), pa.array([*weights, bias], pa.float64())],
            names=["at", "weight"],
        )

    model = [(r["at"], r["weight"]) for r in map_batches(rows, step, "at int, weight double").collect()]
    return model or [(1 << BITS, NEVER)]


def _scored(docs: DataFrame, model: list[tuple[int, float]], kept: list[Column]) -> DataFrame:
    """``kept`` as kept_0, kept_1 and so on, and the score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"kept_{i}" for i in range(len(kept))]
    given = docs.select(*[c.alias(n) for c, n in zip(kept, names)], whole_text().alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name in names)

    def step(batches):
        dense = np.zeros((1 << BITS) + 1)
        for at, weight in sent.value:
            dense[at] = weight
        hashes = _word_hashes()
        for batch in batches:
            scores = [_sigmoid(dense[features(t, hashes)].sum() + dense[-1]) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), pa.array(scores, pa.float64())], names=[*names, "score"]
            )

    return map_batches(given, step, f"{schema}, score double")


def clean_documents(docs: DataFrame, model: list[tuple[int, float]]) -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    below = _scored(docs, model, columns).filter(F.col("score") < THRESHOLD).drop("score")
    return below.toDF(*docs.columns)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return _scored(docs, fit(docs, labels), [F.col("doc_id")]).withColumnRenamed("kept_0", "doc_id").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
