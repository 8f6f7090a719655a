"""CTC prefix beam search with a character language model.

The time axis of a clip is sequential, so the work is parallel over clips: each is decoded inside its task.
Whatever the size of the model, a task needs of it what a letter costs behind the last letters of a prefix.
That table has one row for each context of the decoder's alphabet, so its size follows from the alphabet and
the order alone; it is computed from the model by joins and broadcast. For alphabets whose table is
too large for that, ``beam_decode_by_joins`` keeps the model a table and advances all clips by joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtab import constants as K
from speechtab import session
from speechtab.operators import ctc, ngram, text

#: Cells of a table of letter costs that may be broadcast, 128 MiB: 27 letters and order 5 need 15.5 million.
TABLE_CELLS = 1 << 24
#: Hypotheses that are handed on together.
FRAME_ROWS = 10_000
_LN10 = math.log(10.0)
_CANDIDATES = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("am_score", T.DoubleType()),
    T.StructField("lm_score", T.DoubleType()),
    T.StructField("word_count", T.IntegerType()),
])


def _context_offsets(letters: int, order: int) -> list[int]:
    """Number of the first context of each length; the longest have no start of sentence before them."""
    offsets = [0]
    for length in range(order):
        offsets.append(offsets[-1] + letters ** length)
    return offsets


def letter_costs(model: DataFrame, letters: str, order: int) -> DataFrame:
    """(cell, ln_prob) for each context of up to ``order`` - 1 letters and each letter or end behind it.

    Contexts are numbered by length, then as digits in the base of the alphabet; cell = context number times
    (letters + 1) + letter, the end last.
    """
    size, offsets = len(letters), _context_offsets(len(letters), order)
    cell = F.col("cell")
    number = F.floor(cell / (size + 1))
    length = sum(((number >= o).cast("int") for o in offsets[1:-1]), F.lit(0))
    digits = number - F.element_at(F.array(*[F.lit(o) for o in offsets]), length + 1)
    symbols = text.string_array([K.LM_SPACE if c == " " else c for c in letters] + [K.LM_END])
    spelled = [
        F.when(length > k, F.get(symbols, (F.floor(digits / size ** k) % size).cast("int")))
        for k in reversed(range(order - 1))
    ]
    start = F.when(length < order - 1, K.LM_START)
    windows = model.sparkSession.range(offsets[-1] * (size + 1)).withColumnRenamed("id", "cell").select(
        "cell", F.concat_ws(" ", start, *spelled, F.get(symbols, (cell % (size + 1)).cast("int"))).alias("w")
    )
    scored = ngram.score_windows(windows.select("w"), model)
    return windows.join(scored, "w").select("cell", (F.col("log10_prob") * _LN10).alias("ln_prob"))


def cost_table(model: DataFrame, letters: str, order: int) -> np.ndarray:
    """The costs of ``letter_costs``, a row for each context."""
    cells = _context_offsets(len(letters), order)[-1] * (len(letters) + 1)
    if cells > TABLE_CELLS:
        raise ValueError(f"{cells} cells of letter costs are too many to broadcast; use beam_decode_by_joins")
    _require_unknown(model)
    found = letter_costs(model, letters, order).toArrow()
    table = np.empty(cells)
    table[found["cell"].to_numpy()] = found["ln_prob"].to_numpy()
    return table.reshape(-1, len(letters) + 1)


def _search(
    log_probs: np.ndarray, letters: str, costs: np.ndarray | None, order: int, width: int, alpha: float,
    beta: float,
) -> list[tuple[str, float, float]]:
    """(prefix, acoustic, language) of the surviving hypotheses, best first; all of a step at once."""
    size, offsets = len(letters), _context_offsets(len(letters), order)
    spaces = np.array([c == " " for c in letters])
    prefixes = [""]
    blank, symbol, language = np.zeros(1), np.full(1, -np.inf), np.zeros(1)
    # Last letter (0: none), number of words, length and digits of the context.
    last, words, length, digits = (np.zeros(1, np.int64) for _ in range(4))
    for row in log_probs:
        both = np.logaddexp(blank, symbol)
        some = np.flatnonzero(last)
        stay_blank, stay_symbol = both + row[0], np.full(len(prefixes), -np.inf)
        stay_symbol[some] = symbol[some] + row[last[some]]
        grown = both[:, None] + row[None, 1:]
        # The same symbol again only counts as new after a blank.
        grown[some, last[some] - 1] = blank[some] + row[last[some]]
        place = {p: k for k, p in enumerate(prefixes)}
        shorter = np.array([place.get(prefixes[k][:-1], -1) for k in some.tolist()], np.int64)
        child, parent = some[shorter >= 0], shorter[shorter >= 0]
        ending = last[child] - 1
        stay_symbol[child] = np.logaddexp(stay_symbol[child], grown[parent, ending])
        grown[parent, ending] = -np.inf
        longer = language[:, None] + (costs[np.array(offsets)[length] + digits, :size] if costs is not None else np.zeros(size))
        begins = (last == 0) | spaces[last - 1]
        more_words = words[:, None] + (begins[:, None] & ~spaces[None, :])
        parents, letter = np.nonzero(grown > -np.inf)
        totals = np.concatenate([
            np.logaddexp(stay_blank, stay_symbol) + alpha * language + beta * words,
            (grown + alpha * longer + beta * more_words)[parents, letter],
        ])
        kept = np.arange(len(totals))
        if len(totals) > width:
            least = np.partition(totals, len(totals) - width)[len(totals) - width]
            kept = np.flatnonzero(totals > least)
            spelled = lambda i: prefixes[i] if i < len(prefixes) else (
                prefixes[parents[i - len(prefixes)]] + letters[letter[i - len(prefixes)]]
            )
            ties = sorted(np.flatnonzero(totals == least).tolist(), key=spelled)
            kept = np.concatenate([kept, np.array(ties[:width - len(kept)], np.int64)])
        old = kept[kept < len(prefixes)]
        new = kept[kept >= len(prefixes)] - len(prefixes)
        origin, added = parents[new], letter[new]
        inside = length[origin] < order - 1
        moved = digits[origin] * size + added if order > 1 else digits[origin]
        if order > 1:
            moved = np.where(inside, moved, moved % size ** (order - 1))
        prefixes = [prefixes[k] for k in old.tolist()] + [
            prefixes[k] + letters[c] for k, c in zip(origin.tolist(), added.tolist())
        ]
        blank = np.concatenate([stay_blank[old], np.full(len(new), -np.inf)])
        symbol = np.concatenate([stay_symbol[old], grown[origin, added]])
        language = np.concatenate([language[old], longer[origin, added]])
        words = np.concatenate([words[old], more_words[origin, added]])
        last = np.concatenate([last[old], added + 1])
        digits = np.concatenate([digits[old], moved])
        length = np.concatenate([length[old], length[origin] + inside])
    if costs is not None:
        language = language + costs[np.array(offsets)[length] + digits, size]
    final = list(zip(prefixes, np.logaddexp(blank, symbol).tolist(), language.tolist()))
    return sorted(final, key=lambda f: (-(f[1] + alpha * f[2] + beta * len(f[0].split())), f[0]))


def _candidates(batches: Iterator[pd.DataFrame], key: str, search: Callable) -> Iterator[pd.DataFrame]:
    """Frames of the hypotheses of many clips: a frame of its own for each clip took more time than its rows."""
    names, found = [], []
    for batch in batches:
        for name, length, steps in zip(batch[key], batch["length"], batch["steps"]):
            scores = np.array([np.asarray(s, dtype=float) for s in steps[: int(length)]])
            if len(scores):
                peak = scores.max(axis=1, keepdims=True)
                scores -= peak + np.log(np.exp(scores - peak).sum(axis=1, keepdims=True))
            of_clip = search(scores)
            found += of_clip
            names += [name] * len(of_clip)
            if len(found) >= FRAME_ROWS:
                yield _frame(key, names, found)
                names, found = [], []
    if found:
        yield _frame(key, names, found)


def _frame(key: str, names: list, found: list[tuple[str, float, float]]) -> pd.DataFrame:
    prefixes, acoustic, language = zip(*found)
    words = [p.split() for p in prefixes]
    return pd.DataFrame({
        key: names, "text": [" ".join(w) for w in words], "am_score": acoustic, "lm_score": language,
        "word_count": [len(w) for w in words],
    })


def beam_decode(
    logits: DataFrame, model: DataFrame | None = None, *, key: str = "sample_id",
    width: int = 100, alpha: float = 1.0, beta: float = 0.0, letters: str = K.SERBIAN_LETTERS,
    order: int = K.LM_ORDER,
) -> DataFrame:
    """N-best table (key, alpha, text, am_score, lm_score, word_count) of clip rows.

    ``logits`` has (key, length, steps). ``width`` is the beam itself, not a cap on the output.
    """
    shared = None
    if model is not None:
        shared = logits.sparkSession.sparkContext.broadcast(cost_table(model, letters, order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs = shared.value if shared is not None else None
        return _candidates(batches, key, lambda scores: _search(scores, letters, costs, order, width, alpha, beta))

    schema = T.StructType([logits.schema[key], *_CANDIDATES.fields])
    decoded = logits.select(key, "length", "steps").mapInPandas(run, schema)
    return decoded.withColumn("alpha", F.lit(float(alpha)))


def _require_unknown(model: DataFrame) -> None:
    """What an unknown token costs must be in the model; no form of the search makes it up."""
    if model.filter((F.col("ngram") == K.LM_UNKNOWN) & F.col("log10_prob").isNotNull()).isEmpty():
        raise ValueError(f"the model has no {K.LM_UNKNOWN}")


def _ln_sum(values: Column) -> Column:
    """ln of a sum of exponentials over a short array; null entries are absent terms."""
    terms = F.filter(values, lambda v: v.isNotNull())
    peak = F.array_max(terms)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + F.exp(v - peak))
    return F.when(F.size(terms) > 0, peak + F.ln(total))


def beam_decode_by_joins(
    logits: DataFrame, model: DataFrame, *, key: str = "sample_id", width: int = 100,
    alpha: float = 1.0, beta: float = 0.0, letters: str = K.SERBIAN_LETTERS,
    order: int = K.LM_ORDER, checkpoint_every: int = 4,
) -> DataFrame:
    """The same search with the language model as a table, one step of all clips per round.

    Log probabilities that are absent are null. At most width * symbols rows per clip meet in the
    ranking window. Lineage is cut every few steps.
    """
    clips = logits.select(
        key, F.least("length", F.size("steps")).alias("length"),
        F.transform("steps", ctc.log_softmax).alias("lp"),
    )
    _require_unknown(model)
    steps = clips.agg(F.max("length")).first()[0] or 0
    symbols = text.string_array(list(letters))
    words = F.size(text.words_micro(F.col("prefix")))
    beams = clips.select(
        key, F.lit("").alias("prefix"), F.lit(0.0).alias("pb"), F.lit(None).cast("double").alias("pnb"),
        F.lit(0.0).alias("lm"),
    )

    def with_language(rows: DataFrame, window: Column) -> DataFrame:
        keyed = rows.withColumn("w", window)
        scored = ngram.score_windows(keyed.filter("w IS NOT NULL").select("w").distinct(), model)
        return keyed.join(scored, "w", "left").withColumn(
            "lm", F.col("lm") + F.coalesce(F.col("log10_prob"), F.lit(0.0)) * _LN10
        ).drop("w", "log10_prob")

    def window_of(prefix: Column, token: Column) -> Column:
        full = F.concat(
            F.array(F.lit(K.LM_START)), text.language_model_tokens(prefix), F.array(token)
        )
        size = F.least(F.size(full), F.lit(order))
        return F.array_join(F.slice(full, F.size(full) - size + 1, size), " ")

    for t in range(steps):
        step = beams.join(clips.select(key, "length", F.get("lp", F.lit(t)).alias("row")), key)
        live = step.filter(F.col("length") > t)
        done = step.filter(F.col("length") <= t).select(key, "prefix", "pb", "pnb", "lm")
        both = _ln_sum(F.array("pb", "pnb"))
        last = F.when(F.length("prefix") > 0, F.substring("prefix", -1, 1))
        last_score = F.element_at("row", F.array_position(symbols, last).cast("int") + 1)
        stay = F.struct(
            F.col("prefix").alias("p"), F.lit(None).cast("string").alias("token"),
            (both + F.element_at("row", 1)).alias("b"),
            F.when(last.isNotNull(), F.col("pnb") + last_score).alias("s"),
        )
        grow = F.transform(symbols, lambda c, i: F.struct(
            F.concat("prefix", c).alias("p"), c.alias("token"),
            F.lit(None).cast("double").alias("b"),
            (F.when(c.eqNullSafe(last), F.col("pb")).otherwise(both)
             + F.element_at("row", i + 2)).alias("s"),
        ))
        moves = live.select(
            key, F.col("prefix").alias("from"), "lm",
            F.explode(F.concat(F.array(stay), F.filter(grow, lambda g: g["s"].isNotNull()))).alias("m"),
        )
        # A prefix receives at most its own row and the one that grew into it.
        merged = moves.groupBy(key, F.col("m.p").alias("prefix")).agg(
            F.max("m.b").alias("pb"),
            _ln_sum(F.collect_list("m.s")).alias("pnb"),
            F.min_by(F.struct("from", "m.token", "lm"), F.col("m.token").isNotNull()).alias("o"),
        ).select(key, "prefix", "pb", "pnb", "o.from", "o.token", "o.lm")
        token = F.when(F.col("token") == " ", F.lit(K.LM_SPACE)).otherwise(F.col("token"))
        scored = with_language(
            merged, F.when(F.col("token").isNotNull(), window_of(F.col("from"), token))
        )
        total = _ln_sum(F.array("pb", "pnb")) + alpha * F.col("lm") + beta * words
        ranked = F.row_number().over(Window.partitionBy(key).orderBy(total.desc(), "prefix"))
        beams = (
            scored.withColumn("r", ranked).filter(F.col("r") <= width)
            .select(key, "prefix", "pb", "pnb", "lm").unionByName(done)
        )
        if (t + 1) % checkpoint_every == 0:
            beams = session.cut_lineage(beams)
    final = with_language(beams, window_of(F.col("prefix"), F.lit(K.LM_END)))
    squeezed = F.array_join(text.words_micro(F.col("prefix")), " ")
    return final.select(
        key, squeezed.alias("text"), _ln_sum(F.array("pb", "pnb")).alias("am_score"),
        F.col("lm").alias("lm_score"), words.cast("int").alias("word_count"),
        F.lit(float(alpha)).alias("alpha"),
    )
