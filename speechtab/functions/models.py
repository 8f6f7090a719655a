"""User detectors and score models on Arrow batches; built once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
]))
STEPS = T.ArrayType(T.ArrayType(T.FloatType()))


def _schema(df: DataFrame, names: Sequence[str], *extra: T.StructField) -> T.StructType:
    return T.StructType([df.schema[n] for n in names] + list(extra))


def apply_detector(
    frames: DataFrame, factory: Callable[[], Callable[[Any], Any]], keys: Sequence[str],
    payload: str,
) -> DataFrame:
    """Run a detector on every frame: (keys, points, error).

    The detector returns a list of results, each a list of (x, y); the first is used. No result
    leaves ``points`` null. A failing frame keeps its error text and does not stop the job.
    """
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = factory()
        for batch in batches:
            found, errors = [], []
            for item in batch[payload]:
                try:
                    results = detect(item)
                    points = None
                    if results is not None and len(results):
                        points = [{"x": float(x), "y": float(y)} for x, y in results[0]]
                    found.append(points)
                    errors.append(None)
                except Exception as failure:  # one bad frame must not stop the corpus
                    found.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            out = batch[names].copy()
            out["points"] = pd.Series(found, index=out.index, dtype=object)
            out["error"] = pd.Series(errors, index=out.index, dtype=object)
            yield out

    schema = _schema(frames, names, T.StructField("points", POINTS),
                     T.StructField("error", T.StringType()))
    return frames.select(*names, payload).mapInPandas(run, schema)


def points_table(detected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, point, x, y) of the detected frames."""
    return detected.select(*keys, F.posexplode("points").alias("point", "p")).select(
        *keys, "point", "p.x", "p.y"
    )


def score_model(
    clips: DataFrame, factory: Callable[[], Callable[[Any], Any]], keys: Sequence[str],
    payload: str, length: str = "length",
) -> DataFrame:
    """Run a model on every clip: (keys, length, steps), the length clamped to the steps given."""
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            scores = [np.asarray(model(item), dtype=np.float32) for item in batch[payload]]
            out = batch[names].copy()
            out["length"] = [
                min(int(n), len(s)) for n, s in zip(batch[length], scores)
            ]
            out["steps"] = pd.Series([list(s) for s in scores], index=out.index, dtype=object)
            yield out

    schema = _schema(clips, names, T.StructField("length", T.IntegerType()),
                     T.StructField("steps", STEPS))
    return clips.select(*names, payload, length).mapInPandas(run, schema)


def logits_table(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per step: (keys, length, t, scores)."""
    return scored.select(*keys, "length", F.posexplode("steps").alias("t", "scores"))
