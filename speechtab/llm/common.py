"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.session import scratch_path

#: Rows that a Python worker holds at once; long texts make a row large.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds; the default counts rows only and texts differ a lot."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def map_batches(
    df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(step, schema)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again.

    A lost executor then costs its own tasks only, and what the plan above shuffled can go.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    del df  # or its plan holds on to the shuffles
    release(spark)
    read = spark.read.parquet(path)
    read.scratch_path = path
    return read


def discard(*written: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read again."""
    for df in written:
        _delete(df.sparkSession, df.scratch_path)
    release(written[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps.

    It does so when the driver collects its garbage, which may be long after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        context = spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may have ended already
        pass


def whole_groups(
    batches: Iterable[pa.RecordBatch], key: str, rows: int = 20_000
) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows of a partition that is sorted by ``key``; none splits a key."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held < rows:
            continue
        table_ = pa.Table.from_batches(waiting)
        keys = table_[key].to_numpy()
        stop = int(np.searchsorted(keys, keys[-1]))
        if stop:
            yield table_.slice(0, stop).combine_chunks()
            table_ = table_.slice(stop)
        waiting, held = table_.to_batches(), table_.num_rows
        rows = max(rows, 2 * held)  # a large group isn't looked through again for each batch
    if held:
        yield pa.Table.from_batches(waiting).combine_chunks()
