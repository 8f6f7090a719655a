"""Incremental, resumable intake of new rows or files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _keys_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, beyond the memory of executors."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


class Intake:
    """Each key is processed once, failures are kept, results land in one folder per micro-batch.

    The keys that were seen are the state of the stream, one row a key in the state store, so a micro-batch reads
    nothing that earlier ones have written. What a batch brings is written in one job, results and rejects
    together; the same batch run again after a failure starts from the state it had and replaces its
    folder. Of several rows with one key in a batch one is taken. Rows with a null key and rows
    for which ``failed`` is null are kept among the rejects.
    """

    def __init__(self, root: str, key: str, failed: Column,
                 process: Callable[[DataFrame], DataFrame] = lambda df: df):
        base = root.rstrip("/")
        self.key, self.failed, self.process = key, failed, process
        self.outcomes, self.checkpoint = f"{base}/outcomes", f"{base}/checkpoint"

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of rows that are new."""
        # A row whose outcome can't be told has failed, and so has a row without a key.
        failed = F.col(self.key).isNull() | F.coalesce(self.failed, F.lit(True))
        done = self.process(batch.withColumn("failed", failed))
        done.write.mode("overwrite").partitionBy("failed").parquet(f"{self.outcomes}/batch_id={batch_id}")

    def run(self, stream: DataFrame) -> None:
        """Process everything that is available, then stop. Call again to continue."""
        fresh = stream.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        nameless = stream.filter(F.col(self.key).isNull())
        with _keys_on_disk(stream.sparkSession):
            query = (
                fresh.unionByName(nameless).writeStream.foreachBatch(self.take)
                .option("checkpointLocation", self.checkpoint)
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()

    def _read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """What was written; ``schema`` is that of a processed row."""
        places = [T.StructField("batch_id", T.LongType()), T.StructField("failed", T.BooleanType())]
        return spark.read.schema(T.StructType([*schema.fields, *places])).parquet(self.outcomes)

    def results(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        return self._read(spark, schema).filter("NOT failed").drop("failed", "batch_id")

    def rejects(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        return self._read(spark, schema).filter("failed").drop("failed", "batch_id")

    def progress(self, spark: SparkSession) -> DataFrame:
        """Results and failures per micro-batch, from the folders alone."""
        kind = F.when(F.col("failed"), "failures").otherwise("results").alias("kind")
        return self._read(spark, T.StructType()).groupBy("batch_id", kind).agg(F.count("*").alias("n"))


def file_stream(spark: SparkSession, root: str, schema: T.StructType, pattern: str,
                files_per_batch: int | None = None, columns: Sequence[str] | None = None
                ) -> DataFrame:
    """New Parquet files below a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(root)
    return stream.select(*columns) if columns else stream
