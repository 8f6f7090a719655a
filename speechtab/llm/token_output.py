"""Token ids as Parquet list columns, in ascending document order.

``write_tokens`` deals the texts by ranges of ``doc_id``, so the files follow each other in order and
each is sorted. Ids are dictionary encoded (a vocabulary of 16 bits packs to 16 bits an id), sorted
numbers are delta encoded, row groups and pages have a set size, and Spark's writer adds page
indexes. A range of documents then costs the pages that hold it, and counts cost no ids.

Nulls in ``text`` count as the empty text, which has the end id alone. Rows with a null ``doc_id``
come first. Repeated ``doc_id`` and repeated rows are kept, beside each other. An empty table gives no
documents. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechtab.llm import tokens
from speechtab.llm.common import map_batches, whole_text

#: Bytes of a row group and of a page before compression.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int,
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
) -> None:
    """Write doc_id, n_tokens and token_ids (with ``end_id`` last) of every document."""
    ordered = (
        docs.select("doc_id", whole_text().alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    )
    end = struct.pack("<I", end_id)

    def encode(batches):
        encoder = tokens.word_encoder(tokenizer)
        for batch in batches:
            packed = [encoder(t) + end for t in batch["text"].to_pylist()]
            ends, at = [0], 0
            for ids in packed:
                at += len(ids) // 4
                ends.append(at)
            values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(ids) // 4 for ids in packed], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                ],
                names=["doc_id", "n_tokens", "token_ids"],
            )

    (
        map_batches(ordered, encode, "doc_id long, n_tokens int, token_ids array<int>")
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Documents of a range of ids; page indexes leave out the pages beside it."""
    return spark.read.parquet(path).filter(F.col("doc_id").between(first, last))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of all documents without reading an id.

    Sizes of whole files are summed first, so the running sum never meets in one task.
    """
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", *_place())
    return _with_start(rows, rows).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", *_place(), "token_ids")

    def digest(batches):
        for batch in batches:
            ids = batch["token_ids"]
            ends = ids.offsets.to_pylist()
            values = memoryview(ids.values.cast(pa.int32()).to_numpy(zero_copy_only=False)).cast("B")
            sums = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(ends, ends[1:])]
            kept = [batch[c] for c in ("doc_id", "n_tokens", "file", "row")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sums, pa.int64())],
                names=["doc_id", "n_tokens", "file", "row", "ids_crc32"],
            )

    found = map_batches(rows, digest, "doc_id long, n_tokens int, file string, row long, ids_crc32 long")
    return _with_start(found, rows).select(
        "doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )


def _place() -> list:
    return [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]


def _with_start(rows: DataFrame, written: DataFrame) -> DataFrame:
    """Sizes of files come from ``written``, which costs no ids."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = written.groupBy("file").agg(F.sum("n_tokens").alias("size")).select(
        "file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip")
    )
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(files, "file")
        .withColumn("start", F.col("skip") + F.col("inside"))
    )
