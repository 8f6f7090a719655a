"""Manifest, box, log and block tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = (
    "sample_id string, speaker_id string, video_path string, alignment_path string, "
    "transcript string, duration_s double, num_frames int, fps double, width int, height int, "
    "target_length int, min_ctc_frames int"
)
BOX_SCHEMA = (
    "sample_id string, x1 double, y1 double, x2 double, y2 double, valid_detections int, "
    "sampled_frames int, source string"
)
RESULT_SCHEMA = (
    "sample_id string, speaker string, video string, output string, decoded_frames bigint, "
    "landmark_frames bigint, dropped_frames bigint"
)


def write_csv(df: DataFrame, path: str, schema: str) -> None:
    """Columns of ``schema`` in order, with a header, one file per partition."""
    names = [part.split()[0] for part in schema.split(", ")]
    df.select(*names).write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed read that fails on a value that does not fit."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", escape='"')


def write_manifest(df: DataFrame, path: str) -> None:
    write_csv(df, path, MANIFEST_SCHEMA)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MANIFEST_SCHEMA)


def write_boxes(df: DataFrame, path: str) -> None:
    write_csv(df, path, BOX_SCHEMA)


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, BOX_SCHEMA)


def write_documents(df: DataFrame, path: str) -> None:
    """Each row as one JSON document, stored as a variant; non-ASCII and nulls kept."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(F.parse_json(text).alias("document")).write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns of documents: name to (JSON path, type); null where a document lacks the field."""
    return spark.read.parquet(path).select(*[
        F.try_variant_get("document", place, kind).alias(name) for name, (place, kind) in fields.items()
    ])


def append_log(results: DataFrame, path: str, run: int, position: Column) -> None:
    """Append results; ``run`` grows with every append and ``position`` orders the rows of one."""
    results.withColumns({"run": F.lit(run).cast("bigint"), "position": position.cast("bigint")}).write.mode(
        "append"
    ).json(path)


def read_log(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Result log in JSON Lines with the place of each entry, oldest entries included."""
    return spark.read.schema(f"{schema}, run bigint, position bigint").json(path).withColumn(
        "logged_at", F.struct("run", "position")
    ).drop("run", "position")


def latest_results(log: DataFrame, key: str = "sample_id", at: Column | str = "logged_at"
                   ) -> DataFrame:
    """Last write wins per key; the aggregate combines before the shuffle."""
    names = [c for c in log.columns if c != key]
    order = F.col(at) if isinstance(at, str) else at
    kept = [n for n in names if n != "logged_at"]
    return log.groupBy(key).agg(
        F.max_by(F.struct(*kept), F.struct(order, *[n for n in names if n != at])).alias("r")
    ).select(key, "r.*")


def _folder(spark: SparkSession, path: str):
    """(file system, path) on the JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions of a block table."""
    system, place = _folder(spark, f"{path}/index")
    found = list(system.listStatus(place)) if system.exists(place) else []
    return sorted(int(f.getPath().getName().removeprefix("version=")) for f in found)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Write blocks (``block_id``, ``position``, any columns); a block written again replaces the earlier one.

    Many blocks share a file. Data of a version are written first, then its index, one row a block with its first
    and last position and rows, beside the others. Renaming the index into its place commits the version; what a
    killed write leaves behind is not read.
    """
    spark, path = blocks.sparkSession, path.rstrip("/")
    version = max(_versions(spark, path), default=-1) + 1
    attempt = uuid.uuid4().hex
    data, staged = f"{path}/data/{attempt}", f"{path}/staged/{attempt}"
    blocks.repartitionByRange("block_id", "position").sortWithinPartitions("block_id", "position").write.parquet(data)
    spark.read.parquet(data).groupBy("block_id").agg(
        F.min("position").alias("first_position"), F.max("position").alias("last_position"), F.count("*").alias("rows"),
    ).withColumn("attempt", F.lit(attempt)).write.parquet(staged)
    system, source = _folder(spark, staged)
    target = _folder(spark, f"{path}/index/version={version}")[1]
    system.mkdirs(target.getParent())
    # A rename onto a folder that another writer made meanwhile would move into it.
    if system.exists(target) or not system.rename(source, target):
        raise OSError(f"version {version} of {path} was written by somebody else")


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """The latest committed row of each block: positions, rows and where its data are."""
    index = spark.read.option("basePath", f"{path}/index").parquet(f"{path}/index/*")
    names = ["first_position", "last_position", "rows", "attempt"]
    return index.groupBy("block_id").agg(F.max_by(F.struct(*names), "version").alias("i")).select("block_id", "i.*")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all blocks as last committed."""
    path = path.rstrip("/")
    index = block_index(spark, path).select("block_id", "attempt")
    written = [r["attempt"] for r in index.select("attempt").distinct().collect()]  # one for each write
    data = spark.read.parquet(*[f"{path}/data/{a}" for a in written]).withColumn(
        "attempt", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    )
    return data.join(index, ["block_id", "attempt"]).drop("attempt")


def reject_lines(rows: DataFrame, key: str, kind: Column, message: Column) -> DataFrame:
    """Dead-letter lines: key, tab, error kind and message."""
    return rows.select(
        key, F.concat(F.col(key).cast("string"), F.lit("\t"), kind, F.lit(": "), message).alias("line")
    )


