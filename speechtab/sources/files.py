"""File discovery and fingerprints from file metadata; contents are read only when hashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.sources.listing import hash_files, list_folder

MEDIA_GLOB = "spk*/ser/video_a/*.mp4"
ANNOTATION_GLOB = "spk*/alignment/*.align"


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, relative_path, bytes, modified) of matching files, empty ones too; no content is read."""
    base = root.rstrip("/")
    return list_folder(spark, base, glob).select(
        F.concat(F.lit(f"{base}/"), "relative_path").alias("path"), "relative_path", "bytes", "modified"
    )


def discover_files(
    spark: SparkSession, root: str, glob: str = MEDIA_GLOB
) -> DataFrame:
    """(sample_id, speaker_id, path, copies): the file stem is the key, the top folder the speaker.

    Files with the same stem would overwrite each other; the first path is kept and ``copies`` > 1
    flags the clash.
    """
    files = list_files(spark, root, glob)
    return (
        files.select(
            file_stem(F.col("path")).alias("sample_id"),
            F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("speaker_id"),
            "relative_path",
        )
        .groupBy("sample_id")
        .agg(
            F.min_by("speaker_id", "relative_path").alias("speaker_id"),
            F.min("relative_path").alias("path"),
            F.count("*").alias("copies"),
        )
    )


def require_files(files: DataFrame) -> DataFrame:
    """An empty media set is an error."""
    if files.isEmpty():
        raise ValueError("no media files found")
    return files


def frame_folders(frames: DataFrame, path: str = "relative_path") -> DataFrame:
    """(folder, frames, bad_names) of picture folders; names must be numbers.

    ``frames`` counts numeric .jpg/.jpeg files of either case. Folders without any picture do not
    appear.
    """
    pictures = frames.filter(F.lower(F.col(path)).rlike(r"\.jpe?g$"))
    number = file_stem(F.col(path)).try_cast("bigint")
    return pictures.groupBy(
        F.regexp_replace(F.col(path), r"/[^/]*$", "").alias("folder")
    ).agg(
        F.count(number).alias("frames"), F.count_if(number.isNull()).alias("bad_names")
    )


def scan_frame_folders(spark: SparkSession, root: str, glob: str = "*/video/video_a/*/*"
                       ) -> DataFrame:
    return frame_folders(list_files(spark, root, glob))


def parse_file_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """One relative path per line: speaker is the 4th part from the end, name the last.

    Blank lines vanish; ``error`` marks paths that are not deep enough.
    """
    trimmed = lines.withColumn("path", F.trim(F.col(line))).filter(F.length("path") > 0)
    parts = F.split("path", "/", -1)
    deep = F.size(parts) >= 4
    return trimmed.withColumns({
        "speaker_id": F.when(deep, F.element_at(parts, -4)),
        "name": F.when(deep, F.element_at(parts, -1)),
        "error": F.when(~deep, "path_too_short"),
    })


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_file_list(spark.read.text(path)).drop("value")


def inventory(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Relative path, size and SHA-256 of the content; empty files have the digest of nothing."""
    return hash_files(list_files(spark, root, glob).select("relative_path", "bytes"), root)


def select_paths(files: DataFrame, folder: str = "/alignment/", suffix: str = ".align",
                 path: str = "path") -> DataFrame:
    """Members of one folder kind with one ending."""
    return files.filter(F.contains(F.col(path), F.lit(folder)) & F.endswith(F.col(path), F.lit(suffix)))
