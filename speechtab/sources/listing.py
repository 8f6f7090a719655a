"""A data source that lists files, folder by folder, and writes small ones.

Listing is spread over tasks by top folder. Only names and sizes are read, so empty files are found as well.
Folders are reached through Arrow's file systems: local and shared paths, HDFS and object stores.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that are held at once to hash it.
READ_BYTES = 1 << 20
FILE_SCHEMA = "relative_path string, bytes bigint, modified timestamp"


def open_folder(root: str):
    """(file system, path in it) of a folder."""
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


class TopFolder(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _FolderReader(DataSourceReader):
    def __init__(self, root: str, glob: str):
        self.root, self.glob = root.rstrip("/"), glob

    def _entries(self, below: str, recursive: bool):
        from pyarrow import fs

        system, path = open_folder(self.root)
        return path, system.get_file_info(fs.FileSelector(f"{path}/{below}".rstrip("/"), recursive=recursive, allow_not_found=True))

    def partitions(self) -> list[TopFolder]:
        """One for each top folder that the pattern admits, and one for files that lie beside them."""
        top, _, rest = self.glob.partition("/")
        if not rest:
            return [TopFolder("")]
        _, entries = self._entries("", recursive=False)
        names = sorted(e.base_name for e in entries if not e.is_file and fnmatch.fnmatchcase(e.base_name, top))
        return [TopFolder(n) for n in names] or [TopFolder("")]

    def read(self, partition: TopFolder) -> Iterator[tuple]:
        path, entries = self._entries(partition.name, recursive=bool(partition.name))
        parts = self.glob.split("/")
        for entry in entries:
            relative = entry.path[len(path.rstrip("/")) + 1:] if entry.path.startswith(path) else entry.path
            names = relative.split("/")
            # A star stays inside one folder, so both have as many parts.
            if entry.is_file and len(names) == len(parts) and all(map(fnmatch.fnmatchcase, names, parts)):
                yield relative, entry.size, entry.mtime


class FolderListing(DataSource):
    """``spark.read.format("folder_listing").option("root", ...).option("glob", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema: T.StructType) -> _FolderReader:
        return _FolderReader(self.options["root"], self.options.get("glob", "*/*"))


def list_folder(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(relative_path, bytes, modified) of files below a folder, empty ones included."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("root", root).option("glob", glob).load()


def write_files(files: DataFrame, root: str, path: str = "relative_path", content: str = "content") -> DataFrame:
    """Write each row's binary content to its own file; (path, bytes) of what was written, once it is read.

    A task that runs again writes the same files again.
    """
    import pyarrow as pa

    def step(batches):
        system, base = open_folder(root)
        made = set()
        for batch in batches:
            sizes = []
            for name, data in zip(batch[path].to_pylist(), batch[content].to_pylist()):
                target = f"{base.rstrip('/')}/{name}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target) as out:
                    out.write(data or b"")
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([batch[path], pa.array(sizes, pa.int64())], names=[path, "bytes"])

    return files.select(path, content).mapInArrow(step, f"{path} string, bytes bigint")


def hash_files(listed: DataFrame, root: str, path: str = "relative_path") -> DataFrame:
    """The files of a listing with the SHA-256 of their contents, read piece by piece in the tasks.

    The driver sees no file: Spark's own readers would first gather the state of each one there.
    """
    import pyarrow as pa

    def step(batches):
        system, base = open_folder(root)
        for batch in batches:
            digests = []
            for name in batch[path].to_pylist():
                digest = hashlib.sha256()
                with system.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None) as source:
                    while piece := source.read(READ_BYTES):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=names)

    schema = T.StructType([*listed.schema.fields, T.StructField("sha256", T.StringType())])
    names = schema.names
    # A listing has as many parts as there are top folders, and those may differ a lot. With a number given, Spark
    # doesn't put parts together for their few bytes of names.
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, path).mapInArrow(step, schema)
