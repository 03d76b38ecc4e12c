"""Held files and their digests.

Spark's own file sources leave out names that begin with ``_`` or ``.`` and hold a file in one row, so
files are listed by a data source of this module and hashed block by block. Both read through
pyarrow's file systems (local and mounted folders, S3, GCS, HDFS), in tasks.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES = 4 << 20  # of a file held in memory at once
PROJECTS = 64  # folders listed by one task
LISTED_AT_ONCE = 4096

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library


def _file_system(root: str):
    """The file system of a root and the root's path in it; a path without a scheme is a local one."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = f"/{root[5:].lstrip('/')}"
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


class _Folders(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Listing(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        """The project folders, some for each task; what they hold is listed there."""
        from pyarrow import fs

        system, path = _file_system(self.root)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = sorted(i.base_name for i in found if i.type == fs.FileType.Directory)
        return [_Folders(names[k:k + PROJECTS]) for k in range(0, len(names), PROJECTS)] or [_Folders([])]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = _file_system(self.root)
        for name in partition.names:
            base = f"{path.rstrip('/')}/{name}"
            waiting, paths = [base], []
            while waiting:  # folder by folder, so that no list holds a whole tree
                for info in system.get_file_info(fs.FileSelector(waiting.pop(), allow_not_found=True)):
                    if info.type == fs.FileType.Directory:
                        waiting.append(info.path)
                    elif info.type == fs.FileType.File:
                        paths.append(info.path[len(base) + 1:])
                if len(paths) >= LISTED_AT_ONCE:
                    yield self._batch(name, paths)
                    paths = []
            yield self._batch(name, paths)

    @staticmethod
    def _batch(name: str, paths: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(paths), pa.string()), pa.array(paths, pa.string())],
                                          ["project_id", "rel_path"])


class HeldFiles(DataSource):
    """(project_id, rel_path) of every file below the folders of ``path``, whatever its name."""

    @classmethod
    def name(cls) -> str:
        return "held_files"

    def schema(self) -> str:
        return "project_id string, rel_path string"

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options["path"])


def list_held(spark: SparkSession, root: str) -> DataFrame:
    """(project_id, rel_path) of all files below the project folders; no contents are read."""
    spark.dataSource.register(HeldFiles)
    return spark.read.format("held_files").load(root)


def digests(paths: DataFrame, root: str) -> DataFrame:
    """``paths`` (project_id, rel_path) with file_sha256; files are read a block at a time, of any size."""
    block = BLOCK_BYTES

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(root)
        for batch in batches:
            out = []
            for project, rel in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                state = hashlib.sha256()
                with system.open_input_stream(f"{path.rstrip('/')}/{project}/{rel}", compression=None) as stream:
                    while part := stream.read(block):
                        state.update(part)
                out.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["project_id", "rel_path", "file_sha256"])

    return paths.select("project_id", "rel_path").mapInArrow(hashed, "project_id string, rel_path string, file_sha256 string")


def contents(paths: DataFrame, root: str) -> DataFrame:
    """``paths`` (project_id, rel_path) with the bytes of each file as ``content``; for files of a row's size."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(root)
        for batch in batches:
            for project, rel in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with system.open_input_stream(f"{path.rstrip('/')}/{project}/{rel}", compression=None) as stream:
                    yield pa.RecordBatch.from_arrays([pa.array([project]), pa.array([rel]), pa.array([stream.read()], pa.binary())],
                                                     ["project_id", "rel_path", "content"])

    return paths.select("project_id", "rel_path").mapInArrow(read, "project_id string, rel_path string, content binary")


def scan_held(spark: SparkSession, root: str, glob: str = "*", named: DataFrame | None = None) -> DataFrame:
    """(project_id, rel_path, file_sha256) of the files below the project folders.

    ``glob`` is matched against the file's name. With ``named`` (project_id, rel_path) only files it
    names are read; they are dealt anew, so one project's files are hashed by many tasks.
    """
    held = list_held(spark, root)
    if glob != "*":
        pattern = "^" + "".join({"*": ".*", "?": "."}.get(c, f"\\Q{c}\\E") for c in glob) + "$"
        held = held.filter(F.substring_index("rel_path", "/", -1).rlike(pattern))
    if named is not None:
        held = held.join(named.select("project_id", "rel_path").distinct(), ["project_id", "rel_path"], "left_semi")
    return digests(held.repartition("project_id", "rel_path"), root)
