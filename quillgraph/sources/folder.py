"""Folders as a Spark source: the known files below a folder, listed by the executors.

``spark.read.format("folder")`` lists a folder that all executors see, a partition a sub-folder of the first two levels. Links
are not followed, and folders deeper than ``depth`` are not entered.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillgraph.functions import scalars as S
from quillgraph.sources.files import KNOWN

DEPTH, LIMIT = 5, 10_000
SCHEMA = "path string, modified timestamp, size long, depth int, place array<string>"


class Folder(InputPartition):
    """A folder to list; ``deep``: with all below it, else only the files in it."""

    def __init__(self, path: str, level: int, deep: bool) -> None:
        super().__init__(path)
        self.path, self.level, self.deep = path, level, deep


def _entries(path: str) -> list[os.DirEntry]:
    """What a folder holds, by name, without links; nothing if it can't be read."""
    try:
        with os.scandir(path) as found:
            return sorted((e for e in found if not e.is_symlink()), key=lambda e: e.name)
    except OSError:
        return []


class FolderReader(DataSourceReader):
    def __init__(self, root: str, depth: int) -> None:
        self.root, self.depth = os.path.abspath(root), depth

    def partitions(self) -> list[Folder]:
        out, level = [Folder(self.root, 0, self.depth == 0)], [self.root]
        for k in (1, 2):  # the folders of two levels; what lies deeper is listed by the tasks
            if k > self.depth:
                break
            level = [e.path for p in level for e in _entries(p) if e.is_dir(follow_symlinks=False)]
            out += [Folder(p, k, k == 2) for p in level]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [(partition.path, partition.level)]
        while todo:
            path, level = todo.pop()
            for e in _entries(path):
                if e.is_dir(follow_symlinks=False):
                    if partition.deep and level < self.depth:
                        todo.append((e.path, level + 1))
                    continue
                ext = e.name.rpartition(".")[2].lower()
                if "." in e.name and ext in KNOWN:
                    at = e.stat(follow_symlinks=False)
                    place = os.path.relpath(e.path, self.root).split(os.sep)
                    yield e.path, datetime.fromtimestamp(at.st_mtime, UTC), at.st_size, level, place


class FolderSource(DataSource):
    """Options: path, depth."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:  # noqa: ARG002
        return FolderReader(self.options["path"], int(self.options.get("depth", DEPTH)))


def scan(spark: SparkSession, path: str, depth: int = DEPTH, limit: int = LIMIT) -> DataFrame:
    """path, modified, size, kind, depth of the first ``limit`` known files in the order of a walk by name, the newest first."""
    spark.dataSource.register(FolderSource)
    found = spark.read.format("folder").option("depth", str(depth)).load(path)
    first = found.orderBy("place").limit(limit)
    return first.select("path", "modified", "size", S.file_type(F.col("path")).alias("kind"), "depth").orderBy(F.desc("modified"), "path")
