"""File sources: listing, filtering and hashing through Spark's binary reader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import scalars as S

# Extensions that are read.
KNOWN = ("pdf", "docx", "md", "markdown", "txt", "html", "htm", "rst")


def scan_folder(spark: SparkSession, path: str, limit: int = 10_000) -> DataFrame:
    """path, modified, size, kind of the known files, the newest first; content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    return (
        found.where(ext.isin(*KNOWN)).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), S.file_type(F.col("path")).alias("kind"))
        .orderBy(F.desc("modified"), "path").limit(limit)
    )


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content hash of every file below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.sha2("content", 256).alias("hash"))


def path_problem(path: str, roots: list[str], blocked: tuple[str, ...] = (".exe", ".sh", ".bat")) -> str | None:
    """None for a usable path, else the kind of error: outside the roots, hidden, or a blocked extension."""
    real = os.path.realpath(path)
    if not any(real == (r := os.path.realpath(root)) or real.startswith(r + os.sep) for root in roots):
        return "PathTraversal"
    name = os.path.basename(real)
    return "InvalidPath" if name.startswith(".") or name.lower().endswith(blocked) else None


def not_indexed(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files without a chunk of their path."""
    return files.join(chunks.select("path").distinct(), "path", "left_anti")


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, hash) isn't known yet."""
    return files.join(known.select("path", "hash").distinct(), ["path", "hash"], "left_anti")


def drive_changes(remote: DataFrame, known: DataFrame) -> DataFrame:
    """Remote files (file_id, md5, modified) that differ from what is known; without a checksum, id and time stand in."""
    mark = F.coalesce("md5", F.md5(F.concat_ws(":", "file_id", F.col("modified").cast("string"))))
    return remote.withColumn("mark", mark).join(known.select("file_id", "mark").distinct(), ["file_id", "mark"], "left_anti")
