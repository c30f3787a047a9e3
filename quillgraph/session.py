"""Session and table helpers shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "quillgraph") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; Spark's own readers resolve the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one is set only for a local master that names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = found or os.path.join(tempfile.gettempdir(), "quillgraph-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found or held.get()


#: Names of the tables that ``written`` made and that are still there.
_WRITTEN: set[str] = set()


def _path(spark: SparkSession, path: str):
    """(file system, Hadoop path)"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared folder and reread.

    As ``cut``, but its plan knows the size of what was written; the estimate of a checkpointed plan is the product of all
    joins before it, which doubles its digits a round in a loop. Row order is not kept. What ``forget`` and ``steps`` leave
    is deleted when the driver ends.
    """
    spark = df.sparkSession
    name = f"written-{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{name}"
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    _WRITTEN.add(name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _names(df: DataFrame) -> set[str]:
    """The tables of ``written`` that ``df`` reads."""
    return {name for f in df.inputFiles() if (name := f.rsplit("/", 2)[-2]) in _WRITTEN}


def _delete(spark: SparkSession, names: set[str]) -> None:
    for name in names:
        fs, at = _path(spark, f"{checkpoint_dir(spark)}/{name}")
        fs.delete(at, True)
        _WRITTEN.discard(name)


def forget(df: DataFrame) -> None:
    """Delete the tables of ``written`` that ``df`` reads, and nothing else; nothing may read them any more."""
    _delete(df.sparkSession, _names(df))


#: Bytes of input files that a partition of a loop's shuffles stands for, and of shuffled rows; how much larger rows are in memory
#: than in files of numbers, so that a small file of many rows isn't sent to the driver and every executor.
PART_INPUT, PART_SHUFFLED, UNPACKED = 4 << 20, "16MB", "10.0"


def _size(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads."""
    at = (_path(df.sparkSession, f) for f in df.inputFiles())
    return sum(fs.getFileStatus(path).getLen() for fs, path in at)


@contextmanager
def _sized(spark: SparkSession, inputs: tuple[DataFrame, ...]) -> Iterator[None]:
    """Queries run inside have as many shuffle partitions as their ``inputs`` need, so that what a task holds doesn't grow with
    them; never fewer than the session names."""
    name = "spark.sql.shuffle.partitions"
    parts = max(int(spark.conf.get(name)), -(-sum(map(_size, inputs)) // PART_INPUT))
    wanted = {name: str(parts), "spark.sql.adaptive.advisoryPartitionSizeInBytes": PART_SHUFFLED, "spark.sql.sources.fileCompressionFactor": UNPACKED}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def steps(spark: SparkSession, *inputs: DataFrame) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was written inside, but for the tables that the function it yields has written. Partitions are
    sized for ``inputs``."""
    before, kept = set(_WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        here = set(_WRITTEN)
        out = written(df)
        kept.update(_WRITTEN - here)
        return out

    try:
        with _sized(spark, inputs):
            yield keep
    finally:
        _delete(spark, _WRITTEN - before - kept)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The files are replicated by the shared store, so a lost executor costs a re-read, never a recompute of the plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans made inside drop their shuffle files as soon as their one action, such as ``cut``, has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
