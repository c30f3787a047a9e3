"""Structured Streaming: file feeds, windows, registers, micro-batch commits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition: str | None = None) -> None:
    """Run a stream over all that is there and stop; restarts go on from the checkpoint."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    (w.partitionBy(partition) if partition else w).start().awaitTermination()


def rate_windows(events: DataFrame, limit: int, window: str = "60 seconds", late: str | None = "10 minutes") -> DataFrame:
    """Users over ``limit`` requests a window: window_start, user_id, n. Works on streams and tables."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    g = rows.groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.where(F.col("n") > limit).select(F.col("w.start").alias("window_start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of each user (an addition to the reference's own behaviour)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")


def registers(updates: DataFrame) -> DataFrame:
    """Last-writer-wins state of (node, field): emits a register whenever its value changes hands."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        for p in parts:
            for ts, seq, value in p.sort_values(["ts", "seq"])[["ts", "seq", "value"]].itertuples(index=False):
                if held is None or (ts, seq) >= held[:2]:
                    held = (int(ts), int(seq), str(value))
        state.update(held)
        yield pd.DataFrame([[*key, *held]], columns=["node", "field", "ts", "seq", "value"])

    out = "node string, field string, ts long, seq long, value string"
    return updates.groupBy("node", "field").applyInPandasWithState(step, out, "ts long, seq long, value string", "update", GroupStateTimeout.NoTimeout)


def commit_batches(stream: DataFrame, path: str, checkpoint: str, key: str, seq: str, every: str | None = None) -> None:
    """Upsert micro-batches into a table of versions, the last two of which stay; a replayed batch writes its own version again."""
    from quillgraph.operators.store import latest, upsert, versions, write_version

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < number]
        new = upsert(spark.read.parquet(f"{path}/v{before[-1]}"), batch, key, seq) if before else latest(batch, [key], F.desc(seq)).drop(seq)
        write_version(new, path, number)

    w = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start().awaitTermination()


def job_progress(events: DataFrame) -> DataFrame:
    """Latest state of each job: (job, status, done)."""
    return events.groupBy("job").agg(F.max_by("status", "seq").alias("status"), F.max("done").alias("done"))
