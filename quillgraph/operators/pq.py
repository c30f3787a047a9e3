"""Approximate nearest neighbours by product quantisation: cells, byte codes, tables of distances, exact ranking at the end."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalars as S

#: Vectors that the quantisers learn from (drawn by hash; all are indexed), rounds of learning, codebook entries.
SAMPLE, SWEEPS, ENTRIES = 20_000, 12, 256
#: Codes in a block of the index and queries in a block.
BLOCK, QUERIES = 16_384, 1024


@dataclass
class Quantiser:
    """Cell centres (cells x dim) and a codebook a part (parts x entries x dim / parts) for unit vectors."""

    cells: np.ndarray
    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    @property
    def bytes_a_vector(self) -> int:
        """A byte a part, and four of the cell's number."""
        return len(self.books) + 4

    def split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), len(self.books), self.dim // len(self.books))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of unit vectors: codes of what the cell's centre leaves."""
        cell = (x @ self.cells.T - (self.cells**2).sum(1) / 2).argmax(1)
        rest = self.split(x - self.cells[cell])
        codes = np.empty(rest.shape[:2], np.uint8)
        for p, book in enumerate(self.books):
            codes[:, p] = (rest[:, p] @ book.T - (book**2).sum(1) / 2).argmax(1)
        return cell, codes

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances (parts x entries) of a query to all entries within a cell."""
        rest = self.split((q - self.cells[cell])[None])[0]
        return ((self.books - rest[:, None]) ** 2).sum(2)


def unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of length ``dim`` without nulls, the vectors as unit ones); zero vectors stay zero."""
    rows = [(k, v) for k, v in enumerate(column.to_pylist()) if v is not None and len(v) == dim and None not in v]
    x = np.array([v for _, v in rows], float).reshape(-1, dim)
    return np.array([k for k, _ in rows], np.int64), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centres; an empty one takes a drawn vector."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(SWEEPS):
        own = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        order = np.argsort(own, kind="stable")
        got, first = np.unique(own[order], return_index=True)
        centres[got] = np.add.reduceat(x[order], first, 0) / np.diff(np.append(first, len(x)))[:, None]
        empty = np.setdiff1d(np.arange(k), got)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def fit(vectors: DataFrame, cells: int, parts: int, column: str = "embedding", seed: int = 1) -> Quantiser:
    """Learns from about ``SAMPLE`` hash-drawn vectors; the dimension is the most frequent one, a multiple of ``parts``."""
    rows = vectors.where(F.col(column).isNotNull())
    sizes = rows.groupBy(F.size(column).alias("dim")).count().where(F.col("dim") % parts == 0).orderBy(F.desc("count"), "dim").first()
    if sizes is None or not sizes.dim:
        raise ValueError(f"no vectors whose length is a multiple of {parts}")
    share = min(1.0, SAMPLE / sizes["count"])
    drawn = rows.where((F.size(column) == sizes.dim) & (F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)))).select(column)
    x = unit(drawn.toArrow().column(0).combine_chunks(), sizes.dim)[1]  # about SAMPLE rows
    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T)]
    centres = _means(x, min(cells, len(x)), rng)
    rest = (x - centres[(x @ centres.T - (centres**2).sum(1) / 2).argmax(1)]).reshape(len(x), parts, -1)
    return Quantiser(centres, np.stack([_means(rest[:, p], min(ENTRIES, len(x)), rng) for p in range(parts)]))


def codes(vectors: DataFrame, q: Quantiser, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, cell, code (binary) of every vector of the quantiser's dimension."""
    field = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = unit(b.column(1), q.dim)
            cell, code = q.encode(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=[key, "cell", "code"])

    return vectors.select(key, column).mapInArrow(run, f"{key} {field}, cell int, code binary")


def rebuild(vectors: DataFrame, q: Quantiser, path: str, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Writes the index beside ``path``, partitioned by cell, and puts it in the place of the old one by renaming: readers find
    the old index or the new one, whole, and a failed build leaves the old one as it was."""
    spark: SparkSession = vectors.sparkSession
    shadow = f"{path}.shadow-{uuid.uuid4().hex}"
    codes(vectors, q, key, column).repartition("cell").write.partitionBy("cell").parquet(shadow)
    of = spark._jvm.org.apache.hadoop.fs.Path
    new, now, old = of(shadow), of(path), of(f"{path}.old-{uuid.uuid4().hex}")
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(now) and not fs.rename(now, old):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(new, now):
        raise OSError(f"{shadow} can't be put at {path}")
    fs.delete(old, True)
    return spark.read.schema(f"{key} {vectors.schema[key].dataType.simpleString()}, code binary, cell int").parquet(path)


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, q: Quantiser, k: int, probes: int, refine: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query, key, distance (cosine), rank of the ``k`` nearest found for each query; ties by key.

    A query visits its ``probes`` nearest cells. There one table of distances a query scores all codes; the best
    ``refine`` x ``k`` of all its cells are ranked by their vectors, which are read for no others.
    """
    kind, keep = index.schema[key].dataType.simpleString(), refine * k

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = unit(b.column(1), q.dim)
            near = np.argsort(-(x @ q.cells.T - (q.cells**2).sum(1) / 2), 1, kind="stable")[:, :probes]
            each = np.repeat(np.arange(len(at)), near.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[each])), pa.array(near.ravel(), pa.int32()), pa.array([x[i].tobytes() for i in each], pa.binary())], names=["query", "c", "x"])

    asked = queries.select(F.col(key).alias("query"), column).mapInArrow(probed, f"query {kind}, c int, x binary")
    sizes = index.groupBy("cell").agg(F.count("*").alias("n"))
    blocks = sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"))
    wanted = asked.groupBy(F.col("c").alias("cell")).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    shape = blocks.join(wanted, "cell")
    h = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(shape.withColumnRenamed("cell", "c"), "c").select("query", "x", "c", h("query", "parts").alias("p"), every("rows").alias("r"))
    right = index.join(shape, "cell").select(key, "code", "cell", h(key, "rows").alias("row_slot"), every("parts").alias("query_slot"))

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, out = b.column(key).combine_chunks(), []
        if a.num_rows and b.num_rows:
            cell, code = a.column("c")[0].as_py(), np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for name, x in zip(a.column("query").to_pylist(), a.column("x").to_pylist(), strict=True):
                table = q.tables(np.frombuffer(x), cell)
                far = table[0][code[:, 0]]
                for p in range(1, len(table)):
                    far = far + table[p][code[:, p]]
                best = np.argpartition(far, keep)[:keep] if len(far) > keep else np.arange(len(far))
                out += [(name, at, far[at]) for at in best.tolist()]
        return pa.table({"query": pa.array([x[0] for x in out], ids.type), key: ids.take(pa.array([x[1] for x in out], pa.int64())), "far": pa.array([x[2] for x in out], pa.float64())})

    met = left.groupBy("c", "p", "r").cogroup(right.groupBy("cell", "query_slot", "row_slot")).applyInArrow(scan, f"query {kind}, {key} {kind}, far double")
    few = met.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("far", key))).where(F.col("n") <= keep).select("query", key)
    both = few.join(vectors.select(key, F.col(column).alias("v")), key).join(queries.select(F.col(key).alias("query"), F.col(column).alias("w")), "query")
    exact = both.select("query", key, F.round(1 - S.cosine(F.col("v"), F.col("w")), 9).alias("distance"))
    order = Window.partitionBy("query").orderBy("distance", key)
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
