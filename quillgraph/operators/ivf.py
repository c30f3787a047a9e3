"""Approximate nearest neighbours: a coarse quantizer whose cells are partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalars as S

#: Vectors in a block of the index and in one of queries.
BLOCK, QUERIES = 4096, 2048


def fit_cells(vectors: DataFrame, cells: int, column: str = "embedding", seed: int = 1, most: int = 100_000) -> KMeansModel:
    """Cell centres from about ``most`` hash-drawn vectors (documented bound); every vector is indexed afterwards."""
    n = vectors.count()
    drawn = vectors.where(F.pmod(F.xxhash64(column), F.lit(1 << 20)) < int(min(1.0, most / max(n, 1)) * (1 << 20)))
    rows = drawn.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return KMeans(k=cells, seed=seed, maxIter=20).fit(rows)


def index(vectors: DataFrame, model: KMeansModel, column: str = "embedding") -> DataFrame:
    """The vectors with their cell; write it partitioned by ``cell`` so that a search reads few partitions."""
    rows = vectors.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))
    return model.transform(rows).drop("features").withColumnRenamed("prediction", "cell")


def search(indexed: DataFrame, model: KMeansModel, query: list[float], k: int, probes: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` nearest of the ``probes`` nearest cells."""
    order = sorted(range(len(model.clusterCenters())), key=lambda c: sum((a - b) ** 2 for a, b in zip(model.clusterCenters()[c], query, strict=True)))
    q = F.array(*[F.lit(float(x)) for x in query])
    return indexed.where(F.col("cell").isin(order[:probes])).select(key, (1 - S.cosine(F.col(column), q)).alias("distance")).orderBy("distance", key).limit(k)


def probed(queries: DataFrame, model: KMeansModel, probes: int, column: str = "embedding") -> DataFrame:
    """The queries, once for each of their ``probes`` nearest cells."""
    far = [F.struct(S.squared_distance(F.col(column), F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(model.clusterCenters())]
    near = F.slice(F.array_sort(F.array(*far)), 1, probes)
    return queries.withColumn("cell", F.explode(F.transform(near, lambda x: x["cell"])))


def search_all(indexed: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query, key, distance, rank of the ``k`` nearest vectors in the cells of each query; ties by key.

    Both sides carry ``cell``: the cells to probe for queries, one cell everywhere for the exact search. Blocks of queries
    meet blocks of vectors as matrices and leave ``k`` rows a query.
    """
    kind = indexed.schema[key].dataType.simpleString()
    most = lambda df: df.groupBy("cell").count().agg(F.max("count")).first()[0] or 1
    rows, parts = -(-most(indexed) // BLOCK), -(-most(queries) // QUERIES)
    slot = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col(key).alias("query"), F.col(column).alias("q"), F.col("cell").alias("c"), slot(parts).alias("p"), every(rows).alias("r"))
    right = indexed.select(key, column, "cell", slot(rows).alias("row_slot"), every(parts).alias("query_slot"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, out = b.column(key).combine_chunks(), []
        if a.num_rows and b.num_rows:
            unit = lambda col: [v / n if (n := np.linalg.norm(v)) > 0 else v for v in (np.array(x or [], float) for x in col.to_pylist())]
            vectors, names = unit(b.column(column)), np.array(ids.to_pylist())
            of = {n: (at, np.array([vectors[x] for x in at])) for n in {len(x) for x in vectors} for at in [[x for x, y in enumerate(vectors) if len(y) == n]]}
            for q, v in zip(a.column("query").to_pylist(), unit(a.column("q")), strict=True):
                d = np.ones(len(vectors))
                if len(v) in of:
                    d[of[len(v)][0]] = np.round(1 - of[len(v)][1] @ v, 9)
                out += [(q, at, d[at]) for at in np.lexsort((names, d))[:k].tolist()]
        take = ids.take(pa.array([x[1] for x in out], pa.int64()))
        return pa.table({"query": pa.array([x[0] for x in out], ids.type), key: take, "distance": pa.array([x[2] for x in out], pa.float64())})

    met = left.groupBy("c", "p", "r").cogroup(right.groupBy("cell", "query_slot", "row_slot")).applyInArrow(run, f"query {kind}, {key} {kind}, distance double")
    order = Window.partitionBy("query").orderBy("distance", key)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
