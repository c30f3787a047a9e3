"""Retrieval: BM25, vectors, graph proximity and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import scalars as S
from quillgraph.session import written

K1, B = 1.2, 0.75
WEIGHTS = (0.6, 0.3, 0.1)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at most 40 characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.length(t) <= 40))


def bm25(docs: DataFrame, terms: list[str], k: int | None = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, highlights of the ``k`` best (all if None); ties by key.

    Texts are read and split once: their length and the query's term counts are written as a narrow table, from which the
    corpus statistics, one aggregated row that is joined by broadcast, and the scores come. No text is exploded or shuffled.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    rows = docs.select(F.col(key), tokens(F.col(text)).alias("ts"))
    tf = [F.size(F.filter("ts", _is(w))) for w in terms]
    rows = written(rows.select(key, F.size("ts").alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)]))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    both = rows.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row of statistics
    parts = []
    for i in range(len(terms)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        parts.append(F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0))
    shown = F.array_sort(F.filter(F.array(*[F.when(F.col(f"tf{i}") > 0, F.lit(w)) for i, w in enumerate(terms)]), lambda x: x.isNotNull()))
    out = both.select(key, sum(parts[1:], parts[0]).alias("score"), shown.alias("highlights"))
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def _is(word: str):
    return lambda t: t == word


def vector_top(vectors: DataFrame, query: list[float], k: int | None, metric: str = "cosine", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, distance, vector_score of the ``k`` nearest; exact, one pass, top-k kept per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    distance = 1 - S.cosine(F.col(column), q) if metric == "cosine" else S.squared_distance(F.col(column), q)
    out = vectors.select("*", distance.alias("distance")).withColumn("vector_score", S.vector_score(F.col("distance")))
    return out if k is None else out.orderBy("distance", key).limit(k)


def fuse(vector: DataFrame, keyword: DataFrame, graph: DataFrame, weights: tuple[float, float, float] = WEIGHTS, key: str = "chunk_id") -> DataFrame:
    """Weighted sum over three channels (key, score); an id missing in one scores 0 there. One aggregation, no joins."""
    names = ("vector_score", "keyword_score", "graph_score")
    parts = None
    for df, mine in zip((vector, keyword, graph), names, strict=True):
        part = df.select(key, *[(F.col("score") if n == mine else F.lit(None)).cast("double").alias(n) for n in names])
        parts = part if parts is None else parts.unionByName(part)
    out = parts.groupBy(key).agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])
    final = sum((w * F.col(n) for w, n in zip(weights[1:], names[1:], strict=True)), weights[0] * F.col(names[0]))
    return out.withColumn("final_score", final)


def topic_postfilter(hits: DataFrame, topics: list[str]) -> DataFrame:
    """Case-insensitive overlap; unknown (null) topics are kept, empty ones are not."""
    low = F.array(*[F.lit(t.lower()) for t in topics])
    return hits.where(F.col("topics").isNull() | F.arrays_overlap(F.transform("topics", lambda t: F.lower(t)), low))


def page(df: DataFrame, offset: int, limit: int, *order) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def nearest_nodes(nodes: DataFrame, query: list[float], k: int = 5, key: str = "id", column: str = "embedding") -> DataFrame:
    """(id): the seeds of a graph search, the ``k`` nodes nearest to the query; the ``k`` least ids where no node has a vector."""
    held = nodes.where(F.col(column).isNotNull())
    near = vector_top(held.select(key, column), query, None, key=key, column=column).orderBy(F.round("distance", 9), key).limit(k).select(F.col(key).alias("id"))
    return nodes.select(F.col(key).alias("id")).orderBy("id").limit(k) if near.isEmpty() else near


def graph_channel(edges: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = 2, key: str = "chunk_id") -> DataFrame:
    """(key, score): chunks by the nearest reached node that they mention, 1 / (hop + 1). ``links``: node, chunk.

    The edges are written once, both ways; the few hops are one lazy plan over them, its frontiers the small sides.
    """
    e = edges.select("src", "dst")
    e = written(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    front = near = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        front = e.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("hop", F.lit(hop))
        near = near.unionByName(front)
    near = near.groupBy("id").agg(F.min("hop").alias("hop"))
    return links.join(near, links["node"] == near["id"]).groupBy(F.col("chunk").alias(key)).agg(F.max(S.hop_score(F.col("hop"))).alias("score"))


MODES = ("hybrid", "vector", "keyword", "graph")


def search(vector: DataFrame | None, keyword: DataFrame | None, graph: DataFrame | None, mode: str = "hybrid", weights: tuple[float, float, float] = WEIGHTS, key: str = "chunk_id") -> DataFrame:
    """The fused channels (key, score) of a mode; a channel that is missing or not of the mode scores 0, and a mode with one
    channel takes its score as it is."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    channels = {"vector": vector, "keyword": keyword, "graph": graph}
    some = next(c for c in channels.values() if c is not None)
    taken = [c if c is not None and mode in ("hybrid", name) else some.limit(0) for name, c in channels.items()]
    return fuse(*taken, weights if mode == "hybrid" else tuple(float(mode == n) for n in channels), key)
