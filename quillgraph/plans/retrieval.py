"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import retrieval as R
from quillgraph.registry import register
from quillgraph.session import table
from quillgraph.sources import domain as D

TERMS = ["the", "and", "die", "que", "thereas"]
_TS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '' AND length(t) <= 40)"
BM25 = f"""
tk AS (SELECT doc_id, {_TS} AS ts FROM documents),
tf AS (SELECT doc_id, q, len(list_filter(ts, lambda t: t = q)) AS f, len(ts) AS dl FROM tk, (SELECT unnest({TERMS}) AS q) qs),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tk),
df AS (SELECT q, count(*) FILTER (WHERE f > 0) AS df FROM tf GROUP BY q),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score,
       string_agg(q, ',' ORDER BY q) AS highlights FROM tf JOIN df USING (q), st WHERE f > 0 GROUP BY doc_id)"""


def _query_vector(spark, d) -> list[float]:
    """One row by id: the query of the vector searches."""
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


VEC = "q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0), ve AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], qe) AS distance FROM embeddings, q)"


@register("bm25_search", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_search(spark, d):
    return R.bm25(table(spark, d, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score"))


@register("highlights", f"WITH {BM25} SELECT doc_id, highlights FROM bm")
def highlights(spark, d):
    return R.bm25(table(spark, d, "documents"), TERMS, None).select("doc_id", F.array_join("highlights", ",").alias("highlights"))


@register("vector_search", "WITH q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(greatest(0, 1 - pow(list_distance(embedding::DOUBLE[], qe), 2)), 5) AS score FROM embeddings, q ORDER BY round(pow(list_distance(embedding::DOUBLE[], qe), 2), 9), vec_id LIMIT 20")
def vector_search(spark, d):
    out = R.vector_top(table(spark, d, "embeddings"), _query_vector(spark, d), None, metric="l2sq")
    return out.orderBy(F.round("distance", 9), "vec_id").limit(20).select("vec_id", F.round("vector_score", 5).alias("score"))


@register("vector_search_cosine", f"WITH {VEC} SELECT vec_id, round(greatest(0, 1 - distance), 5) AS score FROM ve ORDER BY round(distance, 9), vec_id LIMIT 20")
def vector_search_cosine(spark, d):
    out = R.vector_top(table(spark, d, "embeddings"), _query_vector(spark, d), None)
    return out.orderBy(F.round("distance", 9), "vec_id").limit(20).select("vec_id", F.round("vector_score", 5).alias("score"))


@register("topic_prefilter", f"WITH {VEC} SELECT vec_id, round(greatest(0, 1 - distance), 5) AS score FROM ve WHERE label IN (1, 3) ORDER BY round(distance, 9), vec_id LIMIT 10")
def topic_prefilter(spark, d):
    v = table(spark, d, "embeddings").withColumn("topics", F.array(F.concat(F.lit("t"), F.col("label").cast("string"))))
    v = v.where(F.arrays_overlap("topics", F.array(F.lit("t1"), F.lit("t3"))))
    return R.vector_top(v, _query_vector(spark, d), None).orderBy(F.round("distance", 9), "vec_id").limit(10).select("vec_id", F.round("vector_score", 5).alias("score"))


@register("topic_postfilter", "SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0 OR (vec_id % 5 <> 0 AND label IN (1, 2))")
def topic_postfilter(spark, d):
    topics = F.when(F.col("vec_id") % 7 == 0, F.lit(None)).when(F.col("vec_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Topic"), F.col("label").cast("string"))))
    return R.topic_postfilter(table(spark, d, "embeddings").select("vec_id", topics.alias("topics")), ["TOPIC1", "topic2"]).select("vec_id")


@register("paginate", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paginate(spark, d):
    return R.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, 25, F.desc("o_totalprice"), "o_orderkey")


def _fetch(offset: int, limit: int) -> int:
    """Rows of each channel for a page."""
    return 2 * (offset + limit)


#: A supplier's vector is the one of its number; a chunk mentions the suppliers of the order of its number.
SEEDS = "sd AS (SELECT 's:' || vec_id AS id FROM ve JOIN supplier ON s_suppkey = vec_id ORDER BY round(distance, 9), 's:' || vec_id LIMIT 5)"


def _fused_sql(offset: int = 0, limit: int = 20) -> str:
    n = _fetch(offset, limit)
    return f"""
{VEC}, {BM25}, {D.EDGES_SQL}, {SEEDS},
v AS (SELECT vec_id AS id, greatest(0, 1 - distance) AS s FROM ve ORDER BY round(distance, 9), vec_id LIMIT {n}),
k AS (SELECT doc_id AS id, score / (score + 1) AS s FROM bm ORDER BY score DESC, doc_id LIMIT {n}),
u AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
n1 AS MATERIALIZED (SELECT id, min(hop) AS hop FROM (SELECT id, 0 AS hop FROM sd UNION ALL SELECT dst, 1 FROM u WHERE src IN (SELECT id FROM sd)) GROUP BY 1),
n2 AS MATERIALIZED (SELECT id, min(hop) AS hop FROM (SELECT * FROM n1 UNION ALL SELECT dst, 2 FROM n1 JOIN u ON src = id) GROUP BY 1),
g AS (SELECT doc_id AS id, max(1.0::DOUBLE / (hop + 1)) AS s FROM n2 JOIN lineitem ON id = 's:' || l_suppkey JOIN documents ON doc_id = l_orderkey GROUP BY 1 ORDER BY s DESC, 1 LIMIT {n}),
fu AS (SELECT coalesce(v.id, k.id, g.id) AS chunk_id, coalesce(v.s, 0) AS vs, coalesce(k.s, 0) AS ks, coalesce(g.s, 0) AS gs
       FROM v FULL JOIN k ON k.id = v.id FULL JOIN g ON g.id = coalesce(v.id, k.id))"""


def _node_vectors(spark, d):
    """id, embedding of the suppliers; null without a vector."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("s_suppkey"), "embedding")
    return table(spark, d, "supplier").select("s_suppkey").join(v, "s_suppkey", "left").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), "embedding")


def _channels(spark, d, mode: str = "hybrid", offset: int = 0, limit: int = 20):
    """The channels of a mode (the others None), each as long as the page asks."""
    n, query = _fetch(offset, limit), _query_vector(spark, d)
    v = k = g = None
    if mode in ("hybrid", "vector"):
        v = R.vector_top(table(spark, d, "embeddings"), query, None).orderBy(F.round("distance", 9), "vec_id").limit(n)
        v = v.select(F.col("vec_id").alias("chunk_id"), F.col("vector_score").alias("score"))
    if mode in ("hybrid", "keyword"):
        k = R.bm25(table(spark, d, "documents"), TERMS, n)
        k = k.select(F.col("doc_id").alias("chunk_id"), (F.col("score") / (F.col("score") + 1)).alias("score"))
    if mode in ("hybrid", "graph"):
        known = table(spark, d, "documents").select(F.col("doc_id").alias("chunk"))
        links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("node")).join(known, "chunk", "left_semi")
        g = R.graph_channel(D.edges(spark, d), links, R.nearest_nodes(_node_vectors(spark, d), query)).orderBy(F.desc("score"), "chunk_id").limit(n)
    return v, k, g


@register("fuse_scores", f"WITH {_fused_sql()} SELECT chunk_id, round(0.6 * vs + 0.3 * ks + 0.1 * gs, 5) AS final_score FROM fu")
def fuse_scores(spark, d):
    return R.fuse(*_channels(spark, d)).select("chunk_id", F.round("final_score", 5).alias("final_score"))


@register("fuse_union", f"WITH {_fused_sql()} SELECT chunk_id FROM fu")
def fuse_union(spark, d):
    v, k, g = _channels(spark, d)
    return v.select("chunk_id").union(k.select("chunk_id")).union(g.select("chunk_id")).distinct()


@register("graph_seeds", f"WITH {VEC}, {SEEDS} SELECT id FROM sd")
def graph_seeds(spark, d):
    return R.nearest_nodes(_node_vectors(spark, d), _query_vector(spark, d))


_SHOWN = "round(vs, 5) AS vector_score, round(ks, 5) AS keyword_score, round(gs, 5) AS graph_score"


def _found(spark, d, mode: str, offset: int, limit: int, topics: list[str] | None = None):
    """A page of the mode's results with snippets, after the topic filter."""
    fused = R.search(*_channels(spark, d, mode, offset, limit), mode)
    text = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.left("text", F.lit(80)).alias("snippet"), F.array("lang").alias("topics"))
    rows = text.join(fused, "chunk_id")
    rows = R.topic_postfilter(rows, topics) if topics else rows
    r5 = lambda c: F.round(c, 5).alias(c)
    rows = rows.select("chunk_id", *map(r5, ("vector_score", "keyword_score", "graph_score", "final_score")), "snippet")
    return R.page(rows, offset, limit, F.desc("final_score"), "chunk_id")


def _page_sql(offset: int, limit: int, where: str = "") -> str:
    return f"""WITH {_fused_sql(offset, limit)} SELECT chunk_id, {_SHOWN}, round(0.6 * vs + 0.3 * ks + 0.1 * gs, 5) AS final_score, left(text, 80) AS snippet
FROM fu JOIN documents ON doc_id = chunk_id {where} ORDER BY final_score DESC, chunk_id LIMIT {limit} OFFSET {offset}"""


@register("hybrid_search", _page_sql(0, 20))
def hybrid_search(spark, d):
    return _found(spark, d, "hybrid", 0, 20)


@register("hybrid_search_page", _page_sql(10, 15, "WHERE lower(lang) IN ('en', 'de')"))
def hybrid_search_page(spark, d):
    """With a topic filter (a text's topic is its language) and an offset."""
    return _found(spark, d, "hybrid", 10, 15, ["EN", "de"])


@register("hybrid_search_deep", _page_sql(80, 20))
def hybrid_search_deep(spark, d):
    """A page far down: every channel gives as many rows as the page needs."""
    return _found(spark, d, "hybrid", 80, 20)


def _one_channel(mode: str, score: str) -> None:
    rest = {"vs": "0.0::DOUBLE", "ks": "0.0::DOUBLE", "gs": "0.0::DOUBLE"} | {score: f"round({score}, 5)"}
    sql = f"""WITH {_fused_sql()} SELECT chunk_id, {rest["vs"]} AS vector_score, {rest["ks"]} AS keyword_score, {rest["gs"]} AS graph_score, round({score}, 5) AS final_score, left(text, 80) AS snippet
FROM fu JOIN documents ON doc_id = chunk_id WHERE {score} > 0 ORDER BY final_score DESC, chunk_id LIMIT 20"""

    @register(f"search_{mode}", sql)
    def one(spark, d):
        return _found(spark, d, mode, 0, 20)


for _mode, _score in (("vector", "vs"), ("keyword", "ks"), ("graph", "gs")):
    _one_channel(_mode, _score)


@register("topic_centroid", "SELECT label, pos::INT AS pos, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def topic_centroid(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@register("suggestions_distinct", f"WITH {VEC}, v AS (SELECT vec_id FROM ve ORDER BY round(distance, 9), vec_id LIMIT 5) SELECT DISTINCT left(text, 120) AS excerpt FROM v JOIN documents ON doc_id = vec_id")
def suggestions_distinct(spark, d):
    v = R.vector_top(table(spark, d, "embeddings"), _query_vector(spark, d), None).orderBy(F.round("distance", 9), "vec_id").limit(5).select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").join(F.broadcast(v), "doc_id").select(F.left("text", F.lit(120)).alias("excerpt")).distinct()


@register("multi_collection_union", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE r <= 10")
def multi_collection_union(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).withColumn("r", F.row_number().over(w)).where("r <= 10").select("o_orderpriority", "o_orderkey")


@register("zero_embedding_estimate", "SELECT count(*) FILTER (WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) < 1e-6)::DOUBLE / count(*) * count(*) AS estimate FROM embeddings")
def zero_embedding_estimate(spark, d):
    from quillgraph.functions import scalars as S

    return table(spark, d, "embeddings").agg((F.count_if(S.dot(F.col("embedding"), F.col("embedding")) < 1e-6).cast("double") / F.count("*") * F.count("*")).alias("estimate"))
