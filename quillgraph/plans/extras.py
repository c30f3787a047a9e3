"""Queries of the remaining operators: set unions, model hooks, approximate search, specified extras."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.functions import scalars as S
from quillgraph.operators import graph as G
from quillgraph.operators import hooks, ivf, pq
from quillgraph.operators import merging as M
from quillgraph.operators import retrieval as R
from quillgraph.operators import text as X
from quillgraph.registry import register
from quillgraph.session import checkpoint_dir, cut, table
from quillgraph.sources import domain as D
from quillgraph.sources import files

N, E = D.NODES_SQL, D.EDGES_SQL


def _sets(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") < 4, F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") > 2, F.col("l_partkey"))).alias("b"))


_UNION = "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS ids FROM lineitem GROUP BY 1"


def _union(spark, d):
    return _sets(spark, d).select("l_orderkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("ids"))


register("doc_origins_union", _UNION)(_union)
register("participants_union", _UNION)(_union)


@register("participants_intersect", "SELECT l_orderkey, len(list_intersect(coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_linenumber < 4), []), coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_linenumber > 2), []))) > 0 AS hit FROM lineitem GROUP BY 1")
def participants_intersect(spark, d):
    return _sets(spark, d).select("l_orderkey", F.arrays_overlap("a", "b").alias("hit"))


@register("merge_py_dict", """WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS de, [c_name] AS al, c_nationkey / 100.0::DOUBLE AS co FROM customer WHERE c_custkey % 3 <> 0),
i AS (SELECT o_custkey AS k, min(o_orderpriority) AS de, list_sort(list(DISTINCT o_orderstatus)) AS al, count(*) / 50.0::DOUBLE AS co FROM orders GROUP BY 1)
SELECT coalesce(e.k, i.k) AS dedup_key, coalesce(e.de, i.de) AS description, array_to_string(CASE WHEN e.k IS NOT NULL AND i.k IS NOT NULL THEN list_concat(e.al, i.al) ELSE coalesce(e.al, i.al) END, ',') AS aliases, round(CASE WHEN e.k IS NOT NULL AND i.k IS NOT NULL THEN (e.co + i.co) / 2 ELSE coalesce(e.co, i.co) END, 10) AS confidence FROM e FULL JOIN i ON e.k = i.k""")
def merge_py_dict(spark, d):
    """Customers and what their orders say of them: missing fields filled, lists extended, confidences averaged."""
    e = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("dedup_key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("description"), F.array("c_name").alias("aliases"), (F.col("c_nationkey") / 100.0).alias("confidence"))
    i = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("dedup_key")).agg(F.min("o_orderpriority").alias("description"), F.array_sort(F.collect_set("o_orderstatus")).alias("aliases"), (F.count("*") / 50.0).alias("confidence"))
    out = M.fill_merge(e, i, ("description",), ("aliases",))
    return out.select("dedup_key", "description", F.array_join("aliases", ",").alias("aliases"), F.round("confidence", 10).alias("confidence"))


@register("spatio_temporal_key", "SELECT o_orderkey, concat(o_custkey, '|', o_orderstatus, '|', o_orderkey, '@', strftime(o_orderdate, '%Y-%m-%d'), '|', o_orderpriority) AS k FROM orders")
def spatio_temporal_key(spark, d):
    cols = {"source": F.col("o_custkey"), "predicate": F.col("o_orderstatus"), "target": F.col("o_orderkey"), "time": F.date_format("o_orderdate", "yyyy-MM-dd"), "location": F.col("o_orderpriority")}
    return table(spark, d, "orders").select("o_orderkey", S.compile_key("{source}|{predicate}|{target}@{time}|{location}", cols).alias("k"))


@register("topic_subgraph", f"WITH {N}, {E}, t AS (SELECT src FROM edges WHERE edge_type = 'located_in' AND dst = 'n:3'), o AS (SELECT src FROM t ORDER BY src LIMIT 50) SELECT src AS id FROM o UNION SELECT dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM edges WHERE weight >= 0.2) WHERE r <= 50 AND src IN (SELECT src FROM o)")
def topic_subgraph(spark, d):
    """Members of a topic and what they link to (a feature of the specification only)."""
    e = D.edges(spark, d)
    seeds = e.where("edge_type = 'located_in' AND dst = 'n:3'").select(F.col("src").alias("id")).orderBy("id").limit(50)
    return G.batched_reach(e, seeds, 1, 50, 0.2).select("id")


@register("entity_search", f"WITH {N} SELECT id FROM nodes WHERE entity_type = 'Nation' AND levenshtein(lower(label), 'nation_7') <= 1")
def entity_search(spark, d):
    return D.nodes(spark, d).where("entity_type = 'Nation'").where(F.levenshtein(F.lower("label"), F.lit("nation_7")) <= 1).select("id")


@register("search_nodes", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 1) SELECT vec_id FROM embeddings, q WHERE label < 5 ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], e), 9), vec_id LIMIT 15")
def search_nodes(spark, d):
    v = table(spark, d, "embeddings")
    q = [float(x) for x in v.where("vec_id = 1").select("embedding").first()[0]]
    return R.vector_top(v.where("label < 5"), q, None).orderBy(F.round("distance", 9), "vec_id").limit(15).select("vec_id")


@register("search_edges", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderpriority = '1-URGENT'")
def search_edges(spark, d):
    when = F.col("o_orderdate")
    return table(spark, d, "orders").where((when >= F.lit("1995-01-01").cast("timestamp_ntz")) & (when < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


def _asked(spark, d):
    """The model's answer for every chunk of every text."""
    return hooks.ask(X.semantic_chunks(table(spark, d, "documents")), hooks.title_case_model, "doc_id", "chunk")


@register("extract_from_chunk")
def extract_from_chunk(spark, d):
    """Entities of all chunks, each once a document."""
    return hooks.entities(_asked(spark, d), "doc_id").distinct()


@register("two_stage_extract")
def two_stage_extract(spark, d):
    """Relations of all chunks, each once a document."""
    return hooks.relationships(_asked(spark, d), "doc_id", predicates=["related_to"]).distinct()


@register("embed_backfill", "SELECT vec_id, vec_id % 10 = 0 AS filled FROM embeddings")
def embed_backfill(spark, d):
    """Vectors that are missing are computed anew; the others stay."""
    v = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 != 0, F.col("embedding")).alias("embedding"))
    made = v.where("embedding IS NULL").select("vec_id", F.array_repeat(F.lit(0.5), 64).cast("array<float>").alias("new"))
    return v.join(made, "vec_id", "left").select("vec_id", (F.coalesce("embedding", "new") == F.array_repeat(F.lit(0.5), 64).cast("array<float>")).alias("filled"))


@register("ontology_generate", "SELECT left(string_agg(left(text, 200), chr(10) ORDER BY doc_id), 4000) AS sample FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 10)")
def ontology_generate(spark, d):
    """The text sample that a model is asked about."""
    ten = table(spark, d, "documents").select("doc_id", F.left("text", F.lit(200)).alias("t")).orderBy("doc_id").limit(10)
    return ten.agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]), "\n"), F.lit(4000)).alias("sample"))


@register("validate_path")
def validate_path(spark, d):
    paths = ["/data/in/a.txt", "/data/in/../../etc/passwd", "/data/in/.env", "/data/in/x.sh"]
    return spark.createDataFrame([(p, files.path_problem(p, ["/data/in"])) for p in paths], "path string, problem string")


@register("ann_rebuild")
def ann_rebuild(spark, d):
    """The neighbours that the product-quantised index finds for every query with vec_id % 20 = 0, each query's recall against
    the exact search over all rows, and the index's bytes a vector; a mean recall under 0.9 is an error."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = pq.fit(v, 16, 16)
    index = pq.rebuild(v, q, f"{checkpoint_dir(spark)}/ann-{uuid.uuid4().hex}")
    queries = v.where("vec_id % 20 = 0")
    near = cut(pq.search(index, v, queries, q, 10, 12, 20))
    exact = ivf.search_all(v.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0)), 10).select("query", "vec_id")
    found = exact.join(near.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    recall = cut(found.groupBy("query").agg((F.count("hit") / F.count("*")).alias("recall")))
    mean = recall.agg(F.avg("recall")).first()[0]
    if mean is not None and mean < 0.9:
        raise ValueError(f"recall {mean:.3f} is under 0.9")
    return near.join(recall, "query").select(F.col("query").alias("query_id"), "vec_id", "distance", "rank", "recall", F.lit(q.bytes_a_vector).alias("bytes_a_vector"))


_TYPE = "CASE p_size % 5 WHEN 0 THEN 'graph' WHEN 1 THEN 'list' WHEN 2 THEN 'temporal_graph' WHEN 3 THEN 'tree' ELSE 'hypergraph' END"
_METHOD = "CASE p_partkey % 6 WHEN 0 THEN 'graph_rag' WHEN 1 THEN 'two_stage' WHEN 2 THEN 'deep' WHEN 3 THEN 'standard' END"


@register("template_validate", f"""WITH t AS (SELECT p_partkey, {_TYPE} AS type, {_METHOD} AS method, CASE WHEN p_partkey % 7 = 0 THEN 'name' WHEN p_partkey % 11 <> 0 THEN '{{name}}' END AS ek, p_partkey % 13 <> 0 AS ids, p_partkey % 17 = 0 AS twice FROM part),
c AS (SELECT *, type IN ('graph', 'temporal_graph', 'hypergraph') AS g FROM t),
e AS (SELECT *, concat_ws(',', CASE WHEN type = 'tree' THEN 'type' END, CASE WHEN method = 'deep' THEN 'method' END, CASE WHEN ek = 'name' THEN 'entity_key' END, CASE WHEN twice THEN 'entity_fields' END, CASE WHEN g AND ek IS NULL THEN 'entity_schema' END, CASE WHEN g AND NOT ids THEN 'identifiers' END) AS errors FROM c)
SELECT p_partkey, errors = '' AS valid, errors, CASE WHEN errors = '' THEN concat_ws(',', CASE WHEN NOT g THEN 'incompatible' END, CASE WHEN method = 'graph_rag' THEN 'not_implemented' END) ELSE '' END AS warnings FROM e""")
def template_validate(spark, d):
    from quillgraph.operators import templates

    p, k = table(spark, d, "part"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    rows = p.select(
        k, F.col("p_name").alias("name"), F.expr(_TYPE).alias("type"), none.alias("mode"), F.expr(_METHOD).alias("method"), none.alias("merge_nodes"), F.lit("keep_last").alias("merge_edges"),
        F.when(k % 7 == 0, "name").when(k % 11 != 0, "{name}").alias("entity_key"), F.lit("{name} ({type})").alias("entity_label"), F.when(k % 17 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("entity_fields"),
        F.lit("{source}>{target}").alias("relation_key"), F.array(F.lit("source"), F.lit("target")).alias("relation_fields"), (k % 13 != 0).alias("has_identifiers"),
    )
    listed = lambda c: F.array_join(c, ",").alias(c)
    return templates.validate(rows).select("p_partkey", "valid", listed("errors"), listed("warnings"))
