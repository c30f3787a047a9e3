"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import analytics as A
from quillgraph.operators import communities as C
from quillgraph.operators import graph as G
from quillgraph.operators import paths
from quillgraph.registry import register
from quillgraph.session import steps, table, written
from quillgraph.sources import domain as D

N, E = (x.replace(" AS (", " AS MATERIALIZED (", 1) for x in (D.NODES_SQL, D.EDGES_SQL))


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _reach_sql(edges: str, seed: str, depth: int, least: float = 0.0, directed: bool = True) -> str:
    both = "SELECT src, dst FROM edges WHERE weight >= {0}" + ("" if directed else " UNION SELECT dst, src FROM edges WHERE weight >= {0}")
    out = [edges, f"hops AS MATERIALIZED ({both.format(least)})", f"r0 AS (SELECT unnest({seed}) AS id, 0 AS hop)"]
    for k in range(1, depth + 1):
        out.append(f"r{k} AS MATERIALIZED (SELECT id, min(hop) AS hop FROM (SELECT * FROM r{k-1} UNION ALL SELECT dst, {k} FROM r{k-1} JOIN hops ON src = id WHERE hop = {k-1}) GROUP BY id)")
    return ", ".join(out)


@register("bfs_reachable", f"WITH {_reach_sql(E, ['c:1', 's:2', 's:5'], 3)} SELECT id, hop FROM r3")
def bfs_reachable(spark, d):
    return G.reach(D.edges(spark, d), seeds(spark, "c:1", "s:2", "s:5"), 3)


@register("bfs_subgraph", f"""WITH {D.EDGES_SQL}, h AS (SELECT src, dst FROM edges WHERE weight >= 0.2),
r AS (SELECT 'c:1' AS id UNION SELECT 's:2' UNION SELECT dst FROM h WHERE src IN ('c:1', 's:2') UNION SELECT b.dst FROM h a JOIN h b ON b.src = a.dst WHERE a.src IN ('c:1', 's:2'))
SELECT edges.src, edges.dst, edge_type FROM edges JOIN r a ON a.id = edges.src JOIN r b ON b.id = edges.dst""")
def bfs_subgraph(spark, d):
    e = D.edges(spark, d)
    return G.subgraph(e, G.reach(e, seeds(spark, "c:1", "s:2"), 2, 0.2)).select("src", "dst", "edge_type")


_TOP = "edges AS (SELECT src, dst, edge_type, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM all_edges) WHERE r <= 5)"


@register("batched_bfs", f"WITH {_reach_sql(E.replace('edges AS', 'all_edges AS', 1) + ', ' + _TOP, ['s:1', 's:7', 'c:3'], 2)} SELECT id, hop FROM r2")
def batched_bfs(spark, d):
    return G.batched_reach(D.edges(spark, d), seeds(spark, "s:1", "s:7", "c:3"), 2, 5)


@register("reachable_check", f"WITH {_reach_sql(E, ['c:1'], 3)} SELECT count(*) > 0 AS reachable FROM r3 WHERE id LIKE 'r:%'")
def reachable_check(spark, d):
    return G.reach(D.edges(spark, d), seeds(spark, "c:1"), 3).agg((F.count_if(F.col("id").startswith("r:")) > 0).alias("reachable"))


@register("shortest_path", f"""WITH {E}, p AS (
  SELECT dst AS id, 1 / greatest(weight, 0.001) AS cost, concat('s:3>', dst) AS path FROM edges WHERE src = 's:3'
  UNION ALL SELECT b.dst, 1 / greatest(a.weight, 0.001) + 1 / greatest(b.weight, 0.001), concat('s:3>', a.dst, '>', b.dst) FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = 's:3'
  UNION ALL SELECT 's:3', 0, 's:3')
SELECT id, round(cost, 6) AS cost, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cost, 12), path) AS r FROM p) WHERE r = 1""")
def shortest_path(spark, d):
    return G.shortest_paths(D.edges(spark, d), "s:3").select("id", F.round("cost", 6).alias("cost"), "path")


@register("path_unweighted", f"WITH {_reach_sql(E, ['c:1'], 12, directed=False)} SELECT id, hop FROM r12")
def path_unweighted(spark, d):
    """Any number of hops; no two nodes of the star schema are over twelve apart, where its SQL stops."""
    return G.reach(D.edges(spark, d), seeds(spark, "c:1"), None, directed=False)


@register("shortest_path_between", f"""WITH {E}, two AS (SELECT a.src AS s, a.dst AS m, b.dst AS t, 1 / greatest(a.weight, 0.001) AS c1, 1 / greatest(b.weight, 0.001) AS c2 FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = 'c:1' AND b.dst IN (SELECT 'r:' || n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1))
SELECT 0 AS step, 'node' AS kind, s AS id, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::DOUBLE AS cost FROM two UNION ALL SELECT 1, 'edge', NULL, s, m, c1 FROM two UNION ALL SELECT 2, 'node', m, NULL, NULL, NULL FROM two
UNION ALL SELECT 3, 'edge', NULL, m, t, c2 FROM two UNION ALL SELECT 4, 'node', t, NULL, NULL, NULL FROM two""")
def shortest_path_between(spark, d):
    """From a customer to its region."""
    region = table(spark, d, "customer").where("c_custkey = 1").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return paths.cheapest_path(D.edges(spark, d), "c:1", f"r:{region}")


@register("path_between", f"""WITH {E}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), m AS (SELECT min(a.dst) AS m FROM u a JOIN u b ON b.src = a.dst WHERE a.src = 'p:1' AND b.dst = (SELECT 'p:' || max(l_partkey) FROM lineitem WHERE l_suppkey = (SELECT min(l_suppkey) FROM lineitem WHERE l_partkey = 1) AND l_partkey <> 1)),
t AS (SELECT 'p:' || max(l_partkey) AS t FROM lineitem WHERE l_suppkey = (SELECT min(l_suppkey) FROM lineitem WHERE l_partkey = 1) AND l_partkey <> 1)
SELECT 0 AS step, 'node' AS kind, 'p:1' AS id, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::DOUBLE AS cost UNION ALL SELECT 1, 'edge', NULL, 'p:1', m, 1 FROM m UNION ALL SELECT 2, 'node', m, NULL, NULL, NULL FROM m
UNION ALL SELECT 3, 'edge', NULL, m, t, 1 FROM m, t UNION ALL SELECT 4, 'node', t, NULL, NULL, NULL FROM t""")
def path_between(spark, d):
    """Between two parts that a supplier has in common, whatever the direction of edges."""
    items = table(spark, d, "lineitem")
    supplier = items.where("l_partkey = 1").agg(F.min("l_suppkey")).first()[0]
    other = items.where((F.col("l_suppkey") == supplier) & (F.col("l_partkey") != 1)).agg(F.max("l_partkey")).first()[0]
    return paths.path_between(D.edges(spark, d), "p:1", f"p:{other}")


@register("neighbors_1hop", f"WITH {E} SELECT DISTINCT n FROM (SELECT dst AS n FROM edges WHERE src = 's:4' UNION SELECT src FROM edges WHERE dst = 's:4') ORDER BY n LIMIT 20")
def neighbors_1hop(spark, d):
    e = D.edges(spark, d)
    return e.where("src = 's:4'").select(F.col("dst").alias("n")).union(e.where("dst = 's:4'").select("src")).distinct().orderBy("n").limit(20)


def _pagerank_sql(k: int) -> str:
    out = [N, E, "deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM edges GROUP BY src)", "cnt AS (SELECT count(*) AS n FROM nodes)", "k0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes, cnt)"]
    for i in range(1, k + 1):
        out.append(f"g{i} AS MATERIALIZED (SELECT dst, sum(rank / deg) AS got FROM edges JOIN deg USING (src) JOIN k{i-1} ON k{i-1}.id = src GROUP BY dst), k{i} AS MATERIALIZED (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM nodes LEFT JOIN g{i} ON dst = id, cnt)")
    return ", ".join(out)


@register("pagerank", f"WITH {_pagerank_sql(50)} SELECT id, round(rank / (SELECT max(rank) FROM k50), 6) AS rank FROM k50")
def pagerank(spark, d):
    return C.pagerank(D.nodes(spark, d), D.edges(spark, d), 50).select("id", F.round("rank", 6).alias("rank"))


@register("topk_scores", f"WITH {_pagerank_sql(50)} SELECT id, round(rank / (SELECT max(rank) FROM k50), 6) AS rank FROM k50 ORDER BY rank DESC, id LIMIT 20")
def topk_scores(spark, d):
    return pagerank(spark, d).orderBy(F.desc("rank"), "id").limit(20)


@register("betweenness")
def betweenness(spark, d):
    return C.betweenness(D.nodes(spark, d), D.edges(spark, d)).select("id", F.round("score", 6).alias("score"))


@register("louvain")
def louvain(spark, d):
    n, e = D.nodes(spark, d), D.edges(spark, d)
    return C.louvain(n.withColumn("collection_id", F.lit("c1")), e.withColumn("collection_id", F.lit("c1")))


def _components_sql(k: int) -> str:
    out = [N, E, "u AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)", "l0 AS (SELECT id, id AS component FROM nodes)"]
    for i in range(1, k + 1):
        out.append(f"l{i} AS MATERIALIZED (SELECT id, min(component) AS component FROM (SELECT * FROM l{i-1} UNION ALL SELECT src, component FROM u JOIN l{i-1} ON id = dst) GROUP BY id)")
    return ", ".join(out)


@register("label_components", f"WITH {_components_sql(14)} SELECT id, component FROM l14")
def label_components(spark, d):
    return G.label_components(D.nodes(spark, d), D.edges(spark, d))


#: Suppliers and parts, linked where a supplier has supplied a part often; their communities are its components.
_OFTEN = 0.4
_MEMBERS_SQL = f"""w AS MATERIALIZED (SELECT src, dst FROM ({D.EDGES_SQL[len("edges AS ("):-1]}) WHERE edge_type = 'supplies' AND weight >= {_OFTEN}),
u AS MATERIALIZED (SELECT src, dst FROM w UNION SELECT dst, src FROM w), l0 AS (SELECT 's:' || s_suppkey AS id, s_name AS label, 's:' || s_suppkey AS community FROM supplier UNION ALL SELECT 'p:' || p_partkey, p_name, 'p:' || p_partkey FROM part), """ + ", ".join(
    f"l{i} AS MATERIALIZED (SELECT id, any_value(label) AS label, min(community) AS community FROM (SELECT * FROM l{i-1} UNION ALL SELECT src, NULL, community FROM u JOIN l{i-1} ON id = dst) GROUP BY id)" for i in range(1, 25)
) + ", mem AS (SELECT * FROM l24)"


def _members(spark, d):
    n = D.nodes(spark, d).where("entity_type IN ('Supplier', 'Part')").select("id", "label")
    e = D.edges(spark, d).where((F.col("edge_type") == "supplies") & (F.col("weight") >= _OFTEN))
    return n.join(G.label_components(n, e), "id").select(F.col("component").alias("community"), "id", "label")


@register("community_sizes", f"WITH {_MEMBERS_SQL}, sz AS (SELECT community, count(*) AS size FROM mem GROUP BY 1) SELECT id, label, community, size, round(size::DOUBLE / (SELECT count(*) FROM mem), 4) AS score FROM mem JOIN sz USING (community)")
def community_sizes(spark, d):
    return A.community_scores(_members(spark, d))


_TOPIC_SQL = r"""few AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS r FROM mem QUALIFY r <= 30),
wd AS (SELECT community, r, unnest(string_split_regex(trim(label), '\s+')) AS w, generate_subscripts(string_split_regex(trim(label), '\s+'), 1) AS p FROM few),
ct AS (SELECT community, lower(w) AS w, count(*) AS n, min(r * 1000 + p) AS seen FROM wd WHERE length(w) > 3 GROUP BY 1, 2),
bw AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, seen) AS k FROM ct QUALIFY k <= 3),
tp AS (SELECT m.community, coalesce(string_agg(w, ' / ' ORDER BY k), 'Unknown Topic') AS topic FROM (SELECT DISTINCT community FROM mem) m LEFT JOIN bw ON bw.community = m.community GROUP BY 1)"""


@register("cluster_topics", f"""WITH {_MEMBERS_SQL}, {_TOPIC_SQL}, sz AS (SELECT community, count(*) AS size FROM mem GROUP BY 1),
pl AS (SELECT *, (row_number() OVER (ORDER BY size DESC, community) - 1)::INT AS place FROM sz) SELECT place, community, topic, size, {A.CLUSTER_COLORS}[place % 12 + 1] AS color FROM pl JOIN tp USING (community) WHERE place < 20""")
def cluster_topics(spark, d):
    return A.clusters(_members(spark, d))


@register("cluster_topic_fallback", f"WITH {_MEMBERS_SQL}, {_TOPIC_SQL} SELECT community, topic FROM tp")
def cluster_topic_fallback(spark, d):
    return A.cluster_names(_members(spark, d))


@register("analytics_summary")
def analytics_summary(spark, d):
    """The summary of the whole graph, with Louvain communities and betweenness; SQL can't express the communities."""
    n, e = D.nodes(spark, d).withColumn("collection_id", F.lit("c")), D.edges(spark, d).withColumn("collection_id", F.lit("c"))
    with steps(spark, n, e) as keep:
        e = written(e)
        return keep(A.summary(n, e, C.louvain(n, e), C.pagerank(n, e), C.betweenness(n, e)))


@register("analytics_summary_betweenness")
def analytics_summary_betweenness(spark, d):
    """The summary of the suppliers and parts with Louvain communities and betweenness."""
    n = D.nodes(spark, d).where("entity_type IN ('Supplier', 'Part')").withColumn("collection_id", F.lit("c"))
    e = D.edges(spark, d).where((F.col("edge_type") == "supplies") & (F.col("weight") >= _OFTEN)).withColumn("collection_id", F.lit("c"))
    with steps(spark, n, e) as keep:
        e = written(e)
        return keep(A.summary(n, e, C.louvain(n, e), C.pagerank(n, e), C.betweenness(n, e)))


@register("graph_full", f"WITH {N}, {E} SELECT 'node' AS kind, id AS a, label AS b FROM nodes UNION ALL SELECT 'edge', src, dst FROM edges")
def graph_full(spark, d):
    n = D.nodes(spark, d).select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"))
    return n.unionByName(D.edges(spark, d).select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


#: Parts with the orders that hold them as chunks, and their first shipping date; an order's labels are its priority and status.
_PARTS_SQL = """pn AS (SELECT 'p:' || p_partkey AS id, p_name AS label, CASE WHEN p_size < 25 THEN 'Small' ELSE 'Large' END AS entity_type, list_sort(list(DISTINCT l_orderkey)) AS chunks, min(l_shipdate)::TIMESTAMP AS created_at
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"""


def _part_nodes(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_orderkey")).alias("source_chunk_ids"), F.min("l_shipdate").cast("timestamp").alias("created_at"))
    p = table(spark, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") < 25, "Small").otherwise("Large").alias("entity_type"), "source_chunk_ids", "created_at")


@register("subgraph_filter", f"""WITH {_PARTS_SQL}, {D.EDGES_SQL}, bo AS (SELECT quantile_disc(created_at::DATE, 0.1) AS lo, quantile_disc(created_at::DATE, 0.9) AS hi FROM pn),
dc AS (SELECT o_orderkey AS chunk FROM orders WHERE o_custkey % 3 = 0), lc AS (SELECT o_orderkey AS chunk FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
f AS (SELECT id FROM pn, bo WHERE created_at >= lo AND created_at <= hi + INTERVAL 1 DAY AND entity_type = 'Small' AND id IN (SELECT pn.id FROM pn, unnest(chunks) u(c) WHERE c IN (SELECT chunk FROM dc)) AND id IN (SELECT pn.id FROM pn, unnest(chunks) u(c) WHERE c IN (SELECT chunk FROM lc)))
SELECT src, dst, edge_type FROM edges WHERE dst IN (SELECT id FROM f)""")
def subgraph_filter(spark, d):
    """Edges to the parts of a span of time, of a kind, in the chunks of some documents and in chunks with a label."""
    nodes = _part_nodes(spark, d)
    lo, hi = nodes.agg(*[F.to_date(F.timestamp_seconds(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY unix_seconds(created_at))"))) for q in (0.1, 0.9)]).first()
    o = table(spark, d, "orders")
    mine = o.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("chunk"))
    marked = o.where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(F.col("o_orderkey").alias("chunk"))
    kept = G.filtered_nodes(nodes, lo, hi, ["Small"], mine, marked)
    return D.edges(spark, d).join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "edge_type")


@register("subgraph_keywords", "WITH k AS (SELECT DISTINCT lower(p_name) AS k FROM part WHERE p_partkey % 40 = 1) SELECT 'p:' || p_partkey AS id FROM part WHERE lower(p_name) IN (SELECT k FROM k)")
def subgraph_keywords(spark, d):
    """Nodes whose label is one of the keywords, whatever its case."""
    words = [r.w for r in table(spark, d, "part").where("p_partkey % 40 = 1").select(F.upper("p_name").alias("w")).distinct().limit(10_000).collect()]
    return G.filtered_nodes(_part_nodes(spark, d), keywords=words).select("id")


@register("node_detail", f"""WITH {_PARTS_SQL}, {D.EDGES_SQL}, tg AS (SELECT DISTINCT lower(p_name) AS k, o_orderkey AS chunk FROM orders JOIN part ON p_partkey = o_custkey WHERE o_orderkey % 2 = 0),
bt AS (SELECT id, chunk FROM pn JOIN tg ON k = lower(label)), al AS (SELECT * FROM bt UNION ALL SELECT id, c FROM pn, unnest(chunks) u(c) WHERE c IS NOT NULL AND id NOT IN (SELECT id FROM bt)),
lk AS (SELECT id, chunk FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chunk) AS r FROM al) WHERE r <= 200),
nb AS (SELECT i, count(DISTINCT o) AS n FROM (SELECT src AS i, dst AS o FROM edges UNION SELECT dst, src FROM edges) GROUP BY 1)
SELECT pn.id, label, coalesce(nb.n, 0) AS neighbours, coalesce(c.chunks, '') AS chunks FROM pn LEFT JOIN nb ON nb.i = pn.id LEFT JOIN (SELECT id, string_agg(chunk::VARCHAR, ',' ORDER BY chunk) AS chunks FROM lk GROUP BY 1) c ON c.id = pn.id""")
def node_detail(spark, d):
    """Every part with its neighbours and linked chunks: those tagged with its name, else its sources."""
    nodes, e = _part_nodes(spark, d), D.edges(spark, d)
    o, p = table(spark, d, "orders").where("o_orderkey % 2 = 0"), table(spark, d, "part")
    tagged = o.join(p, F.col("o_custkey") == F.col("p_partkey")).select(F.upper("p_name").alias("keyword"), F.col("o_orderkey").alias("chunk"))
    chunks = G.linked_chunks(nodes, tagged).select("id", "label", F.array_join("chunks", ",").alias("chunks"))
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("o")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("o")))
    near = both.groupBy("id").agg(F.count_distinct("o").alias("neighbours"))
    return chunks.join(near, "id", "left").select("id", "label", F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"), F.coalesce("chunks", F.lit("")).alias("chunks"))


@register("node_summary_cache", "WITH h AS (SELECT l_partkey, sha1(string_agg(DISTINCT l_orderkey::VARCHAR, '|' ORDER BY l_orderkey::VARCHAR)) AS h FROM lineitem GROUP BY 1) SELECT l_partkey, h, l_partkey % 2 = 0 AS reused FROM h")
def node_summary_cache(spark, d):
    from quillgraph.functions import scalars as S

    now = table(spark, d, "lineitem").groupBy("l_partkey").agg(S.chunk_hash(F.collect_set(F.col("l_orderkey").cast("string"))).alias("h"))
    cached = now.where("l_partkey % 2 = 0").select(F.col("l_partkey").alias("k"), F.col("h").alias("ch"))
    return now.join(cached, (F.col("l_partkey") == F.col("k")) & (F.col("h") == F.col("ch")), "left").select("l_partkey", "h", F.col("k").isNotNull().alias("reused"))


def _seed_sql(k: int) -> str:
    """The suppliers nearest to the query vector; a supplier's vector is the one of its number."""
    return f"ve AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS distance FROM embeddings), sd AS (SELECT 's:' || vec_id AS id FROM ve JOIN supplier ON s_suppkey = vec_id ORDER BY round(distance, 9), 's:' || vec_id LIMIT {k})"


def _near(spark, d, k: int):
    from quillgraph.operators import retrieval as R
    from quillgraph.plans.retrieval import _node_vectors, _query_vector

    return R.nearest_nodes(_node_vectors(spark, d), _query_vector(spark, d), k)


@register("graph_proximity", f"""WITH {D.EDGES_SQL}, {_seed_sql(5)}, r1 AS (SELECT id, 0 AS hop FROM sd UNION ALL SELECT dst, 1 FROM edges WHERE src IN (SELECT id FROM sd)),
r2 AS (SELECT id, min(hop) AS hop FROM (SELECT * FROM r1 UNION ALL SELECT dst, 2 FROM r1 JOIN edges ON src = id) GROUP BY 1),
s AS (SELECT edges.dst AS chunk_id, max(1.0::DOUBLE / (hop + 1)) AS score FROM r2 JOIN edges ON src = id GROUP BY 1) SELECT chunk_id, score FROM s ORDER BY score DESC, chunk_id LIMIT 50""")
def graph_proximity(spark, d):
    from quillgraph.functions import scalars as S

    e = D.edges(spark, d)
    r = G.reach(e, _near(spark, d, 5), 2)
    return e.join(r, e["src"] == r["id"]).groupBy(F.col("dst").alias("chunk_id")).agg(F.max(S.hop_score(F.col("hop"))).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(50)


@register("agent_multihop", f"""WITH {D.EDGES_SQL}, {_seed_sql(8)}, t AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM edges),
h1 AS (SELECT DISTINCT dst AS id FROM t JOIN sd ON src = id WHERE r <= 10), f1 AS (SELECT id FROM h1 WHERE id NOT IN (SELECT id FROM sd) ORDER BY id LIMIT 20),
h2 AS (SELECT DISTINCT dst AS id FROM t JOIN f1 ON src = id WHERE r <= 10), f2 AS (SELECT id FROM h2 WHERE id NOT IN (SELECT id FROM sd UNION SELECT id FROM f1) ORDER BY id LIMIT 20),
a AS (SELECT id, 0 AS hop FROM sd UNION ALL SELECT id, 1 FROM f1 UNION ALL SELECT id, 2 FROM f2), {D.NODES_SQL},
c AS (SELECT a.id, hop, label, entity_type, (SELECT string_agg(dst || ' (' || edge_type || ')', ', ' ORDER BY t2.r) FROM (SELECT src, dst, edge_type, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM edges) t2 WHERE t2.src = a.id AND t2.r <= 3) AS links FROM a JOIN nodes USING (id))
SELECT id, hop, label || ' [' || entity_type || ']' || coalesce(': ' || links, '') AS context FROM c""")
def agent_multihop(spark, d):
    """Seeds nearest to the question, two hops of at most ten edges a node and twenty new nodes, and a line of context for each."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    top = D.edges(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 10").select("src", "dst", "edge_type", "r")
    top = written(top)
    seen, front = _near(spark, d, 8).withColumn("hop", F.lit(0)), None
    front = seen = written(seen)
    for hop in (1, 2):
        new = top.join(F.broadcast(front.select(F.col("id").alias("src"))), "src").select(F.col("dst").alias("id")).distinct()  # 20 rows at most
        front = written(new.join(F.broadcast(seen.select("id")), "id", "left_anti").orderBy("id").limit(20).withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    few = top.where("r <= 3").join(F.broadcast(seen.select(F.col("id").alias("src"))), "src")  # 48 rows at most
    said = few.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("dst", F.lit(" ("), "edge_type", F.lit(")")).alias("t")))), lambda x: x["t"]), ", ").alias("links"))
    line = F.concat("label", F.lit(" ["), "entity_type", F.lit("]"), F.coalesce(F.concat(F.lit(": "), "links"), F.lit("")))
    return D.nodes(spark, d).join(F.broadcast(seen), "id").join(said, "id", "left").select("id", "hop", line.alias("context"))


@register("agent_topn_per_hop", f"WITH {E} SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM edges WHERE edge_type = 'supplies') WHERE r <= 3")
def agent_topn_per_hop(spark, d):
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return D.edges(spark, d).where("edge_type = 'supplies'").withColumn("r", F.row_number().over(w)).where("r <= 3").select("src", "dst")


@register("export_graphml", f"""WITH {N}, {E} SELECT 0 AS part, id AS k, format('<node id="{{}}"><data key="label">{{}}</data><data key="type">{{}}</data></node>', id, replace(label, '&', '&amp;'), entity_type) AS line FROM nodes
UNION ALL SELECT 1, concat(src, '>', dst), format('<edge source="{{}}" target="{{}}"><data key="predicate">{{}}</data></edge>', src, dst, edge_type) FROM edges""")
def export_graphml(spark, d):
    return G.graphml(D.nodes(spark, d), D.edges(spark, d))


@register("export_json", f"""WITH {N} SELECT id, concat('{{"id":"', id, '","label":"', label, '","entity_type":"', entity_type, '"}}') AS json FROM nodes""")
def export_json(spark, d):
    return D.nodes(spark, d).select("id", F.to_json(F.struct("id", "label", "entity_type")).alias("json"))
