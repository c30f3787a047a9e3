"""Queries of graph construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import build as B
from quillgraph.operators import merging as M
from quillgraph.registry import register
from quillgraph.session import table
from quillgraph.sources import domain as D

N, E = D.NODES_SQL, D.EDGES_SQL
_KNOWN = ", ".join(f"'{t}'" for k, v in B.ENTITY_TYPES.items() for t in (k, *v))


@register("entity_aggregate", r"""WITH t AS (SELECT l_orderkey AS chunk, l_returnflag AS label, p_name AS text, l_discount AS score, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT concat(label, '::', trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))) AS key, count(DISTINCT chunk) AS n_chunks, round(least(avg(score), 1.0), 6) AS confidence, arg_min(text, seq) AS name, array_to_string(list_sort(list(DISTINCT text)), ',') AS aliases FROM t GROUP BY 1 HAVING count(DISTINCT chunk) >= 2""")
def entity_aggregate(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("chunk"), F.col("l_returnflag").alias("label"), F.col("p_name").alias("text"), F.col("l_discount").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return B.aggregate_entities(t).select("key", "n_chunks", F.round("confidence", 6).alias("confidence"), "name", F.array_join("aliases", ",").alias("aliases"))


@register("cooccurrence_edges", "WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n, least(count(*) / 10.0::DOUBLE, 1.0::DOUBLE) AS weight FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2")
def cooccurrence_edges(spark, d):
    return B.cooccurrence(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@register("rel_to_edges", "SELECT a.id AS src, b.id AS dst, 'located_in' AS edge_type, 0.8::DOUBLE AS weight FROM customer JOIN (SELECT c_name AS name, 'c:' || c_custkey AS id FROM customer) a ON a.name = c_name JOIN (SELECT n_name AS name, 'n:' || n_nationkey AS id, n_nationkey AS k FROM nation) b ON b.k = c_nationkey WHERE c_custkey % 3 > 0")
def rel_to_edges(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    names = c.select(F.col("c_name").alias("name"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id")).unionByName(n.select(F.col("n_name").alias("name"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id")))
    rel = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("source"), F.when(F.col("c_custkey") % 3 == 0, "nowhere").otherwise(F.col("n_name")).alias("target"), F.lit("LOCATED_IN").alias("predicate"), F.lit(0.8).alias("confidence"))
    return B.relations_to_edges(rel, names)


@register("entity_resolve", r"""WITH ex AS (SELECT s_suppkey AS id, s_suppkey AS seq, s_name AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS t, s_suppkey % 3 = 0 AS same FROM supplier),
ca AS (SELECT s_suppkey AS cid, CASE s_suppkey % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN concat(s_name, 'x') WHEN 2 THEN concat('alias ', s_suppkey) ELSE concat('entirely new ', s_suppkey) END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS t FROM supplier),
norm AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(name)), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS n FROM ca),
names AS (SELECT id, seq, trim(regexp_replace(regexp_replace(lower(trim(label)), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS n, t, same FROM ex),
al AS (SELECT id, seq, n FROM names UNION ALL SELECT id, seq, concat('alias ', id) FROM ex),
x AS (SELECT cid, arg_min(al.id, al.seq) AS id FROM norm JOIN al USING (n) GROUP BY 1),
f AS (SELECT cid, arg_min(names.id, names.seq) AS id FROM norm JOIN names ON names.t = norm.t AND levenshtein(names.n, norm.n) < 3 AND names.same WHERE cid NOT IN (SELECT cid FROM x) GROUP BY 1)
SELECT norm.cid, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN f.id IS NOT NULL THEN 'fuzzy' ELSE 'new' END AS outcome, coalesce(x.id, f.id) AS node_id FROM norm LEFT JOIN x USING (cid) LEFT JOIN f ON f.cid = norm.cid""")
def entity_resolve(spark, d):
    s = table(spark, d, "supplier")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B").alias("entity_type")
    k = F.col("s_suppkey").cast("string")
    ex = s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("label"), kind, F.array(F.concat(F.lit("Alias "), k)).alias("aliases"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    m = F.col("s_suppkey") % 4
    name = F.when(m == 0, F.upper("s_name")).when(m == 1, F.concat("s_name", F.lit("x"))).when(m == 2, F.concat(F.lit("alias "), k)).otherwise(F.concat(F.lit("entirely new "), k))
    ca = s.select(F.col("s_suppkey").alias("cid"), name.alias("name"), kind, F.array(F.lit(1.0), F.lit(0.1)).alias("embedding"))
    return B.resolve(ca, ex)


def _entities(spark, d):
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_name"))
    kind = F.get(F.array(*[F.lit(x) for x in ("PERSON", "Company", "person", "LOCATION")]), (F.col("c_custkey") % 4).cast("int"))
    return c.select("c_custkey", name.alias("name"), kind.alias("kind"), F.greatest(F.col("c_acctbal") / 10000, F.lit(0.0)).alias("confidence"))


_ENT = "ent AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE c_name END AS name, ['PERSON','Company','person','LOCATION'][(c_custkey % 4)::INT + 1] AS kind, greatest(c_acctbal / 10000, 0.0) AS confidence FROM customer)"


@register("ontology_validate_entities", f"WITH {_ENT} SELECT c_custkey, CASE WHEN trim(name) = '' THEN 'EmptyEntityName' WHEN kind NOT IN ({_KNOWN}) THEN 'UnknownEntityType' WHEN confidence < 0.5 THEN 'ConfidenceBelowThreshold' END AS problem FROM ent")
def ontology_validate_entities(spark, d):
    return _entities(spark, d).select("c_custkey", B.entity_problem(F.col("name"), F.col("kind"), F.col("confidence"), 0.5).alias("problem"))


@register("ontology_validate_relationships", """SELECT o_orderkey, CASE WHEN p NOT IN ('works_at','located_in','mentions','related_to','co_occurrence') THEN 'UnknownRelationshipType' WHEN s IS NULL THEN 'InvalidDomain' WHEN p = 'works_at' AND (s NOT IN ('PERSON','Judge') OR t NOT IN ('Company','ORGANIZATION')) THEN 'InvalidDomain' WHEN p = 'located_in' AND t NOT IN ('City', 'LOCATION') THEN 'InvalidDomain' END AS problem FROM (
SELECT o_orderkey, ['works_at','located_in','invented'][(o_orderkey % 3)::INT + 1] AS p, ['PERSON','Judge','Company',NULL][(o_orderkey % 4)::INT + 1] AS s, ['Company','City','PERSON'][(o_custkey % 3)::INT + 1] AS t FROM orders)""")
def ontology_validate_relationships(spark, d):
    pick = lambda xs, k, m: F.get(F.array(*[F.lit(x) for x in xs]), (F.col(k) % m).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", pick(["works_at", "located_in", "invented"], "o_orderkey", 3).alias("p"), pick(["PERSON", "Judge", "Company", None], "o_orderkey", 4).alias("s"), pick(["Company", "City", "PERSON"], "o_custkey", 3).alias("t"))
    return o.select("o_orderkey", B.relation_problem(F.col("p"), F.col("s"), F.col("t")).alias("problem"))


@register("ontology_validate_names", f"WITH {_ENT} SELECT DISTINCT kind, 'warning' AS level FROM ent WHERE kind NOT IN ({_KNOWN})")
def ontology_validate_names(spark, d):
    known = [t for k, v in B.ENTITY_TYPES.items() for t in (k, *v)]
    return _entities(spark, d).select("kind").distinct().where(~F.col("kind").isin(known)).withColumn("level", F.lit("warning"))


@register("ontology_default", "SELECT unnest([" + ", ".join(f"'{k}'" for k in B.ENTITY_TYPES) + "]) AS name, unnest([" + ", ".join(str(len(v)) for v in B.ENTITY_TYPES.values()) + "])::BIGINT AS n_subtypes")
def ontology_default(spark, d):
    return spark.createDataFrame([(k, len(v)) for k, v in B.ENTITY_TYPES.items()], "name string, n_subtypes long")


@register("is_subtype_of", "WITH RECURSIVE c AS (SELECT 'p:' || r_regionkey AS t, 'p:' || r_regionkey AS up, 0 AS k FROM region UNION ALL SELECT 'n:' || n_nationkey, 'n:' || n_nationkey, 0 FROM nation UNION ALL SELECT c.t, 'p:' || n_regionkey, k + 1 FROM c JOIN nation ON c.up = 'n:' || n_nationkey) SELECT t, up FROM c")
def is_subtype_of(spark, d):
    """Reflexive-transitive closure of the parent links."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    parent = n.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("t"), F.concat(F.lit("p:"), F.col("n_regionkey").cast("string")).alias("p"))
    types = r.select(F.concat(F.lit("p:"), F.col("r_regionkey").cast("string")).alias("t")).unionByName(parent.select("t"))
    return B.ancestors(types, parent)


@register("prune_dangling_binary", f"WITH {N}, {E} SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT id FROM nodes WHERE confidence > 0.5) AND dst IN (SELECT id FROM nodes WHERE confidence > 0.5)")
def prune_dangling_binary(spark, d):
    return B.prune_dangling(D.edges(spark, d), D.nodes(spark, d).where("confidence > 0.5")).select("src", "dst", "edge_type")


@register("two_stage_edges", f"WITH {N}, {E}, f AS (SELECT id FROM nodes WHERE entity_type IN ('Nation', 'Region')) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM f) AND dst IN (SELECT id FROM f)")
def two_stage_edges(spark, d):
    return B.prune_dangling(D.edges(spark, d), D.nodes(spark, d).where("entity_type IN ('Nation', 'Region')")).select("src", "dst")


def _hyper(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("edge_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")))).alias("participants"))


#: Cheap parts, so that some orders hold no other; an order's parts are the participants of one hyperedge.
_KEPT_PARTS = "p_retailprice <= (SELECT quantile_disc(p_retailprice, 0.8) FROM part)"


@register("prune_dangling_hyper", f"WITH h AS (SELECT l_orderkey AS edge_id, list_sort(list(DISTINCT 'p:' || l_partkey)) AS ps FROM lineitem GROUP BY 1), k AS (SELECT list('p:' || p_partkey) AS known FROM part WHERE {_KEPT_PARTS}) SELECT edge_id, array_to_string(ps, ',') AS participants FROM h, k WHERE list_has_all(known, ps)")
def prune_dangling_hyper(spark, d):
    part = table(spark, d, "part")
    bound = part.agg(F.expr("percentile_disc(0.8) WITHIN GROUP (ORDER BY p_retailprice)")).first()[0]
    known = part.where(F.col("p_retailprice") <= bound).select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"))
    return B.prune_dangling_hyper(_hyper(spark, d), known).select("edge_id", F.array_join("participants", ",").alias("participants"))


@register("prune_low_weight_topk", f"WITH {E} SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM edges WHERE weight >= 0.2) WHERE r <= 10")
def prune_low_weight_topk(spark, d):
    return B.prune_low_weight(D.edges(spark, d), 0.2, 10).select("src", "dst", "weight")


@register("adjacency_build", "WITH h AS (SELECT DISTINCT l_orderkey, 'p:' || l_partkey AS p FROM lineitem) SELECT a.p AS node, b.p AS neighbour, 'out' AS direction FROM h a JOIN h b ON a.l_orderkey = b.l_orderkey AND a.p <> b.p UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'out' FROM supplier UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'in' FROM supplier")
def adjacency_build(spark, d):
    none = F.lit(None)
    hyper = _hyper(spark, d).select(none.cast("string").alias("src"), none.cast("string").alias("dst"), "participants")
    s = table(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("dst"), none.cast("array<string>").alias("participants"))
    return B.adjacency(hyper.unionByName(s))


def _sides(spark, d):
    c = table(spark, d, "customer")
    key = F.lower("c_name").alias("dedup_key")
    ident = F.concat(F.lit("e"), F.col("c_custkey").cast("string"))
    e = c.where("c_custkey % 3 <> 0").select(key, ident.alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("description"), F.array(F.col("c_name")).alias("aliases"), F.lit(0.5).alias("confidence"))
    i = c.where("c_custkey % 5 <> 0").select(key, F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.lit("seen")).alias("description"), F.array(F.lit("x"), F.col("c_name")).alias("aliases"), F.lit(0.9).alias("confidence"))
    return e, i


_SIDES = """e AS (SELECT lower(c_name) AS k, 'e' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS de, c_name AS al, 0.5::DOUBLE AS co FROM customer WHERE c_custkey % 3 <> 0),
i AS (SELECT lower(c_name) AS k, 'i' || c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN 'seen' END AS de, concat('x,', c_name) AS al, 0.9::DOUBLE AS co FROM customer WHERE c_custkey % 5 <> 0)"""
_out = lambda df: df.select("dedup_key", "id", "description", F.array_join("aliases", ",").alias("aliases"), F.round("confidence", 6).alias("confidence"))


@register("merge_keep_first", f"WITH {_SIDES} SELECT coalesce(e.k, i.k) AS dedup_key, coalesce(e.id, i.id) AS id, CASE WHEN e.k IS NULL THEN i.de ELSE e.de END AS description, coalesce(e.al, i.al) AS aliases, coalesce(e.co, i.co) AS confidence FROM e FULL JOIN i ON e.k = i.k")
def merge_keep_first(spark, d):
    return _out(B.merge_nodes(*_sides(spark, d), "keep_first"))


@register("merge_keep_last", f"WITH {_SIDES} SELECT coalesce(e.k, i.k) AS dedup_key, coalesce(e.id, i.id) AS id, CASE WHEN i.k IS NULL THEN e.de ELSE i.de END AS description, coalesce(i.al, e.al) AS aliases, coalesce(i.co, e.co) AS confidence FROM e FULL JOIN i ON e.k = i.k")
def merge_keep_last(spark, d):
    return _out(B.merge_nodes(*_sides(spark, d), "keep_last"))


_MERGED = f"WITH {_SIDES} SELECT coalesce(e.k, i.k) AS dedup_key, coalesce(e.id, i.id) AS id, CASE WHEN e.de IS NOT NULL AND i.de IS NOT NULL THEN concat(e.de, ' | ', i.de) ELSE coalesce(e.de, i.de) END AS description, CASE WHEN e.k IS NULL THEN i.al WHEN i.k IS NULL THEN e.al ELSE concat(e.al, ',x') END AS aliases, round(CASE WHEN e.k IS NULL THEN i.co WHEN i.k IS NULL THEN e.co ELSE (e.co + i.co) / 2 END, 6) AS confidence FROM e FULL JOIN i ON e.k = i.k"


@register("merge_field_overwrite", _MERGED)
def merge_field_overwrite(spark, d):
    return _out(B.merge_nodes(*_sides(spark, d)))


def _full(df, side: str):
    """All fields of a node, some of them missing."""
    k = F.expr("cast(substring(id, 2) as long)")
    given = lambda m, c: F.when(k % m != 0, c)
    props = F.create_map(F.lit("both"), F.lit(side), F.concat(F.lit("of_"), F.lit(side)), k.cast("string"))
    return df.select("*", given(4, F.concat(F.lit(side), k.cast("string"))).alias("display_label"), given(3, F.lit(side)).alias("ontology_class"), F.array(F.lit("d0"), F.concat(F.lit("d"), F.lit(side))).alias("doc_origins"), props.alias("properties"))


@register("nodes_merge_on_key", f"""WITH {_SIDES}, x AS (SELECT e.*, substring(id, 2)::BIGINT AS n FROM e), y AS (SELECT i.*, substring(id, 2)::BIGINT AS n FROM i)
SELECT coalesce(x.k, y.k) AS dedup_key, coalesce(x.id, y.id) AS id, CASE WHEN x.n % 4 <> 0 THEN 'e' || x.n WHEN y.n % 4 <> 0 THEN 'i' || y.n END AS display_label, CASE WHEN x.n % 3 <> 0 THEN 'e' WHEN y.n % 3 <> 0 THEN 'i' END AS ontology_class,
CASE WHEN x.k IS NULL THEN 'd0,di' WHEN y.k IS NULL THEN 'd0,de' ELSE 'd0,de,di' END AS doc_origins,
CASE WHEN x.k IS NULL THEN 'both=i,of_i=' || y.n WHEN y.k IS NULL THEN 'both=e,of_e=' || x.n ELSE 'both=e,of_e=' || x.n || ',of_i=' || y.n END AS properties FROM x FULL JOIN y ON x.k = y.k""")
def nodes_merge_on_key(spark, d):
    """The fields that ``merge_field_overwrite`` doesn't show."""
    e, i = _sides(spark, d)
    out = B.merge_nodes(_full(e, "e"), _full(i, "i"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return out.select("dedup_key", "id", "display_label", "ontology_class", F.array_join("doc_origins", ",").alias("doc_origins"), shown.alias("properties"))


def _edge_sides(spark, d):
    """Edges order -> part as two feeds saw them, keyed by order and part."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_quantity").alias("q"), F.min("l_shipdate").alias("t"), F.min("l_returnflag").alias("f"), F.min("l_suppkey").alias("s"))
    k = F.concat_ws(">", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    given = lambda m, c: F.when(F.col("l_partkey") % m != 0, c)

    def side(p: str, rows, m: int):
        return rows.select(
            k.alias("dedup_key"), F.concat(F.lit(p), k).alias("id"), given(m, F.concat(F.lit(p), F.col("f"))).alias("context"), F.when(F.col("l_partkey") % (m + 1) == 0, "").otherwise(F.lit(f"{p}_has")).alias("predicate"),
            given(m + 2, F.col("t").cast("date").cast("string")).alias("time"), given(m, F.lit(f"at_{p}")).alias("location"), given(m + 1, F.array(F.lit("o"), F.concat(F.lit(p), F.col("s").cast("string")))).alias("participants"),
            F.array(F.lit("d"), F.lit(p)).alias("doc_origins"), (F.col("q") / (10 * m)).alias("weight"),
        )

    return side("e", li.where("l_partkey % 2 = 0 OR l_orderkey % 3 = 0"), 3), side("i", li.where("l_partkey % 2 = 1 OR l_orderkey % 5 = 0"), 2)


_EDGE_SIDES = """li AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_quantity) AS q, min(l_shipdate) AS t, min(l_returnflag) AS f, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
e AS (SELECT o || '>' || p AS k, CASE WHEN p % 3 <> 0 THEN 'e' || f END AS cx, CASE WHEN p % 4 = 0 THEN '' ELSE 'e_has' END AS pr, CASE WHEN p % 5 <> 0 THEN t::DATE::VARCHAR END AS tm, CASE WHEN p % 3 <> 0 THEN 'at_e' END AS lo, CASE WHEN p % 4 <> 0 THEN 'o,e' || s END AS pa, q / 30 AS w FROM li WHERE p % 2 = 0 OR o % 3 = 0),
i AS (SELECT o || '>' || p AS k, CASE WHEN p % 2 <> 0 THEN 'i' || f END AS cx, CASE WHEN p % 3 = 0 THEN '' ELSE 'i_has' END AS pr, CASE WHEN p % 4 <> 0 THEN t::DATE::VARCHAR END AS tm, CASE WHEN p % 2 <> 0 THEN 'at_i' END AS lo, CASE WHEN p % 3 <> 0 THEN 'o,i' || s END AS pa, q / 20 AS w FROM li WHERE p % 2 = 1 OR o % 5 = 0)"""


@register("merge_field_overwrite_edges", f"""WITH {_EDGE_SIDES} SELECT coalesce(e.k, i.k) AS dedup_key, CASE WHEN e.k IS NOT NULL THEN 'e' || e.k ELSE 'i' || i.k END AS id, CASE WHEN e.cx IS NOT NULL AND i.cx IS NOT NULL THEN e.cx || ' | ' || i.cx ELSE coalesce(e.cx, i.cx) END AS context,
coalesce(nullif(e.pr, ''), i.pr, e.pr) AS predicate, coalesce(e.tm, i.tm) AS time, coalesce(e.lo, i.lo) AS location, CASE WHEN e.pa IS NOT NULL AND i.pa IS NOT NULL THEN e.pa || substring(i.pa, 2) ELSE coalesce(e.pa, i.pa) END AS participants,
CASE WHEN e.k IS NULL THEN 'd,i' WHEN i.k IS NULL THEN 'd,e' ELSE 'd,e,i' END AS doc_origins, round(CASE WHEN e.k IS NULL THEN i.w WHEN i.k IS NULL THEN e.w ELSE (e.w + i.w) / 2 END, 6) AS weight FROM e FULL JOIN i ON e.k = i.k""")
def merge_field_overwrite_edges(spark, d):
    out = B.merge_edges(*_edge_sides(spark, d))
    listed = lambda c: F.array_join(c, ",").alias(c)
    return out.select("dedup_key", "id", "context", "predicate", "time", "location", listed("participants"), listed("doc_origins"), F.round("weight", 6).alias("weight"))


def _incoming(spark, d):
    """Orders are the collection, their lines come in; only orders of even number are held."""
    o, li = table(spark, d, "orders").where("o_orderkey % 2 = 0"), table(spark, d, "lineitem")
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("dedup_key")
    e = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), key("o_orderkey"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("description"), F.lit(0.05).alias("confidence"))
    parts = F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    i = li.select(parts.alias("id"), key("l_orderkey"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("description"), F.col("l_discount").cast("double").alias("confidence"), F.col("l_linenumber").alias("seq"))
    return e, i


_INCOMING = """e AS (SELECT 'o' || o_orderkey AS id, 'k' || o_orderkey AS dedup_key, o_orderstatus AS label, o_orderpriority AS description, 0.05::DOUBLE AS confidence FROM orders WHERE o_orderkey % 2 = 0),
i AS (SELECT concat_ws('-', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS id, 'k' || l_orderkey AS dedup_key, l_returnflag AS label, l_linestatus AS description, l_discount::DOUBLE AS confidence, l_linenumber AS seq FROM lineitem),
w AS (SELECT i.dedup_key, e.id, i.label, i.description, i.confidence, row_number() OVER o AS r, count(*) OVER (PARTITION BY i.dedup_key) AS n,
  coalesce(lag(i.label) OVER o, e.label) AS pl, coalesce(lag(i.description) OVER o, e.description) AS pd, coalesce(lag(i.confidence) OVER o, e.confidence) AS pc FROM i JOIN e ON e.dedup_key = i.dedup_key WINDOW o AS (PARTITION BY i.dedup_key ORDER BY i.seq, i.id)),
m AS (SELECT dedup_key, any_value(id) AS id, arg_max(label, r) AS label, arg_max(description, r) AS description, arg_max(confidence, r) AS confidence, count(*) AS n_merged, count(*) FILTER (WHERE label IS DISTINCT FROM pl OR description IS DISTINCT FROM pd OR confidence IS DISTINCT FROM pc) AS n_conflicted FROM w GROUP BY 1),
al AS (SELECT dedup_key, id, label, description, confidence, 'merged' AS outcome, n_merged, n_conflicted FROM m
  UNION ALL SELECT dedup_key, id, label, description, confidence, 'kept', 0, 0 FROM e WHERE dedup_key NOT IN (SELECT dedup_key FROM i)
  UNION ALL SELECT dedup_key, id, label, description, confidence, 'inserted', 0, 0 FROM i WHERE dedup_key NOT IN (SELECT dedup_key FROM e))"""


@register("merge_into_collection", f"WITH {_INCOMING} SELECT dedup_key, CASE WHEN outcome = 'inserted' THEN 'new' ELSE id END AS id, label, description, confidence, outcome, n_merged, n_conflicted FROM al")
def merge_into_collection(spark, d):
    out = M.merge_into(*_incoming(spark, d), "keep_last")
    return out.select("dedup_key", F.when(F.col("outcome") == "inserted", "new").otherwise(F.col("id")).alias("id"), "label", "description", "confidence", "outcome", "n_merged", "n_conflicted")


@register("merge_report", f"WITH {_INCOMING} SELECT coalesce(sum(n_merged), 0)::BIGINT AS merged, count(*) FILTER (WHERE outcome = 'inserted') AS inserted, coalesce(sum(n_conflicted), 0)::BIGINT AS conflicted FROM al")
def merge_report(spark, d):
    return M.report(M.merge_into(*_incoming(spark, d), "keep_last"))


@register("alias_union", f"WITH {_SIDES} SELECT e.k AS dedup_key, concat(e.al, ',x') AS aliases FROM e JOIN i ON e.k = i.k")
def alias_union(spark, d):
    e, i = _sides(spark, d)
    return e.join(i.select("dedup_key", F.col("aliases").alias("b")), "dedup_key").select("dedup_key", F.array_join(F.array_union("aliases", "b"), ",").alias("aliases"))


@register("chunk_ids_union", "SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS ids FROM lineitem GROUP BY 1")
def chunk_ids_union(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_orderkey")), ",").alias("ids"))


_NODE_PAIR = """a AS (SELECT c_custkey AS k, c_name AS label, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description, (c_acctbal / 1000)::DOUBLE AS confidence, [c_name, c_mktsegment] AS aliases, CASE WHEN c_custkey % 3 = 0 THEN 'PERSON' END AS ontology_class, NULL::VARCHAR AS display_label FROM customer),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS label, c_mktsegment AS description, CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE (c_acctbal / 1000)::DOUBLE END AS confidence, CASE WHEN c_custkey % 7 = 0 THEN [c_name] ELSE [c_name, c_mktsegment] END AS aliases, 'PERSON' AS ontology_class, CASE WHEN c_custkey % 6 = 0 THEN c_name END AS display_label FROM customer WHERE c_custkey % 11 <> 0)"""


def _differing(fields: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT k AS dedup_key, '{f}' AS field, a.{f}::VARCHAR AS a, b.{f}::VARCHAR AS b FROM a JOIN b USING (k) WHERE a.{f}::VARCHAR IS DISTINCT FROM b.{f}::VARCHAR" for f in fields)


@register("detect_node_conflicts", f"WITH {_NODE_PAIR.replace('(c_acctbal / 1000)::DOUBLE', 'c_nationkey / 4.0::DOUBLE')} {_differing(M.NODE_CONFLICTS)}")
def detect_node_conflicts(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    c = c.withColumn("conf", F.col("c_nationkey") / 4.0)
    both = F.array("c_name", "c_mktsegment")
    a = c.select(k.alias("dedup_key"), F.col("c_name").alias("label"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("description"), F.col("conf").alias("confidence"), both.alias("aliases"), F.when(k % 3 == 0, "PERSON").alias("ontology_class"), F.lit(None).cast("string").alias("display_label"))
    b = c.where(k % 11 != 0).select(
        k.alias("dedup_key"), F.when(k % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("label"), F.col("c_mktsegment").alias("description"), F.when(k % 4 == 0, 0.5).otherwise(F.col("conf")).alias("confidence"),
        F.when(k % 7 == 0, F.array("c_name")).otherwise(both).alias("aliases"), F.lit("PERSON").alias("ontology_class"), F.when(k % 6 == 0, F.col("c_name")).alias("display_label"),
    )
    return B.conflicts(a, b, list(M.NODE_CONFLICTS))


_EDGE_SIDE = "SELECT l_orderkey AS k, {0}(l_returnflag) AS predicate, {0}(l_linestatus) AS context, {0}(l_linenumber) AS weight, {0}(l_shipdate)::DATE AS time, {0}(l_partkey % 3) AS location, {0}(l_suppkey % 2) AS display_label FROM lineitem GROUP BY 1"


@register("detect_edge_conflicts", f"WITH a AS ({_EDGE_SIDE.format('min')}), b AS ({_EDGE_SIDE.format('max')}) {_differing(M.EDGE_CONFLICTS)}")
def detect_edge_conflicts(spark, d):
    """The least and the greatest values of an order's lines as the two sides."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("dedup_key"))
    side = lambda f: g.agg(f("l_returnflag").alias("predicate"), f("l_linestatus").alias("context"), f("l_linenumber").alias("weight"), f("l_shipdate").cast("date").alias("time"), f(F.col("l_partkey") % 3).alias("location"), f(F.col("l_suppkey") % 2).alias("display_label"))
    return B.conflicts(side(F.min), side(F.max), list(M.EDGE_CONFLICTS))


@register("merge_nodes_resolved", """WITH r AS (SELECT l_orderkey AS k, 'p' || (l_partkey % 7) AS name, l_discount::DOUBLE AS c, repeat('x', l_quantity::INT) AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount, l_partkey, l_suppkey, l_quantity) AS s FROM lineitem),
m AS (SELECT k, list_reduce(list_prepend(0.9::DOUBLE, list(c ORDER BY s)), lambda a, x: (a + x) / 2) AS c, max(length(t)) AS t FROM r GROUP BY 1),
a AS (SELECT k, string_agg(name, ',' ORDER BY s) AS names FROM (SELECT k, name, min(s) AS s FROM r WHERE name <> 'p1' GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderkey AS id, round(coalesce(c, 0.9) + 1e-12, 8) AS confidence, concat_ws(',', 'p1', names) AS aliases, greatest(coalesce(t, 0), 12) AS longest FROM orders LEFT JOIN m ON m.k = o_orderkey LEFT JOIN a ON a.k = o_orderkey""")
def merge_nodes_resolved(spark, d):
    seq = F.struct("l_linenumber", "l_discount", "l_partkey", "l_suppkey", "l_quantity").alias("seq")
    incoming = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), seq, F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string")).alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.col("l_discount").cast("double").alias("confidence"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("description"))
    canonical = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0.9).alias("confidence"), F.array(F.lit("p1")).alias("aliases"), F.lit("twelve chars").alias("description"))
    out = B.merge_resolved(canonical, incoming, "seq")
    return out.select("id", F.round(F.col("confidence") + 1e-12, 8).alias("confidence"), F.array_join("aliases", ",").alias("aliases"), F.length("description").alias("longest"))


@register("flush_graph_merge", """WITH g AS (SELECT c_mktsegment || '::' || lower(n_name) AS key, c_custkey AS id, (c_custkey % 10) / 10.0::DOUBLE AS c, c_custkey % 4 AS chunk, row_number() OVER o AS r, count(*) OVER (PARTITION BY c_mktsegment || '::' || lower(n_name)) AS n
  FROM customer JOIN nation ON n_nationkey = c_nationkey WINDOW o AS (PARTITION BY c_mktsegment || '::' || lower(n_name) ORDER BY c_custkey))
SELECT key, min(id) AS id, any_value(n) AS n, round(sum(c * pow(0.5::DOUBLE, CASE WHEN r = 1 THEN n - 1 ELSE n - r + 1 END)), 6) AS confidence, array_to_string(list_sort(list(DISTINCT chunk)), ',') AS source_chunk_ids FROM g GROUP BY 1""")
def flush_graph_merge(spark, d):
    """Nodes of one type and label become the first, with the ordered mean of confidences and all chunk ids."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("entity_type"), F.col("n_name").alias("label"), ((F.col("c_custkey") % 10) / 10.0).alias("confidence"), F.array(F.col("c_custkey") % 4).alias("source_chunk_ids"), F.col("c_custkey").alias("seq"))
    return M.flush(nodes).select("key", "id", "n", F.round("confidence", 6).alias("confidence"), F.array_join("source_chunk_ids", ",").alias("source_chunk_ids"))


@register("flush_repoint", "WITH g AS (SELECT c_mktsegment || '::' || lower(n_name) AS k, min(c_custkey) AS id FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) SELECT c_custkey, g.id AS merged_id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN g ON g.k = c_mktsegment || '::' || lower(n_name)")
def flush_repoint(spark, d):
    """References re-pointed to the first node of their type and label."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", F.concat_ws("::", "c_mktsegment", F.lower("n_name")).alias("k"))
    return c.join(c.groupBy("k").agg(F.min("c_custkey").alias("merged_id")), "k").select("c_custkey", "merged_id")


@register("topic_entity_propagation", """WITH nd AS (SELECT p_partkey AS id, [lower(trim(p_name)), lower(trim(p_brand || ' ' || p_type))] AS names, p_type AS old FROM part),
li AS (SELECT DISTINCT lower(trim(CASE WHEN l_linenumber % 2 = 0 THEN ' ' || upper(p_name) ELSE p_brand || ' ' || p_type END)) AS name, CASE WHEN l_linenumber = 1 THEN p_type ELSE 'flag ' || l_returnflag END AS topic FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40),
ne AS (SELECT DISTINCT id, topic FROM (SELECT id, unnest(names) AS name FROM nd) JOIN li USING (name)),
al AS (SELECT id, topic FROM ne UNION SELECT id, old FROM nd WHERE id IN (SELECT id FROM ne))
SELECT id, array_to_string(list_sort(list(topic)), ',') AS topics FROM al GROUP BY 1 HAVING count(*) > 1""")
def topic_entity_propagation(spark, d):
    """Parts are nodes with an alias and a topic; links name them by label or alias in other case, and only changed nodes come out."""
    from quillgraph.operators import tagging

    p, li = table(spark, d, "part"), table(spark, d, "lineitem").where("l_quantity > 40")
    alias = F.concat("p_brand", F.lit(" "), "p_type")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.array(alias).alias("aliases"), F.array("p_type").alias("topics"))
    entity = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(alias)
    topic = F.when(F.col("l_linenumber") == 1, F.col("p_type")).otherwise(F.concat(F.lit("flag "), "l_returnflag"))
    links = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(topic.alias("topic"), entity.alias("entity"))
    return tagging.propagate_topics(nodes, links).select("id", F.array_join("topics", ",").alias("topics"))


@register("chunk_doc_join", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE 'unknown' END AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 2 = 0")
def chunk_doc_join(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderkey") % 2 == 0), "left")
    return j.select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("title"))
