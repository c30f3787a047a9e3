"""Queries of statistics, selections and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import patterns as P
from quillgraph.functions import scalars as S
from quillgraph.registry import register
from quillgraph.session import table

_TAGS = "tags AS (" + " UNION ALL ".join(f"SELECT doc_id, '{lab}' AS label, unnest(regexp_extract_all(text, '{p.replace("'", "''")}', 0, 'i')) AS match FROM documents" for _, n, lab, p in P.PATTERNS) + ")"


def tags(spark, d):
    return P.find_all(table(spark, d, "documents").select("doc_id", "text"), P.PATTERNS).select("doc_id", "label", "match")


@register("ner_label_counts", f"WITH {_TAGS} SELECT label, count(*) AS n, count(DISTINCT doc_id) AS chunks FROM tags GROUP BY 1")
def ner_label_counts(spark, d):
    return tags(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("chunks"))


@register("ner_labels_present", f"WITH {_TAGS} SELECT DISTINCT label FROM tags")
def ner_labels_present(spark, d):
    return tags(spark, d).select("label").distinct()


@register("ner_keyword_topn", f"WITH {_TAGS}, c AS (SELECT label, lower(trim(match)) AS kw, count(DISTINCT doc_id) AS n FROM tags GROUP BY 1, 2) SELECT label, kw, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, kw) AS r FROM c) WHERE r <= 30")
def ner_keyword_topn(spark, d):
    c = tags(spark, d).select("label", F.lower(F.trim("match")).alias("kw"), "doc_id").groupBy("label", "kw").agg(F.count_distinct("doc_id").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "kw"))).where("r <= 30").drop("r")


@register("ids_with_label", f"WITH {_TAGS} SELECT DISTINCT doc_id FROM tags WHERE label IN ('EMAIL_ADDRESS', 'IP_ADDRESS')")
def ids_with_label(spark, d):
    return tags(spark, d).where(F.col("label").isin("EMAIL_ADDRESS", "IP_ADDRESS")).select("doc_id").distinct()


@register("ids_with_keyword", "SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'license')")
def ids_with_keyword(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").where(F.contains(low, F.lit("idiot")) | F.contains(low, F.lit("license"))).select("doc_id")


@register("topic_canonicalize", "SELECT p_partkey, CASE WHEN p_size < 10 THEN concat('small-', p_size % 3) ELSE p_type END AS topic FROM part")
def topic_canonicalize(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, F.concat(F.lit("size "), F.col("p_size").cast("string"))).otherwise(F.col("p_type")).alias("raw"))
    maps = spark.createDataFrame([(f"size {k}", f"small-{k % 3}") for k in range(10)], "raw string, canonical string")
    return p.join(F.broadcast(maps), "raw", "left").select("p_partkey", F.coalesce("canonical", "raw").alias("topic"))


@register("topic_stats", "SELECT p_type AS topic, count(DISTINCT l_orderkey) AS frequency, array_to_string(list_sort(list(DISTINCT p_brand))[1:20], ',') AS keywords, count(DISTINCT l_suppkey) AS node_count FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def topic_stats(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_type").alias("topic")).agg(F.count_distinct("l_orderkey").alias("frequency"), F.array_join(F.slice(F.array_sort(F.collect_set("p_brand")), 1, 20), ",").alias("keywords"), F.count_distinct("l_suppkey").alias("node_count"))


@register("topic_cooccurrence", "WITH m AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2 HAVING count(*) >= 2")
def topic_cooccurrence(spark, d):
    from quillgraph.operators.build import cooccurrence

    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return cooccurrence(j, "l_orderkey", "p_brand", 2).drop("weight")


@register("topic_counts_from_nodes", "SELECT p_type AS topic, replace(lower(p_type), ' ', '_') AS slug, count(*) AS n FROM part GROUP BY 1, 2")
def topic_counts_from_nodes(spark, d):
    return table(spark, d, "part").select(F.explode(F.array("p_type")).alias("topic")).groupBy("topic").agg(F.count("*").alias("n")).select("topic", S.slug(F.col("topic")).alias("slug"), "n")


@register("topic_nodes", "SELECT p_partkey FROM part WHERE replace(lower(p_type), ' ', '_') = (SELECT min(replace(lower(p_type), ' ', '_')) FROM part)")
def topic_nodes(spark, d):
    p = table(spark, d, "part").select("p_partkey", S.slug(F.col("p_type")).alias("slug"))
    return p.join(F.broadcast(p.agg(F.min("slug").alias("slug"))), "slug").select("p_partkey")


@register("chunks_to_documents", "SELECT o_custkey AS doc_id, arg_min(o_orderpriority, o_orderkey) AS title, count(*) AS chunks FROM orders GROUP BY 1")
def chunks_to_documents(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("title"), F.count("*").alias("chunks"))


@register("prf_eval", """WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS truth, list(DISTINCT l_partkey) FILTER (WHERE l_linenumber % 2 = 1 OR l_partkey % 3 = 0) AS p0, list(DISTINCT -l_partkey) FILTER (WHERE l_linenumber % 5 = 0) AS p1 FROM lineitem GROUP BY 1),
b AS (SELECT k, truth, list_concat(coalesce(p0, []), coalesce(p1, [])) AS pred FROM a), c AS (SELECT k, len(truth) AS t, len(pred) AS p, len(list_intersect(truth, pred)) AS hit FROM b),
s AS (SELECT k, CASE WHEN p = 0 THEN 0.0 ELSE hit::DOUBLE / p END AS precision, hit::DOUBLE / t AS recall FROM c)
SELECT k, round(precision, 4) AS precision, round(recall, 4) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 4) AS f1 FROM s""")
def prf_eval(spark, d):
    none = F.array().cast("array<bigint>")
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_set("l_partkey").alias("truth"), F.collect_set(F.when((F.col("l_linenumber") % 2 == 1) | (F.col("l_partkey") % 3 == 0), F.col("l_partkey"))).alias("p0"), F.collect_set(F.when(F.col("l_linenumber") % 5 == 0, -F.col("l_partkey"))).alias("p1")
    )
    g = g.withColumn("pred", F.concat(F.coalesce("p0", none), F.coalesce("p1", none)))
    hit = F.size(F.array_intersect("truth", "pred"))
    g = g.select("k", F.when(F.size("pred") == 0, 0.0).otherwise(hit / F.size("pred")).alias("p"), (hit / F.size("truth")).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return g.select("k", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


# Prices by 1000 tokens (model, input, output); other models take the last row's.
PRICES = [("gpt-4o", 0.005, 0.015), ("gpt-4o-mini", 0.00015, 0.0006), ("text-embedding-3-large", 0.00013, 0.0), ("llama3.2", 0.0, 0.0), ("qwen3-embedding", 0.0, 0.0)]
_PRICE = "CASE event_id % 4 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN 0 ELSE {} END"
_COST = "(user_id * " + _PRICE.format(0.005, 0.00015, 0.005) + " + (event_id % 100) * " + _PRICE.format(0.015, 0.0006, 0.015) + ") / 1000.0"


def _costs(spark, d):
    model = F.get(F.array(*[F.lit(x) for x in ("gpt-4o", "gpt-4o-mini", "llama3.2", "unheard-of")]), (F.col("event_id") % 4).cast("int"))
    e = table(spark, d, "events").select("event_id", "user_id", model.alias("model"), F.col("user_id").alias("n_in"), (F.col("event_id") % 100).alias("n_out"))
    p = F.broadcast(spark.createDataFrame(PRICES, "model string, p_in double, p_out double"))
    return e.join(p, "model", "left").select("event_id", "user_id", ((F.col("n_in") * F.coalesce("p_in", F.lit(0.005)) + F.col("n_out") * F.coalesce("p_out", F.lit(0.015))) / 1000.0).alias("cost"))


@register("llm_cost", f"SELECT event_id, round(({_COST})::DOUBLE, 9) AS cost FROM events")
def llm_cost(spark, d):
    return _costs(spark, d).select("event_id", F.round("cost", 9).alias("cost"))


@register("cost_rollup", f"WITH c AS (SELECT user_id, event_id, ({_COST})::DOUBLE AS cost FROM events), r AS (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM c) SELECT user_id, round(max(total), 9) AS total, min(event_id) FILTER (WHERE total > 0.002) AS stopped_at FROM r GROUP BY 1")
def cost_rollup(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = _costs(spark, d).withColumn("total", F.sum("cost").over(w))
    return r.groupBy("user_id").agg(F.round(F.max("total"), 9).alias("total"), F.min(F.when(F.col("total") > 0.002, F.col("event_id"))).alias("stopped_at"))


@register("finetune_jsonl", """SELECT c.conv_id, c.turn, concat('{"messages":[{"role":"user","content":', to_json(p.text), '},{"role":"', c.role, '","content":', to_json(c.text), '}]}') AS line FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def finetune_jsonl(spark, d):
    c = table(spark, d, "conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    msg = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    return c.join(p, ["conv_id", "turn"]).select("conv_id", "turn", F.to_json(F.struct(F.array(msg(F.lit("user"), F.col("asked")), msg(F.col("role"), F.col("text"))).alias("messages"))).alias("line"))


@register("feedback_list", "SELECT event_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def feedback_list(spark, d):
    e = table(spark, d, "events")
    return e.join(F.broadcast(e.agg(F.min("event_type").alias("event_type"))), "event_type").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").offset(10).limit(50)


@register("random_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def random_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(100)


@register("ground_truth_by_chunk", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT lower(p_name))), ',') AS labels FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def ground_truth_by_chunk(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.lower("p_name"))), ",").alias("labels"))


@register("version_outdated_filter", "SELECT event_id FROM events WHERE event_id % 4 < 2")
def version_outdated_filter(spark, d):
    return table(spark, d, "events").withColumn("ner_version", F.col("event_id") % 4).where("ner_version < 2").select("event_id")


@register("point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark, d):
    return table(spark, d, "customer").where(F.col("c_custkey") == 42).limit(1)


@register("project_columns", "SELECT c_custkey, c_name FROM customer")
def project_columns(spark, d):
    c = table(spark, d, "customer")
    return c.select([x for x in ("c_custkey", "c_name", "not_there") if x in c.columns])


@register("full_table_scan", "SELECT * FROM nation")
def full_table_scan(spark, d):
    return table(spark, d, "nation")


@register("list_collections", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def list_collections(spark, d):
    return table(spark, d, "orders").where("o_custkey = 7").select("o_orderkey")


@register("template_list", "SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 40")
def template_list(spark, d):
    return table(spark, d, "part").where("p_size > 40").select("p_brand", "p_type").distinct()


@register("method_list", "SELECT * FROM (VALUES ('standard', true), ('two_stage', true), ('graph_rag', false), ('light_rag', false)) t(method, implemented)")
def method_list(spark, d):
    return spark.createDataFrame([("standard", True), ("two_stage", True), ("graph_rag", False), ("light_rag", False)], "method string, implemented boolean")


@register("ontology_drift", "SELECT c_mktsegment AS kind, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING') GROUP BY 1 HAVING count(*) >= 5")
def ontology_drift(spark, d):
    """Types that the ontology doesn't know, by count (a feature of the specification only)."""
    known = spark.createDataFrame([("BUILDING",)], "kind string")
    return table(spark, d, "customer").withColumnRenamed("c_mktsegment", "kind").join(F.broadcast(known), "kind", "left_anti").groupBy("kind").agg(F.count("*").alias("n")).where("n >= 5")
