"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import scalars as S
from quillgraph.operators import text as X
from quillgraph.registry import register
from quillgraph.session import table
from quillgraph.sources import domain as D

docs = lambda s, d: table(s, d, "documents")
N, E = f"WITH {D.NODES_SQL}", f"WITH {D.EDGES_SQL}"


@register("normalize_name", r"SELECT DISTINCT p_name, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM part")
def normalize_name(spark, d):
    return table(spark, d, "part").select("p_name", S.normalize_name(F.col("p_name")).alias("norm")).distinct()


@register("normalize_ascii", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM documents")
def normalize_ascii(spark, d):
    return docs(spark, d).select("doc_id", S.normalize_name(F.col("text"), ascii_only=True).alias("norm"))


@register("estimate_tokens", "SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS n FROM documents")
def estimate_tokens(spark, d):
    return docs(spark, d).select("doc_id", S.estimate_tokens(F.col("text")).alias("n"))


@register("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


@register("bm25_norm_ratio", "SELECT event_id, round(abs(value) / (abs(value) + 1), 6) AS score FROM events")
def bm25_norm_ratio(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.bm25_ratio(F.abs("value")), 6).alias("score"))


@register("bm25_norm_tanh", "SELECT event_id, round(tanh(value / 10), 6) AS score FROM events")
def bm25_norm_tanh(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.bm25_tanh(F.col("value")), 6).alias("score"))


@register("levenshtein", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def levenshtein(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("i < j").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"))


@register("cosine_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("b")), 5).alias("sim"))


@register("vector_score", "SELECT event_id, greatest(0, 1 - value) AS score FROM events")
def vector_score(spark, d):
    return table(spark, d, "events").select("event_id", S.vector_score(F.col("value")).alias("score"))


@register("hop_score", "SELECT n_nationkey, 1.0::DOUBLE / (n_regionkey + 1) AS score FROM nation")
def hop_score(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.hop_score(F.col("n_regionkey")).alias("score"))


@register("edge_cost", f"{E} SELECT src, dst, round(1 / greatest(weight, 0.001), 6) AS cost FROM edges")
def edge_cost(spark, d):
    return D.edges(spark, d).select("src", "dst", F.round(S.edge_cost(F.col("weight")), 6).alias("cost"))


@register("cooc_weight", "SELECT l_orderkey, least(count(*) / 10.0::DOUBLE, 1.0::DOUBLE) AS w FROM lineitem GROUP BY 1")
def cooc_weight(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select("l_orderkey", S.cooccurrence_weight(F.col("n")).alias("w"))


@register("compile_key", r"SELECT o_orderkey, regexp_replace(concat(coalesce(o_custkey::VARCHAR, ''), '|', coalesce(o_orderstatus, ''), '@', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END), '[@|]+$', '') AS k FROM orders")
def compile_key(spark, d):
    time = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", S.compile_key("{source}|{predicate}@{time}", {"source": F.col("o_custkey"), "predicate": F.col("o_orderstatus"), "time": time}).alias("k"))


@register("compile_label", "SELECT c_custkey, concat(c_name, ' (', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END, ')') AS label FROM customer")
def compile_label(spark, d):
    kind = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", S.compile_label("{name} ({entity_type})", {"name": F.col("c_name"), "entity_type": kind}).alias("label"))


@register("xml_escape", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS x FROM documents""")
def xml_escape(spark, d):
    return docs(spark, d).select("doc_id", S.xml_escape(F.col("text")).alias("x"))


@register("slug", "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS slug FROM part")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"))


@register("doc_title", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '[^/]*$') ELSE url END AS title FROM pages")
def doc_title(spark, d):
    title = F.when(F.col("page_id") % 2 == 0, F.lit("123e4567-e89b-12d3-a456-426614174000")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", S.doc_title(title, F.col("url")).alias("title"))


@register("file_type_from_ext", "SELECT s_suppkey, ['pdf','docx','markdown','text','html','rst','unknown'][(s_suppkey % 7)::INT + 1] AS kind FROM supplier")
def file_type_from_ext(spark, d):
    exts = F.array(*[F.lit(x) for x in ("PDF", "docx", "markdown", "txt", "htm", "rst", "exe")])
    path = F.concat(F.lit("/in/a."), F.get(exts, (F.col("s_suppkey") % 7).cast("int")))
    return table(spark, d, "supplier").select("s_suppkey", S.file_type(path).alias("kind"))


@register("json_tags", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS n_tags, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS first_label FROM events""")
def json_tags(spark, d):
    good = F.to_json(F.array(F.struct(F.col("event_type").alias("label"), F.lit("x").alias("text"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1.0).alias("score"))))
    tags = S.parse_tags(F.when(F.col("event_id") % 5 == 0, F.lit("[{broken")).otherwise(good))
    return table(spark, d, "events").select("event_id", F.filter(tags, lambda t: t["label"].isNotNull()).alias("t")).select("event_id", F.size("t").cast("long").alias("n_tags"), F.get("t", F.lit(0))["label"].alias("first_label"))


@register("iso_to_micros", "SELECT o_orderkey, epoch_us(o_orderdate::DATE::TIMESTAMP) AS start_us, epoch_us(o_orderdate::DATE::TIMESTAMP) + 86400000000 AS end_us FROM orders")
def iso_to_micros(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    us = F.unix_micros(F.to_timestamp(iso))
    return table(spark, d, "orders").select("o_orderkey", us.alias("start_us"), (us + 86_400_000_000).alias("end_us"))


@register("chunk_hash", "SELECT l_orderkey, sha1(string_agg(DISTINCT l_partkey::VARCHAR, '|' ORDER BY l_partkey::VARCHAR)) AS h FROM lineitem GROUP BY 1")
def chunk_hash(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(S.chunk_hash(F.collect_set(F.col("l_partkey").cast("string"))).alias("h"))


@register("truncate_context", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN concat(left(text, 1000), chr(10), '...[truncated]') ELSE text END AS t FROM documents")
def truncate_context(spark, d):
    return docs(spark, d).select("doc_id", S.truncate_context(F.col("text"), 1000).alias("t"))


@register("looks_like_garbage", f"WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(text, repeat(' ?Identity-H', 11)) WHEN 1 THEN concat(text, repeat(' ?Unimplemented', 10)) ELSE text END AS text FROM documents) SELECT doc_id, coalesce(length(text), 0) < 100 OR (length(text) - length(replace(text, '?Identity-H', ''))) / 11 > 10 OR (length(text) - length(replace(text, 'Identity-H Unimplemented', ''))) / 24 > 10 OR (length(text) - length(replace(text, '?Unimplemented', ''))) / 14 > 10 OR length(text) - length(replace(text, '?', '')) > 0.4 * length(text) AS garbage FROM t")
def looks_like_garbage(spark, d):
    marked = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.repeat(F.lit(" ?Identity-H"), 11))).when(F.col("doc_id") % 4 == 1, F.concat("text", F.repeat(F.lit(" ?Unimplemented"), 10))).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", S.looks_like_garbage(marked).alias("garbage"))


@register("entity_type_parse", "SELECT DISTINCT c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'person' ELSE c_mktsegment END AS t FROM customer")
def entity_type_parse(spark, d):
    x = F.when(F.col("c_custkey") % 2 == 0, F.lit("PERSON")).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_mktsegment", S.parse_type(x, S.ENTITY_TYPES).alias("t")).distinct()


@register("edge_type_parse", f"{E} SELECT DISTINCT edge_type, CASE WHEN edge_type = 'supplies' THEN 'SUPPLIES' ELSE edge_type END AS t FROM edges")
def edge_type_parse(spark, d):
    return D.edges(spark, d).select("edge_type", S.parse_type(F.upper("edge_type"), S.EDGE_TYPES).alias("t")).distinct()


@register("json_repair", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"topics": [' || props || '], "entity_topic_links": [{"a": "x } y"}]}' ELSE '{"topics": [{"k": {"n": 1}}, ' || props || '], "entity_topic_links": []}' END AS fixed FROM events""")
def json_repair(spark, d):
    """Fenced, chatty, whole and cut-off answers."""
    p = F.col("props")
    whole = F.concat(F.lit('{"topics": ['), p, F.lit('], "entity_topic_links": [{"a": "x } y"}]}'))
    broken = F.concat(F.lit('```json\n{"topics": [{"k": {"n": 1}}, {"bad": }, '), p, F.lit(', {"k": "cut } off'))
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\nhere: "), p, F.lit(" thanks\n```"))).when(F.col("event_id") % 3 == 1, whole).otherwise(broken)
    return X.repaired(table(spark, d, "events").select("event_id", said.alias("said")), "event_id", "said").select("event_id", F.col("answer").alias("fixed"))


@register("doc_by_json_field", "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def doc_by_json_field(spark, d):
    return table(spark, d, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id", "user_id")


@register("doc_by_path", "SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages) ORDER BY page_id LIMIT 1")
def doc_by_path(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    first = p.agg(F.min("url").alias("url"))
    return p.join(F.broadcast(first), "url").select("page_id", "url").orderBy("page_id").limit(1)
