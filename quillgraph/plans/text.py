"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import patterns as P
from quillgraph.operators import tagging as T
from quillgraph.operators import text as X
from quillgraph.registry import register
from quillgraph.session import table

docs = lambda s, d: table(s, d, "documents").select("doc_id", "text")
quoted = lambda p: p.replace("'", "''")


def _all_sql(patterns) -> str:
    one = lambda n, lab, p: f"SELECT doc_id, '{n}' AS name, '{lab}' AS label, unnest(regexp_extract_all(text, '{quoted(p)}', 0, 'i')) AS match FROM documents"
    return " UNION ALL ".join(one(n, lab, p) for _, n, lab, p in patterns)


@register("regex_find_all", _all_sql(P.PATTERNS))
def regex_find_all(spark, d):
    return P.find_all(docs(spark, d), P.PATTERNS)


@register("regex_find_all_patterns")
def regex_find_all_patterns(spark, d):
    """The same; the tests compare it with Python's regex library."""
    return regex_find_all(spark, d)


@register("find_pii", _all_sql(P.of("pii")))
def find_pii(spark, d):
    return P.find_all(docs(spark, d), P.of("pii"))


_LEGAL = "(SELECT doc_id, concat(text, ' see ', doc_id, ' U.S. 45', ', 12 Stat. 9; [2020] UKSC ', doc_id % 50, ' and 40 C.F.R. 60') AS text FROM documents) documents"


@register("find_legal_citations", _all_sql(P.of("legal")).replace("FROM documents", f"FROM {_LEGAL}"))
def find_legal_citations(spark, d):
    text = F.concat("text", F.lit(" see "), F.col("doc_id").cast("string"), F.lit(" U.S. 45, 12 Stat. 9; [2020] UKSC "), (F.col("doc_id") % 50).cast("string"), F.lit(" and 40 C.F.R. 60"))
    return P.find_all(docs(spark, d).select("doc_id", text.alias("text")), P.of("legal"))


@register("regex_spans")
def regex_spans(spark, d):
    return X.tag_spans(docs(spark, d), P.PATTERNS)


@register("citation_tags")
def citation_tags(spark, d):
    text = F.concat(F.lit("In [2019] SGCA "), F.col("doc_id").cast("string"), F.lit(" and (2001) 3 SLR 12. "), F.coalesce("text", F.lit("")))
    return X.citations(docs(spark, d).select("doc_id", text.alias("text")))


@register("redact_pii")
def redact_pii(spark, d):
    return X.redacted(docs(spark, d), P.of("pii"))


_MAIL = next(p for p in P.PATTERNS if p[1] == "email_address")


@register("redact_pii_single", f"SELECT doc_id, regexp_replace(text, '{_MAIL[3]}', '[REDACTED-EMAIL_ADDRESS]', 'gi') AS text FROM documents")
def redact_pii_single(spark, d):
    return docs(spark, d).select("doc_id", P.redact(F.col("text"), _MAIL[3], _MAIL[2]).alias("text"))


@register("extract_text", "SELECT doc_id, 1 AS page, text FROM documents")
def extract_text(spark, d):
    raw = docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return raw.select("doc_id", F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("text"))


@register("extract_markdown", """SELECT doc_id, ((i - 1) // 20 + 1)::INT AS page, string_agg(l, chr(10) ORDER BY i) AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY 1, 2""")
def extract_markdown(spark, d):
    return X.markdown_pages(docs(spark, d), lines=20)


@register("extract_html")
def extract_html(spark, d):
    return X.html_text(table(spark, d, "pages"))


@register("extract_html_title", """SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS title FROM pages""")
def extract_html_title(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


@register("chunk_fixed", "SELECT doc_id, ((p - 1) // 400)::INT AS position, substring(text, p, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 400)) AS p FROM documents) WHERE trim(substring(text, p, 500)) <> ''")
def chunk_fixed(spark, d):
    return X.fixed_chunks(docs(spark, d))


@register("chunk_text")
def chunk_text(spark, d):
    return X.semantic_chunks(docs(spark, d))


@register("resolve_spans", "WITH p AS (SELECT doc_id, unnest(string_split(text, 'th')) AS part, generate_subscripts(string_split(text, 'th'), 1) AS k, len(string_split(text, 'th')) AS n FROM documents) SELECT doc_id, start::INT AS start FROM (SELECT doc_id, k, n, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) + 2 * (k - 1) + 1 AS start FROM p) WHERE k < n")
def resolve_spans(spark, d):
    return docs(spark, d).select("doc_id", F.explode(X.span_positions(F.col("text"), F.lit("th"))).alias("start"))


@register("merge_tags", """WITH a AS (SELECT l_orderkey AS doc_id, (l_linenumber * 10)::INT AS s, (l_linenumber * 10 + floor(l_quantity / 10))::INT AS e FROM lineitem),
b AS (SELECT o_orderkey AS doc_id, (o_custkey % 70)::INT AS s, (o_custkey % 70 + 4)::INT AS e FROM orders)
SELECT doc_id, s AS "start", e AS "end", 'first' AS src FROM a UNION ALL
SELECT doc_id, s, e, 'second' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND b.s < a.e AND a.s < b.e)""")
def merge_tags(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10).cast("int").alias("start"), (F.col("l_linenumber") * 10 + F.floor(F.col("l_quantity") / 10)).cast("int").alias("end"), F.lit("first").alias("src"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 70).cast("int").alias("start"), (F.col("o_custkey") % 70 + 4).cast("int").alias("end"), F.lit("second").alias("src"))
    return X.merge_tags(a, b)


@register("merge_tags_greedy", """WITH RECURSIVE a AS (SELECT l_orderkey AS doc_id, (l_linenumber * 10)::INT AS s, (l_linenumber * 10 + floor(l_quantity / 10))::INT AS e FROM lineitem),
b AS (SELECT l_orderkey AS doc_id, (l_partkey % 60)::INT AS s, (l_partkey % 60 + 6)::INT AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem),
kept AS (SELECT doc_id, list({'s': s, 'e': e}) AS ts, 0 AS k FROM a GROUP BY 1
  UNION ALL SELECT t.doc_id, CASE WHEN len(list_filter(ts, lambda h: b.s < h.e AND h.s < b.e)) > 0 THEN ts ELSE list_append(ts, {'s': b.s, 'e': b.e}) END, t.k + 1 FROM kept t JOIN b ON b.doc_id = t.doc_id AND b.k = t.k + 1)
SELECT doc_id, unnest(ts).s AS "start", unnest(ts).e AS "end" FROM (SELECT doc_id, arg_max(ts, k) AS ts FROM kept GROUP BY 1)""")
def merge_tags_greedy(spark, d):
    """The second list overlaps itself; of each order its lines in turn."""
    of = lambda start, end: T.tag(F.lit("x"), F.lit("x"), start, end, F.lit(1.0))
    line, size = F.col("l_linenumber") * 10, F.floor(F.col("l_quantity") / 10)
    first, at = of(line, line + size), F.col("l_partkey") % 60
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(first).alias("a"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", of(at, at + 6).alias("t")))).alias("b"))
    return g.select("doc_id", F.inline(T.merged(F.col("a"), F.transform("b", lambda x: x["t"])))).select("doc_id", "start", "end")


_RAW = ["ORG", "GPE", "TIME", "NORP", "CARDINAL", "LOC", "FAC", "PERSON", "MONEY"]


@register("spacy_tags", f"""SELECT o_orderkey, m.label FROM (SELECT o_orderkey, {_RAW}[o_orderkey % 9 + 1] AS raw FROM orders) JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in T.MODEL_LABELS.items())}) m(raw, label) USING (raw)""")
def spacy_tags(spark, d):
    """The label map of a model's tags; labels without a counterpart are dropped."""
    raw = F.get(F.array(*map(F.lit, _RAW)), (F.col("o_orderkey") % 9).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.canonical(raw).alias("label")).where("label IS NOT NULL")


def _gazetteer(spark, d):
    """Names: the first two words of every benchmark item."""
    two = F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1)
    return table(spark, d, "benchmark").select(two.alias("name"), F.when(F.col("item_id") % 2 == 0, "PERSON").otherwise("ORGANIZATION").alias("label"))


def _spanned(spark, d):
    """Whole texts with the spans of a stand-in model: long capitalised words, one in lower case, one that is not there."""
    words = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{4,}\b"), F.lit(0))), 1, 6)
    one = lambda w, k: F.struct(F.when(k % 2 == 0, "COURT").otherwise("LEGAL_CONCEPT").alias("label"), F.when(k == 1, F.upper(w)).otherwise(w).alias("text"), (F.lit(0.5) + k / 20).alias("score"))
    absent = F.array(F.struct(F.lit("COURT").alias("label"), F.concat(F.lit("No such "), F.col("doc_id").cast("string")).alias("text"), F.lit(0.9).alias("score")))
    return docs(spark, d).withColumn("spans", F.concat(F.coalesce(F.transform(words, one), F.array().cast("array<struct<label:string,text:string,score:double>>")), absent))


_EACH = ("label", "text", "start", "end", "score")


@register("name_mentions")
def name_mentions(spark, d):
    return T.mentions(docs(spark, d), _gazetteer(spark, d))


@register("resolve_span_tags")
def resolve_span_tags(spark, d):
    rows = _spanned(spark, d)
    return rows.select("doc_id", F.inline(T.resolved(F.col("text"), F.col("spans"))))


@register("tag_chunk")
def tag_chunk(spark, d):
    """Names, then the model's spans, then citations, as far as they are free, of every whole text."""
    rows = _spanned(spark, d)
    return T.tag_chunks(rows, T.mentions(rows, _gazetteer(spark, d))).select("doc_id", F.inline("tags"))


@register("ner_backfill")
def ner_backfill(spark, d):
    """Texts tagged by an older version, or never, are tagged anew; the others keep their tags."""
    rows = _spanned(spark, d).withColumn("ner_version", F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 4).cast("int")))
    old = rows.where("ner_version IS NULL OR ner_version < 3")
    new = T.tag_chunks(old, T.mentions(old, _gazetteer(spark, d))).select("doc_id", F.size("tags").alias("n_tags"), F.lit(3).alias("ner_version"))
    return rows.where("ner_version >= 3").select("doc_id", F.lit(0).alias("n_tags"), "ner_version").unionByName(new)


@register("embed_texts")
def embed_texts(spark, d):
    """A deterministic stand-in for a model: hash bytes scaled and normalised, built in the JVM."""
    h = F.md5("text")
    x = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return docs(spark, d).select("doc_id", x.alias("x")).select("doc_id", F.transform("x", lambda v: F.round(v / norm, 6)).alias("embedding"))
