"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one window). A document contains
a window only if it contains each of the window's shingles (``SHINGLE`` words), so one shingle a window is a sufficient
prefix; shingles are ordered by how often all documents have them, and the rarest is taken. A window with a shingle that
no document has is dropped. Candidates are bounded by position (the window must start and end inside the document) and
verified word by word on the text.

Plan: one pass finds where documents have benchmark shingles (the benchmark's distinct shingles are broadcast below
``BROADCAST_ROWS``, joined by shuffle above), their counts give the order, and a second pass verifies. Rows between the
passes are the hits only. Candidates carry a window's number and words; items are joined after verification, once for each
distinct set of windows that some document holds, so a window of very many items costs nothing a document. A hot shingle is never a prefix unless every shingle of its window is hot, and joins on it are
plain equi-joins that adaptive execution can split.

Defined cases: null or empty texts and items have no words; identical rows get identical results; an item whose id is
null makes words hit but is not counted; windows found in several items count for each; an empty benchmark hits nothing; an
empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.columns import let, text_of
from quillgraph.session import cut

WINDOW, SHINGLE = 10, 3
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """Words of digits, ASCII letters and anything beyond ASCII, with only A-Z lower-cased."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _shingles(ws: Column, size: int) -> Column:
    """Hashes of the shingles that start at each word."""
    n = F.size(ws) - (size - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(size), F.slice(ws, i, size)))


def _shingled(size: int) -> Callable[[Column], Column]:
    return lambda ws: _shingles(ws, size)


def _windows(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(distinct windows: wid, win (words joined by a space), ws, k; owners: wid, id of the items that have it)."""
    ws = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), plain_words(text_of(text)).alias("ws")).where(F.size("ws") > 0)
    k = F.least(F.lit(WINDOW), F.size("ws"))
    each = ws.select("id", "ws", k.alias("k"), F.explode(F.sequence(F.lit(1), F.size("ws") - k + 1)).alias("i")).select("id", F.slice("ws", F.col("i"), F.col("k")).alias("ws"), "k")
    each = each.withColumn("win", F.array_join("ws", " "))
    windows = cut(each.groupBy("win").agg(F.first("ws").alias("ws"), F.first("k").alias("k")).withColumn("wid", F.monotonically_increasing_id()))
    owners = cut(each.where("id IS NOT NULL").select("win", "id").distinct().join(windows.select("win", "wid"), "win").select("wid", "id"))
    return windows, owners


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row."""
    base = docs.select(F.col(f"`{key}`").alias("doc_id"), text_of(text).alias("text"))
    base = base.withColumn("row", F.xxhash64("doc_id", "text"))
    windows, owners = _windows(items, item_id, item_text)
    sizes = sorted({min(SHINGLE, r.k) for r in windows.select("k").distinct().collect()})  # at most WINDOW values
    grams = None
    for s in sizes:
        part = windows.where(F.least("k", F.lit(SHINGLE)) == s).select("wid", "k", F.posexplode(_shingles(F.col("ws"), s)).alias("off", "h"))
        grams = part if grams is None else grams.unionByName(part)
    if grams is None:
        found = base.select("doc_id", F.size(plain_words(F.col("text"))).cast("long").alias("n_words"), F.lit(None).cast("array<struct<s:int,k:int,wid:bigint>>").alias("ok"))
        return _report(found, owners)

    known = grams.select("h").distinct()
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    hits = None
    for s in sizes:
        part = base.select("doc_id", "row", F.posexplode(let(plain_words(F.col("text")), _shingled(s))).alias("pos", "h"))
        hits = part if hits is None else hits.unionByName(part)
    hits = cut(hits.join(known, "h", "left_semi"))

    often = hits.groupBy("h").agg(F.count("*").alias("n"))
    ranked = grams.join(often, "h", "left").groupBy("wid", "k").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min(F.struct(F.coalesce("n", F.lit(0)), "h", "off")).alias("rarest")
    )
    prefix = ranked.where("least > 0").select("wid", "k", "rarest.h", "rarest.off").join(windows.select("wid", "win"), "wid")
    start = F.col("pos") - F.col("off") + 1
    cands = hits.join(prefix, "h").where(start >= 1).select("doc_id", "row", F.struct(start.alias("s"), "k", "win", "wid").alias("c"))
    by_doc = cands.groupBy("doc_id", "row").agg(F.collect_set("c").alias("cs"))
    by_doc = by_doc.select(F.col("doc_id").alias("id_"), F.col("row").alias("row_"), "cs")
    both = base.join(by_doc, F.col("row").eqNullSafe(F.col("row_")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left").select("doc_id", "text", "cs")

    def verified(ws: Column) -> Column:
        fits = lambda c: (c["s"] + c["k"] - 1 <= F.size(ws)) & (F.array_join(F.slice(ws, c["s"], c["k"]), " ") == c["win"])
        ok = F.transform(F.filter("cs", fits), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["wid"].alias("wid")))
        return F.struct(F.size(ws).cast("long").alias("n_words"), ok.alias("ok"))

    found = both.select("doc_id", let(plain_words(F.col("text")), verified).alias("v")).select("doc_id", "v.n_words", "v.ok")
    return _report(found, owners)


def _report(found: DataFrame, owners: DataFrame) -> DataFrame:
    covered = F.array_distinct(F.flatten(F.transform("ok", lambda c: F.sequence(c["s"], c["s"] + c["k"] - 1))))
    none = F.array().cast("array<bigint>")
    held = found.select("doc_id", "n_words", F.coalesce(F.size(F.when(F.col("ok").isNotNull(), covered)), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.array_sort(F.array_distinct(F.transform("ok", lambda c: c["wid"]))), none).alias("wids"))
    held = cut(held.withColumn("n_hit", F.greatest("n_hit", F.lit(0))))
    sets = held.where(F.size("wids") > 0).select("wids").distinct()
    ids = sets.select("wids", F.explode("wids").alias("wid")).join(owners, "wid").groupBy("wids").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    digest = cut(ids.select("wids", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("sha")))
    return held.join(digest, "wids", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH it AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
wi AS (
  SELECT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM it WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
dw AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (
  SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM wi) ks WHERE len(ws) >= k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, wi.item_id FROM dw JOIN wi ON wi.win = dw.win AND wi.k = dw.k),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(q.n_items, 0)::BIGINT AS n_items,
       coalesce(q.h, sha256('')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id
"""
