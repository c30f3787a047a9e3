"""Ranked lexical search over inverted treaps.

Documents are dealt into shards by the number of their postings. In a shard each query term has a treap: its documents in
search order of their ids, their impacts in heap order. A query walks the treaps of its terms together. A state is a range of
documents and, for each term, the root of the subtree of that range; the sum of the roots' impacts bounds every score in the
range. The states of the greatest bounds go first: of each, the root of the greatest share is scored in full and splits the
range in two. A range whose bound is below the k-th best score so far is never entered. ``STEP`` states move at a time, as
arrays. The shards' best are ranked together, each task keeping k rows a query before they are exchanged.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with only A-Z lower-cased. Its weight w is
floor(1000 * ln((2 * N + 2) / (2 * df + 1))); a document's score is the sum of w * ((10**9 * tf) div (1000 * tf + 12 * m)) over
the query's terms, repeats included, with m = 75 + (25 * n * N) div L.

Texts are read once, by one scan that keeps the postings of the queries' terms. Queries are taken in blocks of ``TERMS`` terms;
what the driver and every task hold is one block's terms and their document counts.

Defined cases: a null text has no term, and a document without one doesn't count in N; a query without terms, or whose terms
no document holds, has no rows; each row of the queries is a query of its own, so repeated items repeat their results;
repeated documents are ranked each for itself; equal scores go by ascending id, null ids last; an empty table on either side
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.columns import text_of
from quillgraph.session import cut

K, TERMS, POSTINGS, STEP = 20, 200_000, 1_000_000, 1024
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: str) -> list[bytes]:
    """The terms of a text, in UTF-8 (whose lower() is that of ASCII)."""
    return _TERM.findall(text.encode().lower())


def term_column(text: Column) -> Column:
    """``terms`` as a column."""
    return F.regexp_extract_all(F.translate(text_of(text), _UPPER, _LOWER), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0))


class Treaps:
    """The treaps of all terms of one shard, over documents 0 to ``n`` - 1 in id order.

    ``starts`` has the first posting of each document; ``term`` and ``impact`` are the postings by document. Nodes are the same
    postings by term and document. ``left`` and ``right`` are their children, -1 where there is none, ``root`` the root of each term.
    """

    def __init__(self, starts: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        self.starts, self.term, self.impact = starts, term, impact
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        by_term = np.argsort(term, kind="stable")
        self.doc, self.most = owner[by_term].astype(np.int32), impact[by_term]
        # equal impacts in an order drawn by hash, so that they make no chains
        drawn = by_term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((drawn ^ drawn >> np.uint64(31), self.most))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        bounds = np.searchsorted(term[by_term], np.arange(n_terms + 1))
        left, right, root = [-1] * len(rank), [-1] * len(rank), [-1] * n_terms
        ranks = rank.tolist()
        for t, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            spine: list[int] = []  # the right spine of the treap so far
            for v in range(lo, hi):
                r, last = ranks[v], -1
                while spine and ranks[spine[-1]] < r:
                    last = spine.pop()
                left[v] = last
                if spine:
                    right[spine[-1]] = v
                spine.append(v)
            if spine:
                root[t] = spine[0]
        self.left, self.right, self.root = np.array(left, np.int32), np.array(right, np.int32), np.array(root, np.int32)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Full scores of documents; ``weight``: how often the query has each term."""
        begin, size = self.starts[docs], self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begin - ends + size, size)
        return np.add.reduceat(self.impact[at] * weight[self.term[at]], ends - size)

    def _inside(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """``node`` moved down (states x terms) to the root of its subtree's part in [lo, hi)."""
        flat, cols = node.ravel(), node.shape[1]
        at = np.flatnonzero(flat >= 0)
        while len(at):
            v, s = flat[at], at // cols
            d = self.doc[v]
            low = d < lo[s]
            out = low | (d >= hi[s])
            at, v, low = at[out], v[out], low[out]
            flat[at] = np.where(low, self.right[v], self.left[v])
            at = at[flat[at] >= 0]
        return flat.reshape(node.shape)

    def top(self, query: dict[int, int], k: int) -> list[tuple[int, int]]:
        """The k best (score, document) of a query (term -> repeats), scores above 0, equal ones by ascending document."""
        known = [t for t in query if self.root[t] >= 0]
        if not known:
            return []
        weight = np.zeros(len(self.root), np.int64)
        weight[known] = [query[t] for t in known]
        own = weight[known]
        best: list[tuple[int, int]] = []  # (score, -document), a heap
        step = max(1, min(STEP, 4_000_000 // len(known)))
        # states as arrays; roots of a range always lie inside it
        lo, hi = np.zeros(1, np.int64), np.full(1, len(self.starts) - 1, np.int64)
        node = self.root[known][None, :]
        share = np.where(node >= 0, self.most[node], 0) * own
        bound = share.sum(1)
        while len(bound):
            if len(best) == k:
                # an equal score counts only with a smaller document than the k-th best
                worst, last = best[0][0], -best[0][1]
                keep = (bound > worst) | (bound == worst) & (lo < last)
                lo, hi, node, bound = lo[keep], hi[keep], node[keep], bound[keep]
            keep = bound > 0
            if not keep.all():
                lo, hi, node, bound = lo[keep], hi[keep], node[keep], bound[keep]
            if not len(bound):
                break
            m = min(step, len(bound)) if len(best) == k else min(4 * k, len(bound))
            first = np.argpartition(-bound, m - 1)[:m]
            rest = np.ones(len(bound), bool)
            rest[first] = False
            l1, h1, n1 = lo[first], hi[first], node[first]
            share = np.where(n1 >= 0, self.most[n1], 0) * own
            pivot = self.doc[n1[np.arange(m), share.argmax(1)]].astype(np.int64)
            score = self.scores(pivot, weight)
            if len(best) == k:
                good = np.flatnonzero(score >= best[0][0])
            else:
                good = np.flatnonzero(score > 0)
            for s, d in sorted(zip(score[good].tolist(), (-pivot[good]).tolist(), strict=True), reverse=True):
                if len(best) < k:
                    heapq.heappush(best, (s, d))
                elif (s, d) > best[0]:
                    heapq.heapreplace(best, (s, d))
                else:
                    break
            l2, h2 = np.concatenate([l1, pivot + 1]), np.concatenate([pivot, h1])
            n2 = np.concatenate([n1, n1])
            some = l2 < h2
            l2, h2 = l2[some], h2[some]
            n2 = self._inside(n2[some], l2, h2)
            b2 = (np.where(n2 >= 0, self.most[n2], 0) * own).sum(1)
            lo, hi, node, bound = np.concatenate([lo[rest], l2]), np.concatenate([hi[rest], h2]), np.concatenate([node[rest], n2]), np.concatenate([bound[rest], b2])
        return [(s, -d) for s, d in sorted(best, reverse=True)]


def _postings(number: dict[bytes, int]):
    """Documents -> (doc_id, n, terms, tfs) with the known terms of each, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for b in batches:
            size, own, often = [], [], []
            for t in b.column(1):
                count = Counter(terms(t.as_py()))
                size.append(count.total())
                known = sorted((v, c) for w, c in count.items() if (v := get(w)) is not None)
                own.append([v for v, _ in known])
                often.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return run


def _shard(queries: list[tuple[int, dict[int, int]]], weights: np.ndarray, docs: int, length: int, k: int):
    """The rows of one shard -> its k best documents (q, doc_id, score) of each query."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
        held, often = (t.column(c).chunk(0) if t.column(c).num_chunks else pa.array([], t.schema.field(c).type) for c in ("terms", "tfs"))
        size = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term, tf = held.flatten().to_numpy().astype(np.int64), often.flatten().to_numpy().astype(np.int64)
        n = t.column("n").to_numpy()
        m = np.array([100 - 25 + (25 * x * docs) // length for x in n.tolist()], np.int64)
        impact = weights[term] * ((10**9 * tf) // (1000 * tf + 12 * np.repeat(m, size)))
        treaps = Treaps(np.append(0, np.cumsum(size)), term, impact, len(weights))
        q, at, score = [], [], []
        for number, query in queries:
            for s, d in treaps.top(query, k):
                q.append(number)
                at.append(d)
                score.append(s)
        ids = t.column("doc_id").take(pa.array(at, pa.int64()))
        return pa.table({"q": pa.array(q, pa.int64()), "doc_id": ids, "score": pa.array(score, pa.int64())})

    return run


def _block(docs: DataFrame, block: list, k: int) -> DataFrame | None:
    """q, doc_id, score: the best of each shard for the queries (q, terms) of one block."""
    number = {w: v for v, w in enumerate(sorted({w.encode() for r in block for w in r.terms}))}
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = cut(docs.mapInArrow(_postings(number), f"doc_id {kind}, n long, terms array<int>, tfs array<int>").withColumn("row", F.monotonically_increasing_id()))
    n, length, postings = held.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("terms"))).first()
    if not postings:
        return None
    df = np.zeros(len(number), np.int64)
    for v, c in held.select(F.explode("terms").alias("v")).groupBy("v").count().collect():  # at most a row a term of the block
        df[v] = c
    weights = np.array([int(np.floor(1000 * np.log((2 * n + 2) / (2 * c + 1)))) for c in df.tolist()], np.int64)
    queries = [(r.q, dict(Counter(number[w.encode()] for w in r.terms))) for r in block]
    shards = -(-postings // POSTINGS)
    found = held.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return found.groupBy("shard").applyInArrow(_shard(queries, weights, n, length, k), f"q long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of ``items``."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    asked = cut(items.select(F.col(f"`{item_id}`").alias("item_id"), term_column(F.col(f"`{item_text}`")).alias("terms")).withColumn("q", F.monotonically_increasing_id()))
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS)
    parts = []
    for b in range(blocks):
        block = asked.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).select("q", "terms").collect()  # about TERMS terms
        part = _block(rows, block, k) if block else None
        if part is not None:
            parts.append(part)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"q long, doc_id {kind}, score long")
    for part in parts:
        found = found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM documents WHERE text IS NOT NULL),
dn AS (SELECT doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
st AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM dn),
it AS (SELECT item_id, term, count(*)::BIGINT AS often FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark) GROUP BY ALL),
po AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM dn) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
we AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM po GROUP BY term), st),
im AS (SELECT doc_id, po.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))) AS impact FROM po JOIN we USING (term), st),
sc AS (SELECT item_id, doc_id, sum(often * impact)::BIGINT AS score FROM it JOIN im USING (term) GROUP BY ALL),
ra AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ra WHERE rank <= 20
"""
