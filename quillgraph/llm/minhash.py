"""Near-duplicate classes by order MinHash with banded verification.

A text is its lower-cased words (a character of a script without spaces is a word); its items are the ``K``-word shingles,
each labelled with its occurrence number, so repeats count. One of ``SKETCHES`` sketches keeps the ``PICK`` items with the
least hashes *in text order*: two texts agree on a sketch with a probability that follows their edit similarity, not only
their sets. Texts that agree form a bucket. Bucket members are first compared with a hub of the bucket: the member of least
number, then, where a bucket still holds several components, one drawn by hash. Where a bucket is of several components even
then, all its members are compared with those outside its largest component, in blocks of at most ``BLOCK`` x ``BLOCK`` members
and about ``BYTES`` of text on each side, each pair in the least bucket that it shares: first by length and by item counts in
``BINS`` bins, which bound the alignment from above, then the nearest first by alignment, until their components meet. A pair
counts if its alignment, the longest chain of equal items within the band that ``SIMILAR`` leaves, reaches ``SIMILAR`` of all
items (common / (a + b - common)). Linked texts form components; no two texts that share a bucket and are similar end in
different ones. The block step's pairs grow with the square of a family of texts that are nearly, but not, similar.

With 24 sketches of 4 items a pair of long texts at similarity 0.8 shares no bucket with probability 3e-6, one of 14 items with
2e-5. Two texts of up to ``SHORT`` items share one for sure: their keys are also the hashes of what is left after deleting any
one item, or any two, which are all the differences that 0.8 leaves to texts of that size. Same words mean same class without
any comparison: copies, whatever their ids, are folded into one node before anything is exchanged, and only one text of a node
is ever read again. Rows are told apart by 128-bit hashes of id and text, nodes are numbered.

Defined cases: a text without words (null, empty) is a class of its own; texts under ``K`` words have the whole text as
the one item; repeated rows share their class; several texts under one id are classed each for itself; a null id takes part
as any other and is the class id only of a class without ids; an empty table gives an empty one; only the two named columns
are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.columns import row_key
from quillgraph.llm.components import components, extended
from quillgraph.session import cut, steps, written

K, SIMILAR, SKETCHES, PICK, SEED = 5, 0.8, 24, 4, 11
BLOCK, BYTES, BINS = 2048, 16_000_000, 512
#: Texts of up to SHORT items have exact keys; those of up to ALONE have no partner of more than SHORT, and no sketches.
SHORT, ALONE = 13, 10
#: Kana, ideographs, Hangul, Thai, Lao, Khmer and Burmese are written without spaces: a word a character.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U000323af"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(SEED)
_MULT = _rng.integers(1, 2**63, SKETCHES, np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, SKETCHES, np.uint64)


def _word_hash(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Items:
    """Turns texts into labelled shingle hashes; remembers word hashes up to a bound."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > 500_000:
            self.seen = {}
        seen = self.seen
        for w in [w for w in set(words) if w not in seen]:
            seen[w] = _word_hash(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        n = max(len(h) - K + 1, 1)
        x = np.zeros(n, np.uint64)
        for j in range(min(K, len(h))):
            x = (x ^ h[j : j + n]) * _MIX
            x ^= x >> np.uint64(29)
        # the occurrence number of equal shingles, in text order
        order = np.argsort(x, kind="stable")
        s = x[order]
        fresh = np.append(True, s[1:] != s[:-1])
        if not fresh.all():
            at = np.arange(n)
            label = np.empty(n, np.uint64)
            label[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
            x = x ^ label * np.uint64(0xD6E8FEB86659FD93)
        return x


def sketch(x: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of PICK least items in text order."""
    out, n = np.zeros(SKETCHES, np.uint64), len(x)
    step = max(1, min(SKETCHES, 2_000_000 // n))
    for lo in range(0, SKETCHES, step):
        hi = min(SKETCHES, lo + step)
        h = x[None, :] * _MULT[lo:hi, None] + _ADD[lo:hi, None]
        h ^= h >> np.uint64(32)
        h *= _MIX
        at = np.sort(np.argpartition(h, PICK - 1, 1)[:, :PICK], 1) if n > PICK else np.broadcast_to(np.arange(n), (hi - lo, n))
        v = np.arange(lo, hi, dtype=np.uint64)
        for j in range(at.shape[1]):
            v = (v ^ x[at[:, j]]) * _MIX
            v ^= v >> np.uint64(31)
        out[lo:hi] = v
    return out


def deletions(x: np.ndarray) -> np.ndarray:
    """Hashes of a short text's items without none, one or two of them, as far as a similar text of that size may lack them.

    Similar texts of a and b items differ in (a + b) / 9 items at most.
    """
    n = len(x)

    def folded(keep: np.ndarray) -> np.ndarray:
        v = np.full(keep.shape[0], 0x5BD1E995, np.uint64)
        for j in range(keep.shape[1]):
            v = (v ^ x[keep[:, j]]) * _MIX
            v ^= v >> np.uint64(31)
        return v

    out = [folded(np.arange(n)[None])]
    if n >= 5:
        out.append(folded(np.array([[k for k in range(n) if k != i] for i in range(n)])))
    if n >= 10:
        out.append(folded(np.array([[k for k in range(n) if k not in (i, j)] for i in range(n) for j in range(i)])))
    return np.unique(np.concatenate(out))


def keys(x: np.ndarray) -> np.ndarray:
    """The buckets of a text's items."""
    return np.concatenate([*([deletions(x)] if len(x) <= SHORT else []), *([sketch(x)] if len(x) > ALONE else [])])


def bins(x: np.ndarray) -> bytes:
    """Items by ``BINS`` ranges of their hashes, counted up to 255."""
    return np.minimum(np.bincount((x * _MIX >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """common / (a + b - common) of the longest in-band chain of items equal in both; 0 if below SIMILAR for sure."""
    least = SIMILAR * (len(a) + len(b)) / (1 + SIMILAR)
    if min(len(a), len(b)) < least - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = len(a) + len(b) - 2 * least  # no chain long enough leaves it
    near = np.abs(i - j) <= band + 1e-9
    i, j = i[near], j[near]
    if len(i) < least - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        common = len(j)
    else:
        ends: list[int] = []
        for v in j.tolist():
            at = bisect_left(ends, v)
            ends[at : at + 1] = [v]
        common = len(ends)
    return common / (len(a) + len(b) - common)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items = Items()
    for b in batches:
        sig, rows, size, hist, weight = [], [], [], [], []
        for t in b.column(2):
            said = t.as_py() or ""
            words = _WORD.findall(said.lower())
            weight.append(len(said))
            sig.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest() if words else None)
            x = items.of(words) if words else np.zeros(0, np.uint64)
            rows.append(keys(x).view(np.int64) if words else np.zeros(0, np.int64))
            size.append(len(x))
            hist.append(bins(x))
        offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
        values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(values)), pa.array(size, pa.int32()), pa.array(weight, pa.int32()), pa.array(hist, pa.binary())], names=["doc_id", "row", "sig", "keys", "size", "bytes", "hist"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) -> the pairs that hold. A hub's items are kept while its pairs follow each other."""
    items, held_id, held = Items(), None, np.zeros(0, np.uint64)
    of = lambda t: items.of(_WORD.findall((t.as_py() or "").lower()))
    for b in batches:
        keep = []
        for k in range(b.num_rows):
            hub = b.column(1)[k].as_py()
            if hub != held_id:
                held_id, held = hub, of(b.column(3)[k])
            keep.append(aligned(of(b.column(2)[k]), held) >= SIMILAR - 1e-12)
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar; ``texts`` has one row a node."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verify, "a long, b long")


def _compare(t: pa.Table) -> pa.Table:
    """Members of one block pair of a bucket -> links (a, b) between members of different components, one at most for two."""
    bucket, i, j = (t.column(c)[0].as_py() for c in ("bucket", "i", "j"))
    label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    size, part = t.column("size").to_numpy().astype(np.float64), t.column("part").to_numpy()
    hist = np.frombuffer(b"".join(t.column("hist").to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
    shares, found = [frozenset(x) for x in t.column("shares").to_pylist()], []
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    for k, v in enumerate(left.tolist()):
        w = right if i < j else right[k + 1 :]
        w = w[(label[w] != label[v]) & (np.minimum(size[w], size[v]) >= SIMILAR * np.maximum(size[w], size[v]) - 1e-9)]
        # each bin's difference is made of items without a partner, of which (a + b) (1 - s) / (1 + s) are left at most
        far = np.abs(hist[w] - hist[v]).sum(1, dtype=np.int64)
        ok = far <= (size[w] + size[v]) * (1 - SIMILAR) / (1 + SIMILAR) + 1e-9
        w, far = w[ok], far[ok]
        found.append(np.stack([np.full(len(w), v), w, far]))
    a, b, far = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    order = np.argsort(far, kind="stable")
    items, held, top, keep, text = Items(), {}, list(range(len(label))), [], t.column("text")

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    def of(v: int) -> np.ndarray:
        if v not in held:
            held[v] = items.of(_WORD.findall((text[v].as_py() or "").lower()))
        return held[v]

    for v, w in zip(a[order].tolist(), b[order].tolist(), strict=True):
        p, q = find(label[v]), find(label[w])
        if p != q and min(shares[v] & shares[w]) == bucket and aligned(of(v), of(w)) >= SIMILAR - 1e-12:
            top[p] = q
            keep.append((v, w))
    ends = np.array(keep, np.int64).reshape(-1, 2)
    ids = t.column("node")
    return pa.table({"a": ids.take(pa.array(ends[:, 0])), "b": ids.take(pa.array(ends[:, 1]))})


def _rest(member: DataFrame, label: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels after the links between members of one bucket that are no hubs and of different components."""
    open_ = member.where("n > 3 OR (n > 2 AND least = drawn)").where("node <> least AND node <> drawn").select("node", "bucket")
    open_ = open_.join(label.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = open_.join(own.select("node", F.col("bytes")), "node")
    sizes = open_.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.sum("bytes").alias("w")).groupBy("bucket").agg(F.sum("m").alias("all"), F.sum("w").alias("bytes"), F.max(F.struct("m", "label", "w")).alias("main"))
    parts = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BYTES), F.lit(1)).cast("int")
    several = sizes.where("main.m < all").select(
        "bucket", F.col("main.label").alias("main"), parts(F.col("main.m"), F.col("main.w")).alias("mains"), parts(F.col("all") - F.col("main.m"), F.col("bytes") - F.col("main.w")).alias("others")
    )
    open_ = written(open_.drop("bytes").join(several, "bucket"))
    known = open_.groupBy("node").agg(F.collect_list("bucket").alias("shares")).join(own.select("node", "size", "hist"), "node").join(texts, "node")
    is_main, h = F.col("label") == F.col("main"), F.xxhash64("node", F.lit(SEED))
    part = F.when(is_main, F.pmod(h, F.col("mains"))).otherwise(F.pmod(h, F.col("others"))).cast("int")
    upto = lambda c, body: F.transform(F.sequence(F.lit(0), F.col(c) - 1), body)
    at = lambda i, j, mine: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), mine.cast("long").alias("part"))
    p = F.col("part")
    # block pairs: (i, j) of those outside the main component, (-1 - i, j) of them and the main one
    among = upto("others", lambda x: at(F.least(p, x), F.greatest(p, x), p))
    across = F.when(is_main, upto("others", lambda x: at(-1 - x, p, p))).otherwise(F.concat(among, upto("mains", lambda x: at(-1 - p, x, -1 - p))))
    dealt = open_.withColumn("part", part).select("node", "bucket", "label", F.explode(across).alias("at")).select("node", "bucket", "label", "at.*").join(known, "node")
    found = written(dealt.groupBy("bucket", "i", "j").applyInArrow(_compare, "a long, b long"))
    return extended(label, found)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (``row_key`` of id and text), class_id (the least id of the class) and keeper (the row key of the class's one text to keep) of each row."""
    with steps(docs.sparkSession):
        texts = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).select("doc_id", row_key("doc_id", "text").alias("row"), "text")
        kind = texts.schema["doc_id"].dataType.simpleString()
        rows = cut(texts.mapInArrow(_sketches, f"doc_id {kind}, row binary, sig binary, keys array<long>, size int, bytes int, hist binary"))
        # written out, so that the joins below have plain exchanges on both sides and a hot group of copies can be split
        best = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row")).alias("best")
        # one number a distinct text, and one of its rows to read it by
        reps = cut(rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("row").alias("row"), best).withColumn("node", F.monotonically_increasing_id()))
        named = cut(rows.select("doc_id", "row", "sig").join(reps.select("sig", "node"), "sig", "left").select("doc_id", "row", "node"))
        by_row = reps.select("row", "node")
        own = cut(rows.select("row", "keys", "size", "bytes", "hist").join(by_row, "row").dropDuplicates(["node"]).select("node", "keys", "size", "bytes", "hist"))
        keys = own.select("node", F.explode("keys").alias("bucket")).distinct()
        hubs = keys.groupBy("bucket").agg(F.min("node").alias("least"), F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node")).alias("drawn"), F.max("node").alias("most"), F.count("*").alias("n"))
        shared = hubs.where("least < most").select("bucket", "least", F.col("drawn.node").alias("drawn"), "n")
        member = cut(keys.join(shared, "bucket").select("node", "bucket", "least", "drawn", "n"))
        wanted = by_row.join(member.select("node").distinct(), "node", "left_semi")
        held = cut(texts.select("row", "text").join(wanted, "row").select("node", "text").dropDuplicates(["node"]))

        first = member.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
        links = cut(_checked(first, held))
        label = components(links)
        second = (
            member.where("node <> drawn AND drawn <> least").select(F.col("node").alias("a"), F.col("drawn").alias("b")).distinct()
            .join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
            .join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
            .where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")
        )
        more = cut(_checked(second, held))
        label = _rest(member, extended(label, more), own, held)
        of = reps.select("node", "best").join(label, "node", "left").select("node", "best", F.coalesce("label", "node").alias("label"))
        least = cut(of.join(of.groupBy("label").agg(F.min("best").alias("least")), "label").select("node", "least"))
        ids = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
        return named.join(least, "node", "left").select("doc_id", "row", ids.alias("class_id"), F.coalesce("least.row", "row").alias("keeper"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id (the least id of the class) of each row."""
    return classes(docs, key, text).select("doc_id", "class_id")
