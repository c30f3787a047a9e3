"""Removal of repeated byte strings by prefix-free parsing: dictionary order and parse order combine into corpus order.

A byte is removed if a string of ``SPAN`` bytes that covers it also starts anywhere else in the corpus.

*Parse.* A string's trigger is the place with the least rolling hash among its first ``REACH``: a rule on the string's own
bytes that never leaves a stretch without one. The starts with one trigger are consecutive; their strings together are a
phrase. Equal strings have their trigger at one offset and share the ``KEY`` bytes from it on.

*Dictionary.* Phrases are named by 128 bits. A phrase met twice is repeated in all its starts and only one occurrence goes
on. Keys with a single phrase end here. Rows are combined in the tasks that parse: copies are settled there, and of a key
with many phrases only two rows meet, as its phrases are known to go on; the others are dealt by phrase. So neither a hot
text nor a hot passage gathers in one task.

*Orders.* A phrase is what stands right of its trigger and, read backwards, what stands left of it. Phrases are put in byte
order twice, by range partitioning on the bytes themselves: in parse order (right, then left), the sparse suffix array of
the corpus at its triggers, and in dictionary order (key, left, then right). Neighbours give the longest common part r to
the right and l to the left; a string that starts d bytes before the trigger is shared with a neighbour if r >= ``SPAN`` - d
and l >= d. Starts that no neighbour settles, though some phrase shares their right part and some phrase their left part,
are put in corpus order themselves, all ``SPAN`` bytes, and so are settled ones beside a phrase that shares their right part
but not the string: of equal strings that others part in both orders, each run in parse order is there. Only bytes decide in
these steps. Sorts are read as streams that remember one row; two rows a partition are collected, so that neighbours meet
across partitions.

Defined cases: a null or empty text has 0 bytes and the hash of nothing; texts under ``SPAN`` bytes keep all; repeated rows
are copies of each other; null keys are kept; matches never cross texts; each row gives one row; an empty table gives an
empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut, shuffles_dropped

SPAN, REACH, KEY, TRIGGER = 200, 120, 80, 16
PIECE = 1 << 20
#: Phrases of one combined window; phrases of a key in a window from which on it is dealt by phrase; deals.
WINDOW, HOT, DEALS = 250_000, 16, 255
_U = np.uint64
_rng = np.random.default_rng(41)
_TABLE = _rng.integers(1, 2**63, (2, 256), np.uint64) << _U(1) | _U(1)
_BASE = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_BACK = tuple(_U(pow(int(b), -1, 2**64)) for b in _BASE)
PLAIN, TWICE, SETTLED = 0, 1, 2


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.append(_U(1), np.full(n, base, np.uint64)), dtype=np.uint64)


_UP = tuple(_powers(b, PIECE + 4 * SPAN) for b in _BASE)
_DOWN = tuple(_powers(b, PIECE + 4 * SPAN) for b in _BACK)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return x ^ x >> _U(29)


class Sums:
    """Hashes of any strings of one piece of text, from prefix sums."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        self.s = [np.append(_U(0), np.cumsum(_TABLE[k][raw] * _DOWN[k][:n], dtype=np.uint64)) for k in (0, 1)]

    def of(self, k: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.s[k][hi] - self.s[k][lo]) * _UP[k][lo])


def _pieces(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of pieces whose starts of strings cover the text's, each once."""
    for lo in range(0, max(len(raw) - SPAN + 1, 0), PIECE):
        yield lo, raw[lo : lo + PIECE + SPAN - 1]


def pack(first: np.ndarray, n: np.ndarray, back: np.ndarray | int = 0) -> np.ndarray:
    """A place: first start, distance of the trigger from it, number of consecutive starts."""
    return first.astype(np.int64) << 16 | np.asarray(back).astype(np.int64) << 8 | n.astype(np.int64)


def parse(raw: np.ndarray) -> list[np.ndarray]:
    """key, name (two columns) and place of a text's phrases."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for off, p in _pieces(raw):
        sums, n = Sums(p), len(p) - SPAN + 1
        at = np.arange(n + REACH - 1)
        least = (sums.of(0, at, at + TRIGGER) >> _U(32) << _U(32)) | at.astype(np.uint64)
        size = 1
        while size * 2 <= REACH:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[REACH - size : REACH - size + n])
        trigger = (least & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
        last, t = np.append(first[1:], n) - 1, trigger[first]
        shape = ((t - first) << 8 | last - first).astype(np.uint64)
        ours = sums.of(0, t, t + KEY), *(_mix(sums.of(k, first, last + SPAN) + shape) for k in (0, 1)), pack(off + first, last - first + 1, t - first)
        for o, f in zip(out, ours, strict=True):
            o.append(f)
    return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def _raw(value: pa.Scalar) -> np.ndarray:
    b = value.as_buffer()
    return np.frombuffer(b, np.uint8) if b is not None and len(b) else np.zeros(0, np.uint8)


def _batch(**cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols.values()], names=list(cols))


def _fresh(*cols: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))


def combined(key, n1, n2, place, r1, r2) -> pa.RecordBatch:
    """A window of phrases, with copies settled and hot keys dealt; see the module."""
    order = np.lexsort((n2, n1, key))
    key, n1, n2, place, r1, r2 = (c[order] for c in (key, n1, n2, place, r1, r2))
    name = _fresh(key, n1, n2)
    flag = np.where(~name, SETTLED, np.where(np.append(~name[1:], False), TWICE, PLAIN))
    # number of distinct phrases of a row's key, and the row's among them
    new_key, nth = _fresh(key), np.cumsum(name)
    begin = np.flatnonzero(new_key)
    of = np.cumsum(new_key) - 1
    phrases = np.append(nth[begin[1:]] - 1, nth[-1])[of] - nth[begin][of] + 1
    deal = np.where((phrases > HOT) & (nth - nth[begin][of] >= 2), 1 + (n1 % _U(DEALS)).astype(np.int64), 0)
    done = flag == SETTLED  # only passes through, so it may go anywhere
    key = np.where(done, _mix(r1.view(np.uint64) + place.view(np.uint64)), key)
    n1, n2, deal = np.where(done, _U(0), n1), np.where(done, _U(0), n2), np.where(done, -1, deal)
    return _batch(key=key, deal=deal.astype(np.int16), n1=n1, n2=n2, flag=flag.astype(np.int8), place=place, r1=r1, r2=r2)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        r1, r2, col = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.binary())
        for k, v in enumerate(col):
            found = parse(_raw(v))
            n = len(found[0])
            if n:
                held.append([*found, np.full(n, r1[k]), np.full(n, r2[k])])
                size += n
            if size > WINDOW:
                yield combined(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield combined(*map(np.concatenate, zip(*held, strict=True)))


def _stream(batches: Iterator[pa.RecordBatch], before: pa.Table | None = None, after: pa.Table | None = None) -> Iterator[tuple[pa.Table, int, int]]:
    """(table, lo, hi): rows lo to hi are due, with the rows beside them in the table unless none exist."""
    held, done = before, 0 if before is None else 1
    for b in batches:
        if not b.num_rows:
            continue
        if done and held is before:
            held = before.cast(b.schema)
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        n = held.num_rows
        if n - done > 1:
            yield held, done, n - 1
            held, done = held.slice(n - 2), 1
    if held is not None and held.num_rows > done:
        yield held if after is None else pa.concat_tables([held, after.cast(held.schema)]), done, held.num_rows


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, deal, name) -> places of phrases met twice, and (again false) the dictionary."""
    alone = True  # the phrase before is the first of its key
    for t, lo, hi in _stream(batches):
        key, deal, n1, n2, flag, place, r1, r2 = (t.column(c).to_numpy() for c in ("key", "deal", "n1", "n2", "flag", "place", "r1", "r2"))
        new_key, name = _fresh(key, deal), _fresh(key, deal, n1, n2)
        if lo:
            new_key[0] = False
        begun = np.maximum.accumulate(np.where(name, np.arange(len(key)), 0))
        first = np.where(new_key[begun] | ((begun == 0) & (lo > 0) & alone), True, False)
        next_key, next_name = np.append(~new_key[1:], False), np.append(~name[1:], False)
        before = ~name
        before[0] = False  # row 0 is due only where nothing is before it
        twice = (before | next_name | (flag > PLAIN))[lo:hi]
        entry = (~next_name & (deal >= 0) & ((deal > 0) | ~first | next_key))[lo:hi]
        alone = bool(first[hi - 1])
        pick = lambda c: np.append(c[lo:hi][twice], c[lo:hi][entry])  # noqa: B023, E731
        yield _batch(place=pick(place), r1=pick(r1), r2=pick(r2), again=np.append(np.ones(twice.sum(), bool), np.zeros(entry.sum(), bool)))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r1, r2, text, places of phrases) -> what stands right and, backwards, left of the phrases' triggers."""
    for b in batches:
        col = b.column(2).cast(pa.binary())
        right, left, place, at = [], [], [], []
        for k, (v, places) in enumerate(zip(col, b.column(3).to_pylist(), strict=True)):
            raw = bytes(v.as_buffer())
            for p in places:
                first, back, n = p >> 16, p >> 8 & 255, p & 255
                right.append(raw[first + back : first + n - 1 + SPAN])
                left.append(raw[first : first + back][::-1])
            place += places
            at += [k] * len(places)
            if len(place) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(place, pa.int64()), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["right", "left", "place", "r1", "r2"])
                right, left, place, at = [], [], [], []
        if place:
            yield pa.RecordBatch.from_arrays([pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(place, pa.int64()), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["right", "left", "place", "r1", "r2"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of a sorted partition."""
    first = last = None
    for b in batches:
        if b.num_rows:
            first, last = first or b.slice(0, 1), b.slice(b.num_rows - 1)
    for end, row in enumerate((first, last)):
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([end], pa.int32()), *row.columns], names=["part_", "end_", *row.schema.names])


def _common(a: pa.ChunkedArray, width: int) -> np.ndarray:
    """Length of the common beginning of each value and the next one."""
    a = a.combine_chunks().cast(pa.large_binary())
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(1, np.uint8)
    size, out = np.diff(off), np.zeros(max(len(a) - 1, 0), np.int64)
    for lo in range(0, len(out), 20_000):
        o = off[lo : min(lo + 20_001, len(a))]
        m = data[np.minimum(o[:, None] + np.arange(width), len(data) - 1)]
        differ = m[1:] != m[:-1]
        out[lo : lo + len(o) - 1] = np.where(differ.any(1), differ.argmax(1), width)
    return np.minimum(out, np.minimum(size[1:], size[:-1]))


_D = np.arange(REACH)


def _beside(t: pa.Table, lo: int, hi: int, keyed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the due rows: longest common right and left part with a neighbour, the distances d that a neighbour settles, and the
    least d from which on a neighbour shares the right part but not the string."""
    right, left = _common(t.column("right"), SPAN), _common(t.column("left"), REACH)
    if keyed:
        left = np.where(right >= KEY, left, 0)
    settled = np.zeros((hi - lo, REACH), bool)
    pad = lambda x: np.concatenate([[0], x, [0]])
    r, l = pad(right), pad(left)  # noqa: E741
    apart = np.maximum(SPAN - r, l + 1)
    for side in (0, 1):
        rs, ls = r[lo + side : hi + side, None], l[lo + side : hi + side, None]
        settled |= (_D >= SPAN - rs) & (_D <= ls)
    return np.maximum(r[lo:hi], r[lo + 1 : hi + 1]), np.maximum(l[lo:hi], l[lo + 1 : hi + 1]), settled, np.minimum(apart[lo:hi], apart[lo + 1 : hi + 1])


Ends = dict[int, tuple[pa.Table | None, pa.Table | None]]


def _in_parse_order(ends: Ends):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, lo, hi in _stream(batches, *ends.get(TaskContext.get().partitionId(), (None, None))):
            r, _, settled, apart = _beside(t, lo, hi, False)
            rows = t.slice(lo, hi - lo).combine_chunks()
            bits = pa.array([x.tobytes() for x in np.packbits(settled, 1)], pa.binary())
            yield from rows.append_column("most", pa.array(r)).append_column("apart", pa.array(apart.astype(np.int16))).append_column("settled", bits).to_batches()

    return run


def _in_dictionary_order(ends: Ends):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, lo, hi in _stream(batches, *ends.get(TaskContext.get().partitionId(), (None, None))):
            _, l, settled, _ = _beside(t, lo, hi, True)  # noqa: E741
            rows = t.slice(lo, hi - lo)
            settled |= np.unpackbits(np.frombuffer(b"".join(rows.column("settled").to_pylist()), np.uint8).reshape(hi - lo, -1), axis=1)[:, :REACH].astype(bool)
            place, most, apart = (rows.column(c).to_numpy() for c in ("place", "most", "apart"))
            first, back = place >> 16, place >> 8 & 255
            # runs of settled distances are runs of starts
            step = np.diff(np.pad(settled, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, d0 = np.nonzero(step == 1)
            d1 = np.nonzero(step == -1)[1]
            runs = pack(first[row] + back[row] - d1 + 1, d1 - d0)
            open_row, d = np.nonzero((~settled | (_D >= apart[:, None])) & (_D >= SPAN - most[:, None]) & (_D <= l[:, None]))
            right, left = rows.column("right").to_pylist(), rows.column("left").to_pylist()
            strings = [left[k][:x][::-1] + right[k][: SPAN - x] for k, x in zip(open_row.tolist(), d.tolist(), strict=True)]
            ids = pa.array(np.append(row, open_row))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * len(row) + strings, pa.binary()), pa.array(np.append(runs, pack(first[open_row] + back[open_row] - d, np.ones(len(d))))), *(rows.column(c).combine_chunks().take(ids) for c in ("r1", "r2"))],
                names=["string", "place", "r1", "r2"],
            )

    return run


def _in_corpus_order(ends: Ends):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, lo, hi in _stream(batches, *ends.get(TaskContext.get().partitionId(), (None, None))):
            same = np.concatenate([[False], _common(t.column("string"), SPAN) == SPAN, [False]])
            keep = pa.array((same[:-1] | same[1:])[lo:hi])
            yield from t.slice(lo, hi - lo).select(["place", "r1", "r2"]).filter(keep).combine_chunks().to_batches()

    return run


def _ordered(rows: DataFrame, by: list[str], reader: Callable, schema: str) -> DataFrame:
    """``rows`` in the byte order of ``by``, range-partitioned, read by ``reader(ends)`` with neighbours across partitions."""
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    found = placed.mapInArrow(_ends, f"part_ int, end_ int, {kinds}").toArrow()  # two rows a partition
    part, end = found.column("part_").to_pylist(), found.column("end_").to_pylist()
    rows = found.drop_columns(["part_", "end_"])
    # copies: a slice would send the whole table with each row
    at = {(p, e): rows.slice(k, 1).take([0]).combine_chunks() for k, (p, e) in enumerate(zip(part, end, strict=True))}
    full = sorted(set(part))
    ends = {p: (at[full[k - 1], 1] if k else None, at[full[k + 1], 0] if k + 1 < len(full) else None) for k, p in enumerate(full)}
    return placed.mapInArrow(reader(ends), schema)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with their row key r1, r2, (place, r1, r2) of repeated strings: starts that follow each other)."""
    with shuffles_dropped(docs.sparkSession):
        return _repeated(docs, key, text)


def _repeated(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    base = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.hash("text", "doc_id").alias("r2"))
    long = base.where(F.octet_length("text") >= SPAN).select("r1", "r2", "text")
    ids = "place long, r1 long, r2 int"
    phrases = long.mapInArrow(_parsed, f"key long, deal short, n1 long, n2 long, flag byte, {ids}")
    marks = cut(phrases.repartition("key", "deal").sortWithinPartitions("key", "deal", "n1", "n2").mapInArrow(_phrases, f"{ids}, again boolean"))
    places = marks.where("NOT again").groupBy("r1", "r2").agg(F.collect_list("place").alias("places"))
    entries = long.join(places, ["r1", "r2"]).select("r1", "r2", "text", "places").mapInArrow(_entries, f"right binary, left binary, {ids}")
    parsed = _ordered(cut(entries), ["right", "left"], _in_parse_order, f"right binary, left binary, {ids}, most long, apart short, settled binary")
    keyed = parsed.select(F.substring("right", 1, KEY).alias("head"), "*")
    read = cut(_ordered(keyed, ["head", "left", "right"], _in_dictionary_order, f"string binary, {ids}"))
    rest = _ordered(read.where("string IS NOT NULL"), ["string"], _in_corpus_order, ids)
    found = marks.where("again").select("place", "r1", "r2").unionByName(read.where("string IS NULL").select("place", "r1", "r2")).unionByName(cut(rest))
    return base, found


def covered(n: int, places: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in the strings at the places."""
    first, k = places >> 16, places & 255
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + k - 1 + SPAN, -1)
    return np.cumsum(step[:-1]) > 0


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col, out = b.column(1).cast(pa.binary()), [[], [], [], []]
        for k in range(b.num_rows):
            raw, places = _raw(col[k]), b.column(2)[k].as_py()
            gone = covered(len(raw), np.array(places, np.int64)) if places else np.zeros(len(raw), bool)
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            for o, v in zip(out, (len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    base, found = repeated(docs, key, text)
    places = found.groupBy("r1", "r2").agg(F.collect_set("place").alias("places"))
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = base.join(places, ["r1", "r2"], "left").select("doc_id", "text", "places")
    return rows.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
