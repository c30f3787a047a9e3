"""Product codes of integer vectors, with nearest codebook entries found through VA-file bounds.

A component x becomes floor(1024 * x); a vector is cut into ``PARTS`` equal parts, each coded by the nearest of ``ENTRIES``
codebook entries. The entries start as the parts of the first vectors by id and follow ``ROUNDS`` rounds of assigning and
averaging. For the search, each coordinate of a part's entries is quantised into 2 ** ``BITS`` cells of equal population. A
part that looks for its nearest entry makes one table a coordinate, with the least and the greatest squared distance to each
cell; their sums over an entry's cells bound its distance from below and from above. Only entries whose lower bound does not
exceed the least upper bound are compared, in exact integers; of equal ones the lower index wins.

Every round is one pass over the table: a task sums the parts of each entry, Spark adds the sums up, and the driver holds the
codebooks, which are of a fixed size. The table itself is never collected, cached or exchanged.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; the dimension is that of the first
kept vector by id (then by components; null ids last) whose length is a positive multiple of ``PARTS``, and vectors of other
lengths keep their row with null code and error and teach nothing; fewer than ``ENTRIES`` vectors give as many entries; rows
repeat, ids may; an empty table gives an empty one. Integers beyond 2 ** 28 raise, as their distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BITS, CHUNK, GREATEST = 4, 4096, 2**28
#: Bounds are summed in single precision; this share covers its rounding many times over.
SLACK = 1e-3


class Cells:
    """The entries of one part (rows of integers), their cells and the search for the nearest."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, d = entries.shape
        cells = min(n, 1 << BITS)
        rank = np.argsort(np.argsort(entries, 0, kind="stable"), 0, kind="stable")
        cell = rank * cells // n  # (entry, coordinate) -> cell
        ordered = np.sort(entries, 0)
        begin = -(-np.arange(cells) * n // cells)
        stop = np.append(begin[1:], n)
        self.low, self.high = ordered[begin].T.astype(np.float32), ordered[stop - 1].T.astype(np.float32)
        # which table fields each entry sums up
        self.picks = np.zeros((d * cells, n), np.float32)
        for j in range(d):
            self.picks[j * cells + cell[:, j], np.arange(n)] = 1

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of ``parts``."""
        index, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for at in range(0, len(parts), CHUNK):
            x = parts[at : at + CHUNK]
            to_low, to_high = self.low - x[:, :, None].astype(np.float32), x[:, :, None].astype(np.float32) - self.high
            least = np.maximum(np.maximum(to_low, to_high), 0).reshape(len(x), -1)
            most = np.maximum(np.abs(to_low), np.abs(to_high)).reshape(len(x), -1)
            lower, upper = (least * least) @ self.picks, ((most * most) @ self.picks).min(1, keepdims=True)
            row, entry = np.nonzero(lower * (1 - SLACK) <= upper * (1 + SLACK) + SLACK)
            away = x[row] - self.entries[entry]
            away = (away * away).sum(1)
            first = np.searchsorted(row, np.arange(len(x)))
            best = np.minimum.reduceat(away, first)
            hit = np.flatnonzero(away == best[row])  # in rows and, within one, by entry
            index[at : at + CHUNK] = entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]]
            error[at : at + CHUNK] = best
        return index, error


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` floats -> integers."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * SCALE)
    if len(x) and np.abs(x).max() > GREATEST:
        raise ValueError(f"a component is beyond {GREATEST // SCALE}; its squared distances would leave 64 bits")
    return x.astype(np.int64)


def _sums(books: list[np.ndarray], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, d = [Cells(b) for b in books], dim // PARTS
        count, total = np.zeros((PARTS, len(books[0])), np.int64), np.zeros((PARTS, len(books[0]), d), np.int64)
        for b in batches:
            x = _matrix(b.column(0), dim)
            for p in range(PARTS):
                part = x[:, p * d : (p + 1) * d]
                index, _ = cells[p].nearest(part)
                order = np.argsort(index, kind="stable")
                own, first = np.unique(index[order], return_index=True)
                if len(own):
                    total[p, own] += np.add.reduceat(part[order], first, 0)
                    count[p] += np.bincount(index, minlength=count.shape[1])
        part, entry = np.nonzero(count)
        flat = total[part, entry]
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry])]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(flat[:, j])) for j in range(d))], names=["part", "entry", "n", *(f"s{j}" for j in range(d))])

    return run


def _codes(books: list[np.ndarray], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, d = [Cells(b) for b in books], dim // PARTS
        for b in batches:
            fits = np.asarray(b.column(2).value_lengths().to_numpy(zero_copy_only=False) == dim)
            x = _matrix(b.column(2).filter(pa.array(fits)), dim)
            code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p in range(PARTS):
                index, away = cells[p].nearest(x[:, p * d : (p + 1) * d])
                code[:, p] = index
                error += away
            at = np.cumsum(fits) - 1
            said = [code[k].tobytes().hex() if ok else None for k, ok in zip(at, fits, strict=True)]
            errors = pa.array([int(error[k]) if ok else None for k, ok in zip(at, fits, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), errors], names=["vec_id", "label", "code", "error"])

    return run


def _first(rows: DataFrame, n: int) -> list:
    return rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(n).collect()


def learn(rows: DataFrame) -> tuple[int, list[np.ndarray]]:
    """(dimension, a codebook a part) of rows (vec_id, label, embedding: array of finite doubles); dimension 0 without vectors."""
    usable = rows.where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    first = _first(usable, ENTRIES)
    if not first:
        return 0, []
    dim = len(first[0].embedding)
    own = rows.where(F.size("embedding") == dim)
    if any(len(r.embedding) != dim for r in first):
        first = _first(own, ENTRIES)
    d = dim // PARTS
    x = _matrix(pa.array([r.embedding for r in first], pa.list_(pa.float64())), dim)
    books = [np.ascontiguousarray(x[:, p * d : (p + 1) * d]) for p in range(PARTS)]
    fields = "part int, entry int, n long, " + ", ".join(f"s{j} long" for j in range(d))
    for _ in range(ROUNDS):
        sums = own.select("embedding").mapInArrow(_sums(books, dim), fields).groupBy("part", "entry").agg(F.sum("n"), *(F.sum(f"s{j}") for j in range(d)))
        books = [b.copy() for b in books]
        for part, entry, n, *total in sums.collect():  # at most PARTS * ENTRIES rows
            books[part][entry] = [t // n for t in total]
    return dim, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error of each kept row; the codebooks)."""
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("embedding"))
    finite: Column = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & finite)
    dim, books = learn(rows)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    if not books:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), books
    return rows.mapInArrow(_codes(books, dim), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors summed over equal labels, nulls together. Sums are partial before they are exchanged, and both
    sides of the join are plain exchanges, so that a label of very many rows is split."""
    coded = cut(coded)
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")
