"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point's rank. A letter n-gram is bound as the product of
its letters' vectors, each permuted (rotated) by its place. Bundling (summing) the n-grams of all learning texts of a
language makes the language's prototype; a text is the bundle of its own n-grams and gets the language of the nearest
prototype by cosine. The score is that language's share in a softmax over the cosines.

Learning reads every learning text: workers count n-grams by language, the counts are summed by key, the sums are bundled
where they lie, and the partial bundles are summed by language and dimension. The model on the driver is languages x
``DIM`` numbers.

Defined cases: a null text or one without a letter is ``und`` with score 0; a null language is not learned from; a null
id is predicted, not learned from; with nothing to learn from every text is ``und``; letters of every plane count; each row
gives one row; only the named columns are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, SEED, SHARP = 2048, 20, 25.0
UNKNOWN = "und"
#: Texts are read in chunks; a chunk's number and a trigram of any letters fit into 63 bits.
CHUNK_DOCS, CHUNK_CHARS = 2000, 1_500_000
#: Texts and n-grams of one product of counts and bound vectors; letters whose vectors are held.
BLOCK_DOCS, BLOCK_GRAMS, HELD_LETTERS = 64, 2048, 30_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> 1 + its rank among letters, 0 for anything else."""
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(alpha, np.cumsum(alpha), 0).astype(np.int64)


@lru_cache(1)
def base() -> int:
    """Trigram codes are numbers of three digits to this base."""
    n = int(_letters().max()) + 1
    assert CHUNK_DOCS * n**3 < 2**63
    return n


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram code, count) of the texts; runs of non-letters count as one space."""
    lowered = [t.lower() for t in texts]
    flat = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    letter = _letters()[flat]
    keep = np.append(True, (letter[1:] != 0) | (letter[:-1] != 0) | (doc[1:] != doc[:-1]))
    letter, doc = letter[keep], doc[keep]
    code = (letter[:-2] * base() + letter[1:-1]) * base() + letter[2:]
    ok = (doc[2:] == doc[:-2]) & (letter[1:-1] != 0)
    key, n = np.unique(doc[:-2][ok] * base() ** 3 + code[ok], return_counts=True)
    return key // base() ** 3, key % base() ** 3, n


class Binder:
    """Binds trigram codes into vectors."""

    def __init__(self) -> None:
        self.row: dict[int, int] = {}
        self.v = np.zeros((0, DIM), np.int8)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        parts = [np.unique(p, return_inverse=True) for p in (codes // base() ** 2, codes // base() % base(), codes % base())]
        if len(self.row) > HELD_LETTERS:
            self.row, self.v = {}, self.v[:0]
        new = sorted({x for p, _ in parts for x in p.tolist()} - self.row.keys())
        if new:
            made = [np.random.Generator(np.random.Philox(key=[SEED, x])).integers(0, 2, DIM, np.int8) * 2 - 1 for x in new]
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.v = np.vstack([self.v, np.array(made, np.int8)])
        a, b, c = (np.roll(self.v[[self.row[x] for x in p.tolist()]], turn, 1)[at] for turn, (p, at) in zip((2, 1, 0), parts, strict=True))
        return a * b * c


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    part, chars, start = [], 0, 0
    for k, t in enumerate(batch.column(column)):
        part.append(t.as_py() or "")
        chars += len(part[-1])
        if len(part) >= CHUNK_DOCS or chars >= CHUNK_CHARS:
            yield start, part
            part, chars, start = [], 0, k + 1
    if part:
        yield start, part


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> partial (lang, code, n), flushed when many keys are held."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    for b in batches:
        langs = b.column(0).to_pylist()
        for start, texts in _chunks(b, 1):
            own = np.array(langs[start : start + len(texts)], object)
            doc, code, n = grams(texts)
            for lang in set(own):
                mine = own[doc] == lang
                codes, at = np.unique(code[mine], return_inverse=True)
                held.setdefault(lang, []).append((codes, np.bincount(at, n[mine], len(codes))))
                size += len(codes)
            if size > 2_000_000:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) -> partial prototypes (lang, vector)."""
    binder, sums = Binder(), {}
    for b in batches:
        langs, codes, n = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), b.column(2).to_numpy()
        for lo in range(0, len(codes), BLOCK_GRAMS):
            h = binder.bind(codes[lo : lo + BLOCK_GRAMS]).astype(np.float64)
            for lang in set(langs[lo : lo + BLOCK_GRAMS]):
                w = np.where(langs[lo : lo + BLOCK_GRAMS] == lang, n[lo : lo + BLOCK_GRAMS], 0)
                sums[lang] = sums.get(lang, 0) + w @ h
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["lang", "v"])


Model = tuple[list[str], np.ndarray]


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Prototypes of all rows with a language and a text: (languages, unit vectors)."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    parts = counts.mapInArrow(_bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("at", "x"))
    sums: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).collect():  # languages x DIM numbers
        sums.setdefault(r.lang, np.zeros(DIM))[r["at"]] = r.x
    langs = sorted(x for x, v in sums.items() if np.any(v))
    proto = np.array([sums[x] / np.linalg.norm(sums[x]) for x in langs]) if langs else np.zeros((0, DIM))
    return langs, proto.astype(np.float32)


class Scorer:
    """Bundles texts and compares them with the prototypes."""

    def __init__(self, proto: np.ndarray) -> None:
        self.proto, self.binder = proto.T.copy(), Binder()

    def bundles(self, texts: list[str]) -> np.ndarray:
        """The texts' vectors."""
        doc, code, n = grams(texts)
        out = np.zeros((len(texts), DIM), np.float32)
        for first in range(0, len(texts), BLOCK_DOCS):
            mine = slice(*np.searchsorted(doc, [first, first + BLOCK_DOCS]))
            codes, at = np.unique(code[mine], return_inverse=True)
            for lo in range(0, len(codes), BLOCK_GRAMS):
                held = codes[lo : lo + BLOCK_GRAMS]
                ok = (at >= lo) & (at < lo + BLOCK_GRAMS)
                counts = np.zeros((min(BLOCK_DOCS, len(texts) - first), len(held)), np.float32)
                counts[doc[mine][ok] - first, at[ok] - lo] = n[mine][ok]
                out[first : first + BLOCK_DOCS] += counts @ self.binder.bind(held).astype(np.float32)
        return out

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, has a letter) of the texts."""
        v = self.bundles(texts)
        norm = np.sqrt(np.square(v, dtype=np.float64).sum(1))
        known = np.zeros(len(texts), bool)
        known[[k for k, t in enumerate(texts) if any(map(str.isalpha, t))]] = True
        return (v @ self.proto) / np.maximum(norm, 1e-9)[:, None], known


def _predictor(model: Model):
    langs, proto = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(proto)
        for b in batches:
            pred, score, best_cos, letters = [], [], [], []
            for _, texts in _chunks(b, b.num_columns - 1):
                if not langs:
                    pred += [UNKNOWN] * len(texts)
                    score += [0.0] * len(texts)
                    best_cos += [0.0] * len(texts)
                    letters += [0] * len(texts)
                    continue
                cos, known = scorer.cosines(texts)
                e = np.exp(SHARP * (cos - cos.max(1, keepdims=True)))
                best = cos.argmax(1)
                pred += [langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                score += np.where(known, 1 / e.sum(1), 0.0).tolist()
                best_cos += np.where(known, cos.max(1), 0.0).tolist()
                letters += [sum(map(str.isalpha, t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(best_cos, pa.float64()), pa.array(letters, pa.int32())],
                names=[*b.schema.names[:-1], "lang_pred", "score", "cosine", "letters"],
            )

    return run


def held_out(key: Column, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))


def evidence(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, cosine (with the nearest prototype) and letters of each row; nothing but the text is used."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_predictor(model), f"`{key}` {kind}, lang_pred string, score double, cosine double, letters int")


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of each row."""
    return evidence(docs, model, key, text).select(f"`{key}`", "lang_pred", "score")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
