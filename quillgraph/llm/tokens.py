"""Token counts of a byte-fallback BPE vocabulary by rank-synchronous array merging.

A text is cut into pre-tokens where no piece of the vocabulary can cross. The distinct pre-tokens of a batch are held as
one ragged numpy array of symbols. In every round each sequence finds its lowest-rank pair and all sequences merge at
once; equal pairs of one sequence merge in the same round as long as no merge opens a pair that would come first. What is
left is counted; a character without a piece counts its UTF-8 bytes.

Defined cases: a null or empty text has 0 tokens; every row gives one row; an empty table gives an empty one. Memory is
bounded by ``CHUNK`` characters of work and ``CACHE`` remembered pre-tokens a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE, CHUNK, LIMIT = 400_000, 4_000_000, 4096
_NONE = np.int32(2**30)
_MARK = "▁"  # how the vocabulary writes a space


class Merger:
    """Counts tokens with the vocabulary of one sentencepiece BPE model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        symbols = {p: k for k, p in enumerate(sorted({*pieces, *(c for p in pieces for c in p)}))}
        n = len(symbols)
        self.cost = np.ones(n + 5, np.int64)
        self.cost[n + 1 :] = range(1, 5)  # symbols n+1..n+4: characters the vocabulary never names, by their bytes
        for s, k in symbols.items():
            if s not in pieces:
                self.cost[k] = len(s.encode())
        cp = np.arange(0x110000)
        self.of_char = (n + 1 + (cp > 0x7F).astype(np.int32) + (cp > 0x7FF) + (cp > 0xFFFF)).astype(np.int32)
        for s, k in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        pairs = {}
        for p, score in pieces.items():
            for at in range(1, len(p)):
                left, right = symbols.get(p[:at]), symbols.get(p[at:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = (order[score], symbols[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.into = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        joint = {c for p in pieces if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in joint)  # white space that never joins a neighbour
        crossed = any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        self.cut = re.compile(r".+" if crossed else rf" *[^ {alone}]+| +|[{alone}]" if alone else r" *[^ ]+| +", re.S)
        self.seen: dict[str, int] = {}

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``_NONE``: no merge) and product of each pair."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), self.into[at]

    def merge(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token, with a character's bytes for unknown ones."""
        flat = np.frombuffer("".join(tokens).replace(" ", _MARK).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        sym, seq = self.of_char[flat], np.repeat(np.arange(len(tokens)), size)
        total = np.zeros(len(tokens), np.int64)
        while len(sym):
            inside = np.append(seq[1:] == seq[:-1], False)
            rank = np.full(len(sym), _NONE, np.int32)
            into = np.zeros(len(sym), np.int32)
            at = np.flatnonzero(inside)
            rank[at], into[at] = self._look(sym[at], sym[at + 1])
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, first)
            done = best == _NONE
            lengths = np.diff(np.append(first, len(sym)))
            if done.any():
                total[seq[first[done]]] = np.add.reduceat(self.cost[sym], first)[done]
            low = np.repeat(best, lengths)
            cand = np.flatnonzero((rank == low) & (low != _NONE))
            # of overlapping candidates every second one, from the left
            begins = np.append(True, np.diff(cand) != 1)
            run = np.flatnonzero(begins)
            cand = cand[(np.arange(len(cand)) - run[np.cumsum(begins) - 1]) % 2 == 0]
            if len(cand):
                own, most, made = seq[cand], rank[cand], into[cand]
                left = np.maximum(cand - 1, 0)
                left_sym = sym[left]
                near = np.append(False, np.diff(cand) == 2)  # the left neighbour has just been merged
                left_sym[near] = made[np.flatnonzero(near) - 1]
                has_left = (cand > 0) & (seq[left] == own)
                right = np.minimum(cand + 2, len(sym) - 1)
                has_right = (cand + 2 < len(sym)) & (seq[right] == own)
                unsafe = has_left & (self._look(left_sym, made)[0] <= most)
                unsafe |= has_right & (self._look(made, sym[right])[0] <= most)
                before = np.cumsum(unsafe) - unsafe
                opens = np.append(True, own[1:] != own[:-1])
                cand_ok = before == before[opens][np.cumsum(opens) - 1]
                cand, made = cand[cand_ok], made[cand_ok]
                sym = sym.copy()
                sym[cand] = made
            keep = np.repeat(~done, lengths)
            keep[cand + 1] = False
            sym, seq = sym[keep], seq[keep]
        return total

    def count(self, texts: list[str]) -> list[int]:
        cuts = [self.cut.findall(" " + t.replace(_MARK, " ")) if t else [] for t in texts]
        new = [x for x in {x for c in cuts for x in c} if x not in self.seen]
        if len(self.seen) + len(new) > CACHE:
            new, self.seen = list({x for c in cuts for x in c}), {}
        if new:
            self.seen.update(zip(new, self.merge(new).tolist(), strict=True))
        return [sum(map(self.seen.__getitem__, c)) for c in cuts]


_HELD: dict[str, Merger] = {}


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _HELD:
            _HELD[path] = Merger(path)
        m = _HELD[path]
        for b in batches:
            texts, out, part, chars = b.column(b.num_columns - 1), [], [], 0
            for t in texts:
                part.append(t.as_py() or "")
                chars += len(part[-1])
                if chars > CHUNK:
                    out += m.count(part)
                    part, chars = [], 0
            out += m.count(part)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row under the model at ``path``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_counter(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
