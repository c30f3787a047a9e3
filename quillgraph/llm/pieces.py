"""Exact encoding and decoding with a byte-fallback BPE vocabulary, by backtracking instead of merging.

A token sequence is the encoding of a text exactly if every two adjacent tokens are what their joint text encodes to. So the
text is walked from left to right: an Aho-Corasick automaton gives the longest piece that starts at each position; a piece is
taken if merging its text together with that of the token before gives these two tokens again, else its longest proper
prefix that is a piece is tried. Where nothing fits, the position is marked in a bitfield and the walk steps back over one
token. The tokens before a position are unique, so a position that failed once is never entered again and a text costs
linear time. Texts are first cut where no piece crosses, and cuts met lately are remembered up to a bound; a character
without a piece gives the ids of its bytes. Decoding gathers the bytes of all ids at once.

Defined cases: a null or empty text has only the begin and end ids and decodes to the empty text; the texts of begin, end and
unknown ids are ordinary text; every row gives one row and repeated rows repeat; an empty table gives an empty one; only the
two named columns are read. Byte ids that form no character decode to U+FFFD each, ids outside the vocabulary raise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.columns import text_of

#: Cuts that a worker remembers in each of two generations, token pairs that it remembers, characters of a cut worth it.
CUTS, PAIRS, LONGEST = 200_000, 400_000, 64
_MARK = "▁"  # how the vocabulary writes a space


class Codec:
    """Encodes and decodes with the vocabulary of one sentencepiece BPE model."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        of_byte, surface = {}, []
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                of_byte[int(piece[3:-1], 16)] = i
                surface.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i):
                surface.append(b"")
            elif sp.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                self.id_of[piece], self.score[piece] = i, sp.get_score(i)
                surface.append(piece.replace(_MARK, " ").encode())
        self.bytes_of = [of_byte[b] for b in range(256)]
        self.byte_ids = np.zeros(n, bool)
        self.byte_ids[self.bytes_of] = True
        self.starts_blank = np.array([s[:1] == b" " and self.id_of.get(sp.id_to_piece(i)) == i for i, s in enumerate(surface)])
        self.size = np.fromiter(map(len, surface), np.int64, n)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        # a character that only occurs inside longer pieces is a symbol of its own too, written as bytes if it stays alone
        symbols = {*self.id_of, *(c for p in self.id_of for c in p)}
        self.names = sorted(symbols)
        number = {p: k for k, p in enumerate(self.names)}
        self.sizes = [len(p) for p in self.names]
        self.find = ahocorasick.Automaton()
        for p, k in number.items():
            self.find.add_word(p, k)
        self.find.make_automaton()
        # the longest proper prefix that is a symbol; every character is one
        self.shorter = [number[next(p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in number)] if len(p) > 1 else -1 for p in self.names]
        joint = {c for p in self.id_of if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in joint)
        crossed = any(re.search(f"[^{_MARK}]{_MARK}", p) for p in self.id_of)
        self.cut = re.compile(r".+" if crossed else rf"{_MARK}*[^{_MARK}{alone}]+|{_MARK}+|[{alone}]" if alone else rf"{_MARK}*[^{_MARK}]+|{_MARK}+", re.S)
        self.known = {p for p in symbols if len(p) == 1}
        self.code = [np.uint32(self.id_of[p]).tobytes() if p in self.id_of else self._spelt(p) for p in self.names]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging: the best-scored adjacent pair first, of equal ones the leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether the symbol ``token`` can follow ``before`` (-1 at the start)."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        one, two = self.names[before] if before >= 0 else "", self.names[token]
        known = self.pairs[before * len(self.names) + token] = self.merged(one + two) == ([one, two] if one else [two])
        return known

    def walk(self, text: str) -> list[int]:
        """The symbols (positions in ``names``) of a text of known characters."""
        n, many, sizes, shorter, fits, get = len(text), len(self.names), self.sizes, self.shorter, self.fits, self.pairs.get
        longest = [-1] * (n + 1)
        for last, token in self.find.iter(text):
            longest[last - sizes[token] + 1] = token  # longer ones end later
        failed, out, pos, token, before = None, [], 0, longest[0], -1
        while pos < n:
            while token >= 0:
                stop = pos + sizes[token]
                if failed is None or not failed[stop >> 3] >> (stop & 7) & 1:
                    good = get(before * many + token)
                    if good is None:
                        good = fits(before, token)
                    if good:
                        out.append(token)
                        pos, before = stop, token
                        token = longest[pos]
                        break
                token = shorter[token]
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos, before = pos - sizes[token], out[-1] if out else -1
        return out

    def _ids(self, cut: str) -> bytes:
        if self.known.issuperset(cut):
            return b"".join([self.code[token] for token in self.walk(cut)])
        ids: list[bytes] = []
        pos, n = 0, len(cut)
        for stop in [k for k, c in enumerate(cut) if c not in self.known] + [n]:
            if stop > pos:
                ids += [self.code[token] for token in self.walk(cut[pos:stop])]
            if stop < n:
                ids.append(self._spelt(cut[stop]))
            pos = stop + 1
        return b"".join(ids)

    def _spelt(self, text: str) -> bytes:
        return np.array([self.bytes_of[b] for b in text.encode()], "<u4").tobytes()

    def encode(self, text: str, ends: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, between the begin and end id if ``ends``."""
        out = []
        recent, older = self.recent, self.older
        for c in self.cut.findall((_MARK + text).replace(" ", _MARK)) if text else []:
            ids = recent.get(c)
            if ids is None:
                ids = older.get(c) or self._ids(c)
                if len(c) <= LONGEST:
                    if len(recent) >= CUTS:  # what was met lately stays
                        older, recent = recent, {}
                        self.recent, self.older = recent, older
                    recent[c] = ids
            out.append(ids)
        ids = b"".join(out)
        return np.uint32(self.begin).tobytes() + ids + np.uint32(self.end).tobytes() if ends else ids

    def decode(self, ids: bytes) -> str:
        """The text of ids as ``encode`` gives them, without the blank that encoding puts in front."""
        at = np.frombuffer(ids, "<u4")
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.flat[np.arange(ends[-1] if len(at) else 0) + np.repeat(self.start[at] - ends + size, size)]
        said = np.flatnonzero(size)
        skip = int(len(said) > 0 and self.starts_blank[at[said[0]]])
        if len(said) == 0 or said[-1] - said[0] == len(said) - 1:  # else begin or end ids stand between others and part their bytes
            try:
                return flat[skip:].tobytes().decode()
            except UnicodeDecodeError:
                pass
        return "".join(self._text(at, flat, ends - size))[skip:]

    def _text(self, at: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> Iterator[str]:
        """Text run by run: of plain pieces, or of bytes of which those that form no character are replaced."""
        is_byte = self.byte_ids[at]
        turns = np.flatnonzero(np.append(True, is_byte[1:] != is_byte[:-1]))
        stops = np.append(begins[turns[1:]], len(flat))
        for k, stop in zip(turns.tolist(), stops.tolist(), strict=True):
            part = flat[begins[k] : stop].tobytes()
            pos = 0
            while pos < len(part):
                for size in (len(part),) if not is_byte[k] else (1, 2, 3, 4):
                    try:
                        yield part[pos : pos + size].decode()
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    yield "�"
                    size = 1
                pos += size


_HELD: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _HELD:
        _HELD[path] = Codec(path)
    return _HELD[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit, with begin and end ids) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            ids = [codec.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with the decoded text (string) as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            texts = [codec.decode(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, text string")
