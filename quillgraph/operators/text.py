"""Text operators: pages, chunks, tags."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillgraph.functions import patterns as P


def markdown_pages(docs: DataFrame, lines: int = 101, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, page, text: pages of ``lines`` lines, built in the row without a shuffle."""
    ls = F.split(F.col(text), "\n")
    n = F.ceil(F.size(ls) / lines).cast("int")
    pages = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.struct(p.alias("page"), F.array_join(F.slice(ls, (p - 1) * lines + 1, lines), "\n").alias("text")))
    return docs.select(key, F.inline(pages))


def fixed_chunks(docs: DataFrame, size: int = 500, overlap: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, position, chunk: character windows with an overlap of a fifth."""
    step = size - (size // 5 if overlap is None else overlap)
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    rows = docs.select(key, text, F.posexplode(at).alias("position", "at"))
    return rows.select(key, "position", F.substring(F.col(text), F.col("at"), F.lit(size)).alias("chunk")).where(F.trim("chunk") != "")


#: Rows, and characters of text, that a task turns into Python objects at a time.
ROWS, CHARACTERS = 256, 1 << 20


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(key, text) of a few rows at a time, however large the batches are that Spark sends."""
    for b in batches:
        held, size = [], 0
        for k, t in zip(b.column(0), b.column(1), strict=True):
            held.append((k.as_py(), t.as_py() or ""))
            size += len(held[-1][1])
            if len(held) >= ROWS or size >= CHARACTERS:
                yield held
                held, size = [], 0
        if held:
            yield held


def _rows_of(docs: DataFrame, key: str, text: str, each, columns: str) -> DataFrame:
    """key and ``columns`` of the rows that ``each`` (text) gives for every row; what a task holds is a few rows."""
    out = StructType([docs.schema[key], *StructType.fromDDL(columns).fields])
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _some(batches):
            cols = list(zip(*((k, *r) for k, t in some for r in each(t)), strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    return docs.select(key, text).mapInArrow(run, out)


_CUTS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters that end at the best boundary: paragraph, line, sentence, word, character."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for c in _CUTS:
                k = text.rfind(c, at + 1, end) if c else end
                if k > at + overlap:
                    end = k + (len(c) if k < end else 0)
                    break
        out.append(text[at:end])
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return [c for c in map(str.strip, out) if c]


def semantic_chunks(docs: DataFrame, size: int = 512, overlap: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, position, chunk, token_count."""
    each = lambda t: [(i, c, -(-len(c.encode()) // 4)) for i, c in enumerate(split_text(t, size, overlap))]
    return _rows_of(docs, key, text, each, "position int, chunk string, token_count int")


class _Body(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.body, self.inside = None, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("title", "body"):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data):
        if "title" in self.inside and self.title is None:
            self.title = data
        elif "body" in self.inside:
            self.body.append(data)


def html_text(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key, title, body: the first title and all text of the body."""

    def each(html: str) -> list[tuple]:
        b = _Body()
        b.feed(html)
        b.close()
        return [(b.title, "".join(b.body))]

    return _rows_of(pages, key, column, each, "title string, body string")


def html_title(column: Column) -> Column:
    """The first title's text with the basic character references decoded, JVM-side."""
    t = F.regexp_extract(column, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def tag_spans(docs: DataFrame, patterns: list, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, label, match: with offsets, Arrow-batched."""
    return _rows_of(docs, key, text, lambda t: P.spans(t, patterns), "start int, end int, label string, match string")


def redacted(docs: DataFrame, patterns: list, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p.iloc[:, 0], "text": [P.redact_spans(t or "", patterns) for t in p.iloc[:, 1]]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, text string")


def citations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, match, score: citation spans, each once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, t in zip(p.iloc[:, 0], p.iloc[:, 1], strict=True):
                got = {(m.start(), m.end()): m.group(0).strip() for c, exact in P.CITATIONS for m in re.finditer(c, t or "", 0 if exact else re.I)}
                rows += [(k, lo, hi, s, 0.95) for (lo, hi), s in sorted(got.items())]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "match", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, start int, end int, match string, score double")


def span_positions(text: Column, span: Column) -> Column:
    """1-based starts of all occurrences, overlapping ones too; none if the span is empty or either is null.

    The text is split before each occurrence, where every part but the first begins, and the parts' lengths are summed: one pass, however long the text.
    """
    none = F.array().cast("array<int>")
    before = F.concat(F.lit("(?=\\Q"), F.replace(span, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    start = F.struct(F.lit(1).alias("at"), none.alias("found"))
    step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.when((a["at"] > 1) | F.startswith(text, span), F.concat(a["found"], F.array(a["at"]))).otherwise(a["found"]).alias("found"))
    return F.when((F.length(span) > 0) & F.contains(text, span), F.coalesce(F.aggregate(F.split(text, before), start, step, lambda a: a["found"]), none)).otherwise(none)


def merge_tags(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """All of ``first`` and those of ``second`` that overlap none of it: an interval anti-join on the key.

    ``second`` must not overlap itself; unlocated tags (start -1) never overlap.
    """
    a = first.select(F.col(key).alias("k"), F.col("start").alias("s"), F.col("end").alias("e")).where("s >= 0")
    hit = (second[key] == a["k"]) & (second["start"] < a["e"]) & (a["s"] < second["end"]) & (second["start"] >= 0)
    return first.unionByName(second.join(a, hit, "left_anti"))




_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"?|[{}\]]', re.S)
#: Arrays of an answer whose complete objects are kept when the rest is cut off.
ANSWER_ARRAYS = ("topics", "entity_topic_links")


def repair(answer: str | None) -> str | None:
    """An answer as JSON text: without fences, then from its first to its last brace, then the complete objects of its arrays."""
    text = (answer or "").strip()
    for fence in ("```json", "```"):
        text = text.removeprefix(fence)
    text = text.removesuffix("```").strip()
    lo, hi = text.find("{"), text.rfind("}")
    inner = text[max(lo, 0) : hi + 1 if hi >= 0 else None]
    for t in (text, inner):
        try:
            json.loads(t)
            return t
        except ValueError:
            pass
    found = {name: _complete(inner, name) for name in ANSWER_ARRAYS}
    return json.dumps(found, ensure_ascii=False) if any(found.values()) else None


def _complete(text: str, name: str) -> list:
    """The objects of a named array that are closed and parse, up to its end or the end of the text."""
    start = re.search(rf'"{re.escape(name)}"\s*:\s*\[', text)
    out, opened = [], []
    for m in _TOKEN.finditer(text, start.end()) if start else ():
        if m[0] == "{":
            opened.append(m.start())
        elif m[0] == "}" and opened:
            lo = opened.pop()
            if not opened:
                try:
                    out.append(json.loads(text[lo : m.end()]))
                except ValueError:
                    pass
        elif m[0] == "]" and not opened:
            break
    return out


def repaired(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, answer): each text repaired, null if nothing can be kept."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], "answer": p[text].map(repair)})

    return answers.select(key, text).mapInPandas(run, f"{key} {answers.schema[key].dataType.simpleString()}, answer string")
