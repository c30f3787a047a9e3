"""Scalar column functions: names, keys, scores, text measures. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(x: Column, ascii_only: bool = False) -> Column:
    """Lower case, letters, digits and single spaces only; ``ascii_only`` drops other letters too."""
    drop = r"[^a-z0-9\s]" if ascii_only else r"[^\p{L}\p{N}\s]"
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), drop, ""), r"\s+", " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length or the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v)


def bm25_ratio(score: Column) -> Column:
    return score / (score + 1)


def bm25_tanh(score: Column) -> Column:
    return F.tanh(score / 10)


def vector_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def hop_score(hop: Column) -> Column:
    return F.lit(1.0) / (hop + 1)


def edge_cost(weight: Column) -> Column:
    return F.lit(1.0) / F.greatest(weight, F.lit(0.001))


def cooccurrence_weight(n: Column) -> Column:
    return F.least(n / 10.0, F.lit(1.0))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def compile_key(pattern: str, columns: dict[str, Column]) -> Column:
    """``{field}`` placeholders filled in; missing ones empty; trailing ``@`` and ``|`` stripped."""
    return F.regexp_replace(_filled(pattern, columns, F.lit("")), r"[@|]+$", "")


def compile_label(pattern: str, columns: dict[str, Column]) -> Column:
    """As ``compile_key``, missing values falling back to name, label, then "unknown"."""
    fallback = F.coalesce(*[columns[c] for c in ("name", "label") if c in columns], F.lit("unknown"))
    return _filled(pattern, columns, fallback)


def _filled(pattern: str, columns: dict[str, Column], missing: Column) -> Column:
    parts = []
    for literal, field in re.findall(r"([^{]+)|\{(\w+)\}", pattern):
        parts.append(F.lit(literal) if literal else F.coalesce(columns.get(field, F.lit(None).cast("string")).cast("string"), missing))
    return F.concat(*parts)


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def slug(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit(" "), F.lit("_"))


UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def doc_title(title: Column, path: Column) -> Column:
    """The file's name where the title is only an identifier."""
    return F.when(title.rlike(UUID), F.substring_index(path, "/", -1)).otherwise(title)


def file_type(path: Column) -> Column:
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return (
        F.when(ext == "pdf", "pdf").when(ext == "docx", "docx").when(ext.isin("md", "markdown"), "markdown")
        .when(ext == "txt", "text").when(ext.isin("html", "htm"), "html").when(ext == "rst", "rst").otherwise("unknown")
    )


TAGS = "array<struct<label:string,text:string,start:int,end:int,score:double>>"


def parse_tags(json: Column) -> Column:
    """Malformed or missing tags are no tags."""
    return F.coalesce(F.from_json(json, TAGS), F.array().cast(TAGS))


def chunk_hash(ids: Column) -> Column:
    return F.sha1(F.array_join(F.array_sort(ids), "|"))


def truncate_context(text: Column, limit: int = 24_000, marker: str = "\n...[truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


# What a failed extraction leaves, and how often at most.
GARBAGE_MARKS, MOST_MARKS = ("?Identity-H", "Identity-H Unimplemented", "?Unimplemented"), 10


def looks_like_garbage(text: Column) -> Column:
    """No text, under 100 characters, a mark of a failed extraction more than ten times, or over 40 % question marks."""
    drop = lambda m: F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))
    often = [drop(m) > MOST_MARKS * len(m) for m in GARBAGE_MARKS]
    return text.isNull() | (F.length(text) < 100) | often[0] | often[1] | often[2] | (drop("?") > 0.4 * F.length(text))


# The known entity types and edge types, in lower case.
ENTITY_TYPES = ("person", "organization", "location", "concept", "event", "document", "chunk", "topic")
EDGE_TYPES = ("works_at", "located_in", "mentions", "related_to", "part_of", "contains", "co_occurrence", "belongs_to_topic")


def parse_type(x: Column, known: tuple[str, ...]) -> Column:
    """A known type in lower case, anything else as it is."""
    return F.when(F.lower(x).isin(*known), F.lower(x)).otherwise(x)
