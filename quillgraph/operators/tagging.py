"""Tags of chunks: names found by an automaton, spans of a model placed in their text, citations, and their merge."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import patterns as P
from quillgraph.operators.text import span_positions
from quillgraph.session import steps

TAG = "struct<label:string,text:string,start:int,end:int,score:double>"
_TAGS = f"array<{TAG}>"
# A model's labels and what they are called here; other labels are dropped.
MODEL_LABELS = {
    "PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "DATE": "DATE", "TIME": "DATE", "MONEY": "MONEY",
    "PERCENT": "PERCENT", "LAW": "LAW", "NORP": "ORGANIZATION",
}
#: Names in one automaton; more names are scanned for in several passes.
NAMES = 200_000
#: Tags that a task holds before it passes them on.
HELD = 20_000


def tag(label: Column, text: Column, start: Column, end: Column, score: Column) -> Column:
    return F.struct(label.alias("label"), text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"))


def canonical(label: Column) -> Column:
    """A model's label as it is called here, or null."""
    out = F.lit(None).cast("string")
    for raw, name in MODEL_LABELS.items():
        out = F.when(label == raw, name).otherwise(out)
    return out


def resolved(text: Column, spans: Column, labels: list[str] | None = None) -> Column:
    """Tags of a model's spans (label, text, score) at all their places in ``text``.

    A span is placed wherever its trimmed text stands, occurrences that overlap included; if it stands nowhere, wherever it
    stands regardless of case; if not even there, at (-1, -1) with 0.7 of its score. Spans without text or label, and with
    labels not in ``labels``, go. A null text has no occurrences.
    """
    whole = F.coalesce(text, F.lit(""))
    known = lambda s: (F.trim(s["text"]) != "") & (s["label"].isin(labels) if labels else F.coalesce(s["label"], F.lit("")) != "")

    def placed(s: Column) -> Column:
        span = F.trim(s["text"])
        size, score = F.length(span), F.coalesce(s["score"], F.lit(0.8))
        exact = span_positions(whole, span)
        found = F.when(F.size(exact) > 0, exact).otherwise(span_positions(F.lower(whole), F.lower(span)))
        at = F.transform(found, lambda p: tag(s["label"], span, p - 1, p - 1 + size, score))
        return F.when(F.size(found) > 0, at).otherwise(F.array(tag(s["label"], span, F.lit(-1), F.lit(-1), score * 0.7)))

    return F.coalesce(F.flatten(F.transform(F.filter(spans, known), placed)), F.array().cast(_TAGS))


def merged(first: Column, second: Column) -> Column:
    """All tags of ``first``, and of ``second``, in its order, those that overlap nothing kept so far; by start, unplaced ones last.

    Unplaced tags overlap nothing. ``second`` may overlap itself. The work grows with the square of one chunk's tags.
    """
    none = F.array().cast(_TAGS)
    clash = lambda a, b: (a["start"] >= 0) & (b["start"] >= 0) & (a["start"] < b["end"]) & (b["start"] < a["end"])
    keep = F.aggregate(F.coalesce(second, none), F.coalesce(first, none).cast(_TAGS), lambda held, t: F.when(F.exists(held, lambda h: clash(t, h)), held).otherwise(F.concat(held, F.array(t))))
    placed = F.transform(keep, lambda t, k: F.struct(F.when(t["start"] >= 0, t["start"]).otherwise(2**31 - 1).alias("at"), k.alias("k"), t.alias("t")))
    return F.transform(F.array_sort(placed), lambda x: x["t"])


def citation_tags(text: Column) -> Column:
    """Citations as tags, each span once, by start.

    A pattern's matches come in text order, and none depends on what stands around it, so each begins at the first place of its
    own text after the end of the one before.
    """
    whole, parts = F.coalesce(text, F.lit("")), []
    for pattern, exact in P.CITATIONS:
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("found"))

        def step(a: Column, m: Column) -> Column:
            s = F.position(m, whole, a["at"])
            return F.struct((s + F.length(m)).alias("at"), F.concat(a["found"], F.array(F.struct((s - 1).alias("s"), (s - 1 + F.length(m)).alias("e"), m.alias("m")))).alias("found"))

        hits = F.regexp_extract_all(whole, F.lit(("" if exact else "(?i)") + pattern), F.lit(0))
        parts.append(F.aggregate(hits, start, step, lambda a: a["found"]))
    spans = F.array_distinct(F.array_sort(F.flatten(F.array(*parts))))
    spans = F.when(F.rlike(whole, F.lit(r"[\[(]\d{4}[\])]")), spans).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))  # each begins so
    return F.transform(spans, lambda x: tag(F.lit("CASE_CITATION"), F.trim(x["m"]), x["s"], x["e"], F.lit(0.95)))


def tag_chunks(chunks: DataFrame, found: DataFrame | None = None, labels: list[str] | None = None, key: str = "doc_id", text: str = "text", spans: str = "spans", citations: bool = True) -> DataFrame:
    """key and tags (array) of each chunk: those of ``found`` (key, ``TAG`` fields; of any tagger), then the model's spans in
    the column ``spans`` where they are free, then citations where they are free."""
    rows = chunks
    given = F.array().cast(_TAGS)
    if found is not None:
        own = found.groupBy(F.col(key).alias("k_")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "text", "score"))).alias("own_"))
        rows = rows.join(own, F.col(key) == F.col("k_"), "left")
        given = F.coalesce(F.transform("own_", lambda t: tag(t["label"], t["text"], t["start"], t["end"], t["score"])), given)
    tags = merged(given, resolved(F.col(text), F.col(spans), labels))
    return rows.select(key, (merged(tags, citation_tags(F.col(text))) if citations else tags).alias("tags"))


def _lower(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _scanner(names: list[tuple[str, str]], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        find = ahocorasick.Automaton()
        for name, label in names:
            find.add_word(name, (len(name), label))
        find.make_automaton()
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0), b.column(1), strict=True):
                text = t.as_py() or ""
                low, n, hits = _lower(text), len(text), []
                for last, (size, label) in find.iter(low):
                    lo, hi = last - size + 1, last + 1
                    if (lo == 0 or not (low[lo - 1].isalnum() and low[lo].isalnum())) and (hi == n or not (low[hi].isalnum() and low[hi - 1].isalnum())):
                        hits.append((lo, -hi, label))
                end = 0
                for lo, hi, label in sorted(hits):
                    if lo >= end:
                        end = -hi
                        rows.append((k.as_py(), label, text[lo:end], lo, end))
                if len(rows) >= HELD:
                    yield _batch(rows, b.schema.field(0))
                    rows = []
            yield _batch(rows, b.schema.field(0))

    def _batch(rows: list[tuple], field: pa.Field) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], field.type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array([1.0] * len(rows), pa.float64())], names=[key, "label", "text", "start", "end", "score"])

    return run


def mentions(chunks: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, label, text, start, end, score of every name (name, label) that stands in a chunk as whole words, regardless of case;
    of overlapping ones the leftmost, then the longest.

    One automaton over all names reads each text once. Names are taken in blocks of about ``NAMES`` by hash, each a pass of its
    own; what the driver and a task hold is one block. Of labels of one name the least counts.
    """
    kind = chunks.schema[key].dataType.simpleString()
    folded = names.select(F.lower(F.trim("name")).alias("name"), "label").where("name <> ''").groupBy("name").agg(F.min("label").alias("label"))
    blocks = max(1, -(-folded.count() // NAMES))
    out = None
    for k in range(blocks):
        block = [(_lower(r.name), r.label) for r in folded.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).collect()]
        if block:
            part = chunks.select(key, text).mapInArrow(_scanner(block, key), f"{key} {kind}, label string, text string, start int, end int, score double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return chunks.sparkSession.createDataFrame([], f"{key} {kind}, label string, text string, start int, end int, score double")
    return out if blocks == 1 else _leftmost(out, key)


def _leftmost(tags: DataFrame, key: str) -> DataFrame:
    """The same choice among tags of several passes."""
    each = tags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "label", "text", "score"))).alias("ts"))
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,back:int,label:string,text:string,score:double>>").alias("kept"))
    step = lambda a, t: F.when(t["start"] >= a["end"], F.struct((-t["back"]).alias("end"), F.concat(a["kept"], F.array(t)).alias("kept"))).otherwise(a)
    kept = each.select(key, F.inline(F.aggregate("ts", first, step, lambda a: a["kept"])))
    return kept.select(key, "label", "text", "start", (-F.col("back")).alias("end"), "score")


def propagate_topics(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, topics: the nodes (id, label, aliases, topics) whose topics change when every link (topic, entity) adds its topic to
    the nodes of that label or alias, compared trimmed and in lower case. Topics come sorted; unchanged nodes are left out.

    Links are made distinct before the join, and a node's topics are gathered as distinct pairs, so a name that very many
    links or nodes share costs one row a pair.
    """
    with steps(nodes.sparkSession, nodes, links) as keep:
        norm = lambda c: F.lower(F.trim(c))
        wanted = links.select(norm(F.col("entity")).alias("name"), "topic").where("name <> '' AND topic IS NOT NULL").distinct()
        named = nodes.select("id", F.explode(F.array_distinct(F.transform(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))), norm))).alias("name"))
        got = named.join(wanted, "name").select("id", "topic").distinct().groupBy("id").agg(F.collect_list("topic").alias("new"))
        old = F.array_sort(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))))
        both = nodes.join(got, "id").select("id", old.alias("old"), F.array_sort(F.array_union(old, F.col("new"))).alias("topics"))
        return keep(both.where("topics <> old").select("id", "topics"))
