"""Tags of chunks against plain sequential rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import patterns as P
from quillgraph.operators import tagging as T

SPANS = "array<struct<label:string,text:string,score:double>>"


def offsets(text, span):
    out, at = [], text.find(span)
    while at >= 0:
        out.append((at, at + len(span)))
        at = text.find(span, at + 1)
    return out


def placed(text, spans, labels):
    out = []
    for label, span, score in spans:
        span = (span or "").strip(" ")
        score = 0.8 if score is None else score
        if not span or not label or labels and label not in labels:
            continue
        found = offsets(text, span) or offsets(text.lower(), span.lower())
        out += [(label, span, a, b, score) for a, b in found] or [(label, span, -1, -1, score * 0.7)]
    return out


def joined(first, second):
    kept = list(first)
    for t in second:
        if not any(t[2] >= 0 and h[2] >= 0 and t[2] < h[3] and h[2] < t[3] for h in kept):
            kept.append(t)
    return sorted(kept, key=lambda t: t[2] if t[2] >= 0 else 1e9)


def cited(text):
    seen, out = set(), []
    for p, exact in P.CITATIONS:
        for m in re.finditer(p, text, re.ASCII if exact else re.I | re.ASCII):
            if m.span() not in seen:
                seen.add(m.span())
                out.append(("CASE_CITATION", m.group(0).strip(), *m.span(), 0.95))
    return sorted(out, key=lambda t: (t[2], t[3]))


def named(text, names):
    hits = []
    low = text.lower()
    for name, label in names.items():
        for a, b in offsets(low, name):
            if (a == 0 or not (low[a - 1].isalnum() and low[a].isalnum())) and (b == len(low) or not (low[b].isalnum() and low[b - 1].isalnum())):
                hits.append((a, -b, label))
    out, end = [], 0
    for a, b, label in sorted(hits):
        if a >= end:
            end = -b
            out.append((label, text[a:end], a, end, 1.0))
    return out


WORDS = ["Acme", "acme", "Acme Corp", "aa", "aaa", "Ana", "bank", "Bank of Ana", "x", "[2020] SGCA 12", "(2001) 3 SLR 45", "[2019] 2 AC 7", "(1999) 4 ABC 1", "née", "É", "a.b", "\\E$"]


def cases(seed, n):
    r = random.Random(seed)
    for k in range(n):
        text = r.choice([" ", "  ", ""]).join(r.choice(WORDS) for _ in range(r.randint(0, 25))) if k % 11 else r.choice([None, ""])
        spans = [(r.choice(["LAW", "COURT", "OTHER", None, ""]), r.choice([*WORDS, "ACME", " bank ", "not there", "", None]), r.choice([0.5, 1.0, None])) for _ in range(r.randint(0, 5))]
        yield k, text, spans if k % 7 else None


def plain(tags):
    return [(t.label, t.text, t.start, t.end, pytest.approx(t.score)) for t in tags]


def test_spans_merge_and_citations(spark):
    rows = list(cases(1, 300))
    df = spark.createDataFrame(rows, f"doc_id long, text string, spans {SPANS}").repartition(3)
    labels = ["LAW", "COURT"]
    for r in df.select("doc_id", T.resolved(F.col("text"), F.col("spans"), labels).alias("one"), T.citation_tags(F.col("text")).alias("two"), T.merged(T.resolved(F.col("text"), F.col("spans")), T.resolved(F.col("text"), F.reverse("spans"))).alias("three")).collect():
        _, text, spans = rows[r.doc_id]
        text, spans = text or "", spans or []
        assert [tuple(t) for t in r.one] == plain_want(placed(text, spans, labels))
        assert [tuple(t) for t in r.two] == cited(text)
        assert [tuple(t) for t in r.three] == plain_want(joined(joined([], []) + placed(text, spans, None), placed(text, spans[::-1], None)))


def plain_want(tags):
    return [(a, b, s, e, pytest.approx(x)) for a, b, s, e, x in tags]


@pytest.mark.parametrize("block", [200_000, 3])
def test_names_and_whole_chunks(spark, monkeypatch, block):
    monkeypatch.setattr(T, "NAMES", block)
    rows = list(cases(2, 200))
    names = {"acme": "ORG", "acme corp": "ORG", "ana": "PERSON", "bank of ana": "ORG", "bank": "ORG", "aa": "X", "née": "Y", "é": "Z"}
    df = spark.createDataFrame(rows, f"doc_id long, text string, spans {SPANS}").repartition(3)
    given = spark.createDataFrame([(f" {k.upper()} ", v) for k, v in names.items()] + [("", "Q"), (None, "Q"), ("acme", "ZZZ")], "name string, label string")
    found = T.mentions(df, given)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.label, r.text, r.start, r.end, r.score))
    want = {k: w for k, t, _ in rows if (w := named(t or "", names))}
    assert {k: sorted(v, key=lambda t: t[2]) for k, v in got.items()} == want
    for r in T.tag_chunks(df, found).collect():
        _, text, spans = rows[r.doc_id]
        text = text or ""
        assert [tuple(t) for t in r.tags] == plain_want(joined(joined(named(text, names), placed(text, spans or [], None)), cited(text)))
    assert T.tag_chunks(df.where("false"), found).count() == 0 == T.mentions(df, given.where("false")).count()


def test_topics_go_to_labels_and_aliases(spark):
    nodes = spark.createDataFrame([("a", " Acme ", ["ACME Corp"], ["t1"]), ("b", "Bank", None, None), ("c", "acme corp", [], ["t2", "t1"]), ("d", None, [None, "x"], ["t9"])], "id string, label string, aliases array<string>, topics array<string>")
    links = spark.createDataFrame([("t2", "acme corp "), ("t1", "ACME"), ("t3", "BANK"), ("t3", "bank"), ("t4", ""), (None, "bank"), ("t5", None), ("t9", "X")], "topic string, entity string")
    got = {r.id: r.topics for r in T.propagate_topics(nodes, links).collect()}
    assert got == {"a": ["t1", "t2"], "b": ["t3"]}


def test_model_labels(spark):
    df = spark.createDataFrame([("ORG",), ("LOC",), ("FAC",), ("GPE",), ("TIME",), ("CARDINAL",), (None,)], "label string")
    assert [r[0] for r in df.select(T.canonical(F.col("label"))).collect()] == ["ORGANIZATION", "LOCATION", "LOCATION", "LOCATION", "DATE", None, None]
