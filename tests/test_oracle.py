"""Every query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillgraph import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    """Queries without SQL are executed; their operators have brute-force tests."""
    assert registry.queries()[name](spark, DATA).toPandas().shape[1] > 0


def test_whole_pattern_table(spark):
    """All patterns against the regex library of Java's rules: matches as Python's re finds them on texts of ASCII."""
    import re

    from quillgraph.functions import patterns as P

    rows = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if r.text and r.text.isascii()]
    got = {}
    for r in registry.queries()["regex_find_all_patterns"](spark, DATA).collect():
        got.setdefault(r.doc_id, []).append((r.name, r.match))
    for r in rows:
        want = [(n, m.group(0)) for _, n, _, p in P.PATTERNS for m in re.finditer(p, r.text, re.I)]
        assert sorted(got.get(r.doc_id, [])) == sorted(want)


def test_redaction_and_spans(spark):
    """``redact_pii`` and ``regex_spans`` as plain Python applies the pattern table to each whole text."""
    from quillgraph.functions import patterns as P

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in registry.queries()["redact_pii"](spark, DATA).collect():
        assert r[1] == P.redact_spans(texts[r.doc_id] or "", P.of("pii"))
    seen = {}
    for r in registry.queries()["regex_spans"](spark, DATA).collect():
        assert texts[r.doc_id][r.start : r.end] == r.match
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {k: n for k, t in texts.items() if (n := len(P.spans(t or "", P.PATTERNS)))}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
