"""The pattern table against DuckDB's library on texts where Java's rules differ."""

import duckdb

from quillgraph.functions import patterns as P


def test_edges_spaces_and_folds(spark):
    lei = "ABCDEFGHIJ1234567890"
    texts = [f"ü{lei} {lei}é \u017f{lei}", f"{lei[:18]}\u017f\u212a x", "12\x0bU.S.\x0b45 12 \u017ftat. 9", "DOB:\x0b1/2/1990 DOB: 1/2/1990", "Ca\u017fe No. 12:abc", "MEDICAL\x0bRECORD 1234567", "a@b.\u212a\u017f é123-45-6789", "5 Fed. Reg. 7 [2020] U\u212aSC 4", "ı123456789 İ12345", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, P.find_all(d, P.PATTERNS).collect()))
    con = duckdb.connect()
    want = [(k, n, label, m) for k, t in enumerate(texts) if t for _, n, label, p in P.PATTERNS for m in con.execute("SELECT regexp_extract_all(?, ?, 0, 'i')", [t, p]).fetchone()[0]]
    assert got == sorted(want)


def test_spans_of_letters_that_fold():
    """A pattern is left out of a text only where it can't match."""
    import re

    text = "Dı nr; Drİver's License: ABC12345 Caſe No. 12:abc a@b.org MEDıCAL RECORD 1234567 ٥٥٥-٥٥-٥٥٥٥ http://x"
    want = [(m.start(), m.end(), label, m.group(0)) for _, _, label, p in P.PATTERNS for m in re.finditer(p, text, re.I)]
    assert P.spans(text, P.PATTERNS) == sorted(want, key=lambda s: (s[0], -s[1])) and len(want) > 5


def test_few_rows_at_a_time():
    import pyarrow as pa

    from quillgraph.operators import text as X

    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["x" * 2000] * 4999 + [None])], names=["k", "t"])
    parts = list(X._some(iter([batch])))
    assert max(map(len, parts)) <= X.ROWS and [k for p in parts for k, _ in p] == list(range(5000)) and parts[-1][-1] == (4999, "")
