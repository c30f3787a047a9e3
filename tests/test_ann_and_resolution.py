"""Product quantisation and entity resolution against comparing everything with everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import scalars as S
from quillgraph.operators import build as B
from quillgraph.operators import pq


def vectors(spark, n=600, dim=16, seed=3):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(10, dim)) * 2)[r.integers(0, 10, n)] + r.normal(size=(n, dim))
    return x.astype(np.float32), spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")


def test_codes_and_tables(spark):
    x, df = vectors(spark)
    odd = spark.createDataFrame([(9000, None), (9001, [1.0]), (9002, [None] * 16), (9003, [0.0] * 16)], "vec_id long, embedding array<float>")
    q = pq.fit(df.union(odd), 6, 4)
    assert q.cells.shape == (6, 16) and q.books.shape == (4, 256, 4) and q.bytes_a_vector == 8
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cell, code = q.encode(u)
    assert (cell == ((u[:, None] - q.cells[None]) ** 2).sum(2).argmin(1)).all()
    rest = (u - q.cells[cell]).reshape(len(u), 4, 4)
    assert all((code[:, p] == ((rest[:, p][:, None] - q.books[p][None]) ** 2).sum(2).argmin(1)).all() for p in range(4))
    close = np.concatenate([q.books[p][code[:, p]] for p in range(4)], 1) + q.cells[cell]
    assert np.allclose([q.tables(u[7], cell[k])[np.arange(4), code[k]].sum() for k in range(50)], ((u[7] - close[:50]) ** 2).sum(1))
    got = {r.vec_id: (r.cell, bytes(r.code)) for r in pq.codes(df.union(odd), q).collect()}
    assert set(got) == {*range(len(x)), 9003} and all(got[k] == (cell[k], code[k].tobytes()) for k in range(len(x)))


@pytest.mark.parametrize("block", [16_384, 60])
def test_search_and_swap(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(pq, "BLOCK", block)
    monkeypatch.setattr(pq, "QUERIES", block // 8)
    x, df = vectors(spark)
    q = pq.fit(df, 6, 4)
    path = f"{tmp_path}/index"
    pq.rebuild(df.where("vec_id < 100"), q, path)
    index = pq.rebuild(df, q, path)
    assert index.count() == len(x) and [p.name for p in tmp_path.iterdir()] == ["index"]
    with pytest.raises(Exception, match="division|DIVIDE"):
        pq.rebuild(df.withColumn("embedding", F.when(F.expr("1 / (vec_id - 5)") > -9, F.col("embedding"))), q, path)
    assert spark.read.parquet(path).count() == len(x)  # a failed build leaves the index
    queries = df.where("vec_id % 20 = 0")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    got = {}
    for r in pq.search(index, df, queries, q, 5, 3).collect():
        got.setdefault(r.query, {})[r["rank"]] = (r.vec_id, r.distance)
    right = 0
    for k in range(0, len(x), 20):
        d = np.round(1 - u @ u[k], 9)
        best = sorted(range(len(x)), key=lambda i: (d[i], i))[:5]
        right += len(set(best) & {v for v, _ in got[k].values()})
        assert sorted(got[k]) == [1, 2, 3, 4, 5] and all(abs(d[v] - f) < 1e-6 for v, f in got[k].values())
        assert [f for _, f in sorted(got[k].values(), key=lambda p: p[1])] == [got[k][n][1] for n in range(1, 6)]
    assert right >= 0.9 * 5 * len(got)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_names_within_two_edits_meet(spark):
    """Of every length, the keys of two names meet whenever they are within two edits."""
    r = random.Random(4)
    pairs = []
    for _ in range(700):
        a = "".join(r.choice("abcd ") for _ in range(r.choice([0, 1, 2, 3, 5, 9, 20, 22, 23, 24, 25, 26, 27, 28, 29, 45, 90])))
        b = list(a)
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = r.choice(["", "x", "a"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a string, b string")
    got = {x.k: x.meet for x in df.select("k", F.arrays_overlap(B._meeting(F.col("a"), True), B._meeting(F.col("b"), False)).alias("meet")).collect()}
    assert all(got[k] for k, (a, b) in enumerate(pairs) if edits(a, b) <= 2)


def test_resolution_against_all_pairs(spark):
    r = random.Random(6)
    names = ["".join(r.choice("abc") for _ in range(r.choice([3, 4, 6, 12, 26, 30]))) for _ in range(60)]
    vec = lambda: [r.choice([0.0, 1.0]), r.choice([0.0, 1.0]), 0.1]
    held = [(f"e{k}", k, n, [names[(k * 7) % 60] + " Inc"] if k % 5 == 0 else None, r.choice("XY"), vec()) for k, n in enumerate(names[:40])]
    new = []
    for k in range(150):
        n = list(r.choice(names))
        for _ in range(r.randint(0, 3)):
            n[r.randrange(len(n))] = r.choice("abcz")
        new.append((f"c{k}", "".join(n).upper() if k % 3 else "".join(n), r.choice("XY"), vec()))
    e = spark.createDataFrame(held, "id string, seq long, label string, aliases array<string>, entity_type string, embedding array<double>")
    c = spark.createDataFrame(new, "cid string, name string, entity_type string, embedding array<double>")
    norm = {x.n: x.m for x in spark.createDataFrame([(n,) for n in {*[h[2] for h in held], *[a for h in held for a in h[3] or []], *[x[1] for x in new]}], "n string").select("n", S.normalize_name(F.col("n")).alias("m")).collect()}
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    want = {}
    for cid, name, kind, v in new:
        exact = [h for h in held if norm[name] and norm[name] in {norm[h[2]], *(norm[a] for a in h[3] or [])}]
        near = [h for h in held if h[4] == kind and edits(norm[name], norm[h[2]]) <= 2 and cos(v, h[5]) > 0.92]
        want[cid] = ("exact", exact[0][0]) if exact else ("fuzzy", near[0][0]) if near else ("new", None)
    got = {x.cid: (x.outcome, x.node_id) for x in B.resolve(c, e).collect()}
    assert got == want and {o for o, _ in want.values()} == {"exact", "fuzzy", "new"}
