"""Paths between two nodes against all paths of small graphs."""

import random

import pytest

from quillgraph.operators import paths


def table(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src string, dst string, weight double")


def cheapest(rows, s, t, depth):
    """Cost of the cheapest walk of at most ``depth`` edges, by dynamic programming."""
    cost = {s: 0.0}
    for _ in range(depth):
        new = dict(cost)
        for a, b, w in rows:
            if a in cost and cost[a] + 1 / max(w, 0.001) < new.get(b, 1e18):
                new[b] = cost[a] + 1 / max(w, 0.001)
        cost = new
    return cost.get(t)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("depth", [3, 10])
def test_cheapest(spark, seed, depth):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(25)]
    rows = [(r.choice(names), r.choice(names), r.choice([0.1, 0.2, 0.5, 0.9, 1.0])) for _ in range(60)]
    for s, t in [("n0", "n7"), ("n3", "n20")]:
        got = paths.cheapest_path(table(spark, rows), s, t, depth).orderBy("step").collect()
        want = cheapest(rows, s, t, depth)
        assert (want is None) == (not got)
        if got:
            nodes, es = [x.id for x in got[::2]], got[1::2]
            assert [x.kind for x in got] == ["node", "edge"] * len(es) + ["node"] and nodes[0] == s and nodes[-1] == t and len(es) <= depth
            assert [(x.src, x.dst) for x in es] == list(zip(nodes, nodes[1:], strict=False))
            assert abs(sum(x.cost for x in es) - want) < 1e-9
            assert all(any((a, b) == (x.src, x.dst) and abs(1 / max(w, 0.001) - x.cost) < 1e-9 for a, b, w in rows) for x in es)


def test_between(spark):
    r = random.Random(5)
    names = [f"n{i}" for i in range(30)]
    rows = [(r.choice(names[:26]), r.choice(names[:26]), 1) for _ in range(32)]
    near = {v: {b if a == v else a for a, b, _ in rows if v in (a, b)} - {v} for v in names}
    for s, t in [("n0", "n9"), ("n1", "n29"), ("n4", "n25"), ("n2", "n2")]:
        dist, front = {s: 0}, [s]
        while front:
            front = [w for v in front for w in near[v] if w not in dist and not dist.update({w: dist[v] + 1})]
        got = paths.path_between(table(spark, rows), s, t).orderBy("step").collect()
        assert len(got) == (2 * dist[t] + 1 if t in dist else 0)
        nodes = [x.id for x in got[::2]]
        assert all(b in near[a] for a, b in zip(nodes, nodes[1:], strict=False))


def test_heavier_edges_are_nearer_and_depth_counts(spark):
    rows = [("A", "B", 0.5), ("B", "D", 0.5), ("A", "C", 0.9), ("C", "D", 0.9), ("A", "D", 0.1)]
    ids = lambda depth: [x.id for x in paths.cheapest_path(table(spark, rows), "A", "D", depth).orderBy("step").collect() if x.kind == "node"]
    assert ids(10) == ["A", "C", "D"] and ids(1) == ["A", "D"]
    assert paths.cheapest_path(table(spark, rows), "D", "A").count() == 0
    assert paths.cheapest_path(table(spark, rows).where("false"), "A", "D").count() == 0
