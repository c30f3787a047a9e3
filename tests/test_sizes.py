"""Partitions of loops follow the input; contraction of components."""

from quillgraph import session
from quillgraph.operators import graph as G


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    name = "spark.sql.shuffle.partitions"
    monkeypatch.setattr(session, "PART_INPUT", 100)
    before = spark.conf.get(name)
    with session.steps(spark, rows):
        assert int(spark.conf.get(name)) > int(before) and int(spark.conf.get(name)) >= session._size(rows) // 100
    assert spark.conf.get(name) == before


def test_components_contract(spark, monkeypatch):
    """A long path, a star and a lone node: every round leaves half of the linked nodes at most."""
    sizes, pairs = [], G._pairs
    monkeypatch.setattr(G, "_pairs", lambda links: sizes.append((out := pairs(links)).count()) or out)
    path = [(f"a{(k * 37) % 64:02}", f"a{(k * 37 + 37) % 64:02}") for k in range(63)]
    star = [(f"c{k}", "b0") for k in range(40)] + [("c1", "c1"), ("b0", "nobody")]
    ids = sorted({x for e in path + star for x in e} - {"nobody"}) + ["z"]
    got = G.label_components(spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(path + star, "src string, dst string")).collect()
    assert {r.id: r.component for r in got} == {x: {"a": "a00", "b": "b0", "c": "b0", "z": "z"}[x[0]] for x in ids} and len(got) == len(ids)
    assert sizes[-1] == 0 and len(sizes) <= 8
