"""Hand-built cases of the engine's own operators."""

from pyspark.sql import functions as F

from quillgraph.functions import patterns as P
from quillgraph.functions import scalars as S
from quillgraph.operators import build as B
from quillgraph.operators import communities as C
from quillgraph.operators import graph as G
from quillgraph.operators import retrieval as R
from quillgraph.operators import store as T
from quillgraph.operators import text as X
from quillgraph.sources import files
from quillgraph.streaming import streams


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src string, dst string, weight double")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_reach_stops_at_the_depth_and_keeps_seeds(spark):
    e = edges(spark, (0, 1, 1), (1, 2, 1), (2, 3, 1)).select(F.col("src"), "dst", "weight")
    assert {r.id for r in G.reach(e, ids(spark, "0"), 1).collect()} == {"0", "1"}
    assert {r.id for r in G.reach(e, ids(spark, "zz"), 3).collect()} == {"zz"}


def test_shortest_path_takes_the_heavier_edge(spark):
    got = {r.id: r for r in G.shortest_paths(edges(spark, ("A", "B", 0.9), ("A", "C", 0.1), ("C", "B", 1)), "A").collect()}
    assert got["B"].path == "A>B" and abs(got["B"].cost - 1 / 0.9) < 1e-9 and got["A"].cost == 0


def test_pagerank_star(spark):
    n, e = ids(spark, "hub", "a", "b", "c"), edges(spark, ("a", "hub", 1), ("b", "hub", 1), ("c", "hub", 1))
    got = {r.id: r["rank"] for r in C.pagerank(n, e).collect()}
    assert got["hub"] == 1.0 and got["a"] < 1


def test_betweenness_path(spark):
    got = {r.id: r.score for r in C.betweenness(ids(spark, "a", "b", "c"), edges(spark, ("a", "b", 1), ("b", "c", 1))).collect()}
    assert got["b"] == 1.0 and got["a"] == got["c"] == 0


def test_components(spark):
    n, e = ids(spark, *"abcdx"), edges(spark, ("b", "a", 1), ("c", "b", 1), ("d", "c", 1))
    assert {r.id: r.component for r in G.label_components(n, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x"}


def test_fusion(spark):
    s = lambda *rows: spark.createDataFrame(rows, "chunk_id string, score double")
    got = {r.chunk_id: round(r.final_score, 6) for r in R.fuse(s(("c1", 1.0), ("c2", 0.5)), s(("c2", 0.8)), s(("c2", 0.3), ("c3", 1.0))).collect()}
    assert got == {"c1": 0.6, "c2": 0.57, "c3": 0.1}


def test_topic_postfilter(spark):
    h = spark.createDataFrame([(1, ["Contracts"]), (2, ["torts"]), (3, None), (4, [])], "id int, topics array<string>")
    assert {r.id for r in R.topic_postfilter(h, ["contracts"]).collect()} == {1, 3}


def test_prune(spark):
    got = B.prune_low_weight(edges(spark, ("A", "B", 0.9), ("A", "C", 0.1), ("B", "C", 0.5)), 0.3, 1).collect()
    assert {(r.src, r.dst) for r in got} == {("A", "B"), ("B", "C")}


def test_dangling(spark):
    n = ids(spark, "a", "b")
    assert B.prune_dangling(edges(spark, ("a", "b", 1), ("a", "z", 1)), n).count() == 1
    h = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "fake"]), (3, [])], "edge_id int, participants array<string>")
    assert [r.edge_id for r in B.prune_dangling_hyper(h, n).collect()] == [1]


def test_keys_and_labels(spark):
    row = spark.createDataFrame([("A", "cited", "B", "2024")], "source string, predicate string, target string, time string")
    cols = {c: F.col(c) for c in row.columns}
    one = lambda c: row.select(c.alias("x")).first().x
    assert one(S.compile_key("{source}|{predicate}|{target}@{time}", cols)) == "A|cited|B@2024"
    assert one(S.compile_key("{source}|{predicate}|{target}@{gone}", cols)) == "A|cited|B"
    assert one(S.compile_label("{name} ({entity_type})", {"name": F.lit("Alice")})) == "Alice (Alice)"


def test_names(spark):
    row = spark.createDataFrame([("  Ápple,  Inc. ",)], "x string")
    assert row.select(S.normalize_name(F.col("x"))).first()[0] == "ápple inc"
    assert row.select(S.normalize_name(F.col("x"), True)).first()[0] == "pple inc"


def test_running_mean(spark):
    r = spark.createDataFrame([("k", 1, 0.8), ("k", 2, 0.6)], "k string, s int, v double")
    assert abs(B.running_mean(r, "k", "s", "v").first().confidence - 0.7) < 1e-12


def test_ontology(spark):
    e = spark.createDataFrame([("Alice", "PERSON", 0.9), ("", "PERSON", 0.9), ("X", "person", 0.9), ("Y", "LOCATION", 0.1)], "n string, t string, c double")
    assert [r[0] for r in e.select(B.entity_problem(F.col("n"), F.col("t"), F.col("c"), 0.5)).collect()] == [None, "EmptyEntityName", "UnknownEntityType", "ConfidenceBelowThreshold"]


def test_redaction_resolves_overlaps():
    got = P.redact_spans("mail a.b@c.org or 555-123-4567 now", P.of("pii"))
    assert got == "mail [REDACTED-EMAIL_ADDRESS] or [REDACTED-PHONE_NUMBER] now"


def test_patterns_on_literals():
    want = {"URL": "https://a.b/c", "POSTAL_CODE": "12345-6789", "FILE_HASH": "d" * 32, "SSN": "123-45-6789", "MONEY": "$5,000"}
    for label, text in want.items():
        assert any(s[2] == label and s[3] == text for s in P.spans(f"x {text} y", P.PATTERNS)), label


def test_chunks():
    parts = X.split_text("word " * 200, 500, 50)
    assert 2 <= len(parts) <= 3 and all(0 < len(p) <= 500 for p in parts)
    assert X.split_text("", 10, 2) == [] and X.split_text("   ", 10, 2) == []


def test_pages(spark):
    d = spark.createDataFrame([(1, "\n".join(map(str, range(250)))), (2, "")], "doc_id int, text string")
    assert {(r.doc_id, r.page) for r in X.markdown_pages(d).collect()} == {(1, 1), (1, 2), (1, 3), (2, 1)}


def test_log(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "upsert", "x"), ("a", 3, "delete", None), ("b", 2, "upsert", "y"), (None, 4, "upsert", "z")], "id string, sequence long, op string, payload string")
    T.append_log(rows.withColumnRenamed("sequence", "at").repartition(3), str(tmp_path / "log"), "at", 7)
    back = T.read_log(spark, str(tmp_path / "log"), "id string, at long, sequence long, timestamp long, op string, payload string")
    assert sorted((r["at"], r.sequence, r.timestamp > 0) for r in back.collect()) == [(1, 7, True), (2, 8, True), (3, 9, True), (4, 10, True)]
    assert [(r.id, r.payload) for r in T.replay(back).collect()] == [("b", "y")]


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, s int")
    assert {tuple(r) for r in T.upsert(old, new, "id", "s").collect()} == {(1, "a"), (2, "d"), (3, "e")}


def test_paths(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert files.path_problem(str(tmp_path / "a.txt"), [str(tmp_path)]) is None
    assert files.path_problem(str(tmp_path / ".." / "b"), [str(tmp_path)]) == "PathTraversal"
    assert files.path_problem(str(tmp_path / ".env"), [str(tmp_path)]) == "InvalidPath"


def test_scan(spark, tmp_path):
    for n in ("a.md", "b.exe", "c.HTML"):
        (tmp_path / n).write_text("x")
    assert {r.kind for r in files.scan_folder(spark, str(tmp_path)).collect()} == {"markdown", "html"}


def test_stream_registers_and_commits(spark, tmp_path):
    schema = "node string, field string, ts long, seq long, value string"
    spark.createDataFrame([("n", "f", 1, 1, "old"), ("n", "f", 5, 2, "new"), ("n", "f", 3, 3, "late")], schema).repartition(1).write.parquet(str(tmp_path / "in"))
    q = streams.registers(streams.watch(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("reg").outputMode("update").option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.value for r in spark.table("reg").collect()] == ["new"]
    streams.commit_batches(streams.watch(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "s2"), "node", "seq")
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out" / "v0")).collect()] == ["late"]


def test_extraction_and_citations_reach_the_end_of_a_text(spark, tmp_path):
    from quillgraph import registry

    long = "plain words. " * 2000 + "Zorvan met Quillo in [2020] SGCA 77."
    spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert [x.name for x in run("extract_from_chunk") if x.name == "Zorvan"] == ["Zorvan"]
    assert [(x.source, x.target) for x in run("two_stage_extract")] == [("Zorvan", "Quillo")]
    assert any("[2020] SGCA 77" in x.match for x in run("citation_tags") if x.doc_id == 1)


def test_approximate_search_answers_every_twentieth_row(spark, tmp_path, monkeypatch):
    import numpy as np

    from quillgraph import registry
    from quillgraph.operators import ivf, pq

    monkeypatch.setattr(ivf, "BLOCK", 50)
    monkeypatch.setattr(ivf, "QUERIES", 4)
    monkeypatch.setattr(pq, "BLOCK", 50)
    r = np.random.default_rng(3)
    v = (r.normal(size=(8, 16)) * 4)[r.integers(0, 8, 400)] + r.normal(size=(400, 16))
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["ann_rebuild"](spark, str(tmp_path)).collect()
    assert {x.query_id for x in got} == set(range(0, 400, 20)) and len(got) == 200
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    best = {q: set(np.argsort(-(u @ u[q]))[:10].tolist()) for q in range(0, 400, 20)}
    share = {q: len(best[q] & {x.vec_id for x in got if x.query_id == q}) / 10 for q in best}
    assert all(abs(x.recall - share[x.query_id]) < 1e-9 for x in got) and sum(share.values()) / 20 >= 0.9


def test_centrality_and_communities_take_the_whole_graph(spark, tmp_path):
    """Two suppliers of one part: it lies between them, and no node is left out; betweenness against path counting."""
    from itertools import combinations

    from quillgraph import registry
    from quillgraph.sources import domain as D

    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0), (1, "M", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double", [(1, "C", 0, 1.0)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(1, "S", 0, 1.0), (2, "T", 1, 1.0)]),
        "part": ("p_partkey long, p_name string, p_retailprice double", [(1, "P", 1.0), (2, "Q", 1.0)]),
        "lineitem": ("l_suppkey long, l_partkey long", [(1, 1), (2, 1), (2, 2)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    names = {x.id for x in D.nodes(spark, str(tmp_path)).collect()}
    near = {v: set() for v in names}
    for e in D.edges(spark, str(tmp_path)).collect():
        near[e.src].add(e.dst)
        near[e.dst].add(e.src)

    def shortest(a, b):
        paths = [[a]]
        while paths and not (done := [p for p in paths if p[-1] == b]):
            paths = [[*p, w] for p in paths for w in near[p[-1]] if w not in p]
        return done

    raw = dict.fromkeys(names, 0.0)
    for a, b in combinations(sorted(names), 2):
        found = shortest(a, b)
        for p in found:
            for v in p[1:-1]:
                raw[v] += 1 / len(found)
    got = {x.id: x.score for x in registry.queries()["betweenness"](spark, str(tmp_path)).collect()}
    assert got == {v: round(x / max(raw.values()), 6) for v, x in raw.items()} and got["p:1"] > 0
    group = {x.id: x.community for x in registry.queries()["louvain"](spark, str(tmp_path)).collect()}
    assert set(group) == names and group["p:2"] == group["s:2"]


def test_numbers_have_no_gap(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"))
    got = [(r.k, r.sequence) for r in T.numbered(rows, "k", 10).collect()]
    assert [s for _, s in sorted(got)] == list(range(10, 5010))


def test_repair():
    assert X.repair('```json\n{"a": 1}\n```') == '{"a": 1}' and X.repair('so: {"a": [1]} ok') == '{"a": [1]}'
    cut = '{"topics": [{"n": "a } b", "k": {"x": [1, 2]}}, {"n": "c"}, {"n": "un'
    assert X.repair(cut) == '{"topics": [{"n": "a } b", "k": {"x": [1, 2]}}, {"n": "c"}], "entity_topic_links": []}'
    assert X.repair('{"topics": [{bad}, {"n": 1}], "entity_topic_links": [{"e": 2}], oh') == '{"topics": [{"n": 1}], "entity_topic_links": [{"e": 2}]}'
    assert X.repair(None) is None and X.repair("nothing") is None and X.repair('{"topics": [') is None


def test_garbage(spark):
    long = "plain words " * 20
    rows = [(1, None), (2, "short"), (3, long), (4, long + "?Identity-H " * 10), (5, long + "?Identity-H " * 11), (6, "?" * 90 + "x" * 100), (7, long + "?Unimplemented" * 11), (8, long + "Identity-H Unimplemented" * 11)]
    d = spark.createDataFrame(rows, "k int, t string")
    assert {r.k for r in d.where(S.looks_like_garbage(F.col("t"))).collect()} == {1, 2, 5, 6, 7, 8}


def test_span_positions(spark):
    rows = [("aaa", "aa"), ("xabab.ab", "ab"), ("", "a"), ("abc", ""), ("a.b", "."), (None, "a"), ("q\\Ez\\E", "\\E"), ("é🙂é", "é")]
    got = [r.p for r in spark.createDataFrame(rows, "t string, s string").select(X.span_positions(F.col("t"), F.col("s")).alias("p")).collect()]
    assert got == [[1, 2], [2, 4, 7], [], [], [2], [], [2, 5], [1, 3]]


def test_merged_nodes_and_edges(spark):
    schema = "dedup_key string, id string, description string, aliases array<string>, display_label string, confidence double, properties map<string,string>"
    e = spark.createDataFrame([("k", "e1", "same", ["a"], None, 0.4, {"x": "1"}), ("only", "e2", None, None, None, 0.1, None)], schema)
    i = spark.createDataFrame([("k", "i1", "same", ["b", "a"], "L", 0.8, {"x": "2", "y": "3"}), ("new", "i2", "d", ["c"], "M", 0.2, {})], schema)
    got = {r.dedup_key: r for r in B.merge_nodes(e, i).collect()}
    k = got["k"]
    assert (k.id, k.description, k.aliases, k.display_label, k.properties) == ("e1", "same | same", ["a", "b"], "L", {"x": "1", "y": "3"}) and abs(k.confidence - 0.6) < 1e-12
    assert got["only"].id == "e2" and got["new"].description == "d"
    assert {r.dedup_key: (r.id, r.display_label) for r in B.merge_nodes(e, i, "keep_last").collect()} == {"k": ("e1", "L"), "only": ("e2", None), "new": ("i2", "M")}
    assert {r.dedup_key: r.description for r in B.merge_nodes(e, i, "keep_first").collect()} == {"k": "same", "only": None, "new": "d"}


def test_resolved_merge_is_an_ordered_fold(spark):
    canonical = spark.createDataFrame([("n", 0.5, ["a"], "long enough"), ("m", 0.3, [], None)], "id string, confidence double, aliases array<string>, description string")
    rows = [("n", 2, "b", ["a", "c"], 0.9, "the longest of all"), ("n", 1, "a", None, 0.1, "short"), ("n", 3, "d", ["b"], 0.7, "another as long 18")]
    got = {r.id: r for r in B.merge_resolved(canonical, spark.createDataFrame(rows, "id string, s int, name string, aliases array<string>, confidence double, description string"), "s").collect()}
    assert abs(got["n"].confidence - (((0.5 + 0.1) / 2 + 0.9) / 2 + 0.7) / 2) < 1e-12
    assert got["n"].aliases == ["a", "b", "c", "d"] and got["n"].description == "the longest of all" and tuple(got["m"]) == ("m", 0.3, [], None)


def test_search_modes(spark):
    import pytest

    channel = lambda *rows: spark.createDataFrame(list(rows), "chunk_id long, score double")
    v, k, g = channel((1, 0.9), (2, 0.5)), channel((2, 0.8)), channel((3, 1.0))
    final = lambda df: {r.chunk_id: round(r.final_score, 6) for r in df.collect()}
    assert final(R.search(v, k, g)) == {1: 0.54, 2: 0.54, 3: 0.1} and final(R.search(v, k, g, "keyword")) == {2: 0.8} and final(R.search(v, None, g, "keyword")) == {}
    assert final(R.search(v, None, None)) == {1: 0.54, 2: 0.3} and final(R.search(v, k, g, "graph")) == {3: 1.0}
    with pytest.raises(ValueError):
        R.search(v, k, g, "other")


def test_reach_without_bound(spark):
    e = edges(spark, *[(f"n{i}", f"n{i + 1}", 1) for i in range(12)], ("n12", "n0", 1), ("x", "y", 1))
    assert {r.id: r.hop for r in G.reach(e, ids(spark, "n3"), None).collect()} == {f"n{(3 + k) % 13}": k for k in range(13)}
    assert max(r.hop for r in G.reach(e, ids(spark, "n3"), None, directed=False).collect()) == 6
    links = spark.createDataFrame([("n3", 1), ("n4", 1), ("n5", 2), ("x", 3)], "node string, chunk long")
    assert {r.chunk_id: r.score for r in R.graph_channel(e, links, ids(spark, "n3")).collect()} == {1: 1.0, 2: 1 / 3}


def test_betweenness_and_louvain_against_plain_code(spark):
    """On a small graph: betweenness by counting all shortest paths, communities of two cliques with a bridge."""
    from itertools import combinations

    pairs = [*combinations("abcd", 2), *combinations("efgh", 2), ("d", "e")]
    names = "abcdefghz"
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in names}

    def paths(s, t):
        level, found = [[s]], []
        while level and not found:
            level = [[*p, w] for p in level for w in near[p[-1]] if w not in p]
            found = [p for p in level if p[-1] == t]
        return found

    raw = dict.fromkeys(names, 0.0)
    for s in names:
        for t in names:
            if s != t and (ps := paths(s, t)):
                for p in ps:
                    for v in p[1:-1]:
                        raw[v] += 1 / len(ps)
    n = ids(spark, *names)
    got = {r.id: r.score for r in C.betweenness(n, edges(spark, *[(a, b, 1) for a, b in pairs])).collect()}
    top = max(raw.values())
    assert all(abs(got[v] - raw[v] / top) < 1e-9 for v in names)
    one = n.withColumn("collection_id", F.lit(1)), edges(spark, *[(a, b, 1) for a, b in pairs]).withColumn("collection_id", F.lit(1))
    groups = {r.id: r.community for r in C.louvain(*one).collect()}
    assert len({groups[v] for v in "abcd"}) == 1 and len({groups[v] for v in "efgh"}) == 1 and len(set(groups.values())) == 3


def test_templates(spark):
    from quillgraph.operators import templates

    cols = "name type mode method merge_nodes merge_edges entity_key entity_label entity_fields relation_key relation_fields has_identifiers".split()
    good = dict(zip(cols, ["t", "graph", None, None, None, None, "{a}", "{a}", ["a"], "{b}", ["b"], True], strict=True))
    cases = [
        ({}, [], []), ({"type": "list", "entity_key": None, "relation_key": None, "has_identifiers": None}, [], ["incompatible"]), ({"method": "light_rag"}, [], ["not_implemented"]),
        ({"name": None, "type": "tree"}, ["name", "type"], []), ({"mode": "x", "method": "y", "merge_nodes": "z", "merge_edges": "z"}, ["mode", "method", "merge_strategy_nodes", "merge_strategy_edges"], []),
        ({"entity_key": "a", "entity_label": "a}", "relation_key": "{b"}, ["entity_key", "display_label", "relation_key"], []), ({"entity_fields": ["a", "a"]}, ["entity_fields"], []),
        ({"entity_key": None, "relation_key": None, "has_identifiers": False}, ["entity_schema", "relation_schema", "identifiers"], []),
    ]
    schema = ", ".join(f"{c} {'array<string>' if c.endswith('fields') else 'boolean' if c == 'has_identifiers' else 'string'}" for c in cols) + ", k int"
    rows = [(*(good | change).values(), k) for k, (change, _, _) in enumerate(cases)]
    got = {r.k: r for r in templates.validate(spark.createDataFrame(rows, schema)).collect()}
    assert [(got[k].errors, got[k].warnings, got[k].valid) for k in range(len(cases))] == [(e, w, not e) for _, e, w in cases]


def test_ancestors(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")], "t string, p string")  # with a cycle
    got = {tuple(r) for r in B.ancestors(spark.createDataFrame([("a",), ("d",), ("x",)], "t string"), parents).collect()}
    assert got == {("a", u) for u in "abc"} | {("d", u) for u in "dcab"} | {("x", "x")}


def test_linked_chunks_of_a_shared_label(spark):
    """Very many nodes and chunks under one keyword cost a list for the keyword, not their product."""
    from quillgraph.operators import graph as G

    nodes = spark.range(40_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 39_999, "Same").otherwise("own").alias("label"), F.array(F.lit(7), F.lit(3), F.lit(7)).alias("source_chunk_ids"))
    tagged = spark.range(40_000).select(F.lit("SAME").alias("keyword"), (F.lit(50_000) - F.col("id")).cast("int").alias("chunk"))
    got = G.linked_chunks(nodes, tagged).select("label", "chunks").distinct().collect()
    assert {r.label: r.chunks for r in got} == {"Same": list(range(10_001, 10_201)), "own": [3, 7]}
