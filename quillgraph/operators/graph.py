"""Graph traversal and analytics over (src, dst, weight) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalars as S
from quillgraph.operators.store import numbered
from quillgraph.session import forget, steps, written


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None, least: float = 0.0, directed: bool = True) -> DataFrame:
    """(id, hop) within ``depth`` hops (None: any) of the seeds (id) over edges of weight ``least`` or more; seeds have hop 0.

    The edges are computed once and written; a round writes only its new frontier, and ends where there is none.
    """
    with steps(edges.sparkSession, edges) as keep:
        e = edges.where(F.col("weight") >= least).select("src", "dst")
        if not directed:
            e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        e = written(e.distinct())
        front = seen = written(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
        hop = 0
        while depth is None or hop < depth:
            hop += 1
            new = front.select(F.col("id").alias("src")).join(e, "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
            front = written(new.withColumn("hop", F.lit(hop)))
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        return keep(seen)


def subgraph(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """All edges with both ends reached."""
    ids = reached.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def filtered_nodes(nodes: DataFrame, since=None, until=None, types: list[str] | None = None, chunks: DataFrame | None = None, labelled: DataFrame | None = None, keywords: list[str] | None = None, times: str = "created_at", sources: str = "source_chunk_ids") -> DataFrame:
    """The nodes that pass every filter given: time between ``since`` and the end of the day ``until`` (dates), one of the
    entity types, a source among ``chunks`` (chunk; those of a document) and among ``labelled`` (chunk; those with a label),
    and a label that is one of the keywords whatever its case. Each chunk filter is a semi-join of (id, chunk) pairs."""
    out = nodes
    if since is not None:
        out = out.where(F.col(times) >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col(times) <= F.lit(until).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    if types is not None:
        out = out.where(F.col("entity_type").isin(types))
    if keywords is not None:
        out = out.where(F.lower("label").isin([k.lower() for k in keywords]))
    for wanted in (chunks, labelled):
        if wanted is not None:
            hit = out.select("id", F.explode(sources).alias("chunk")).join(wanted.select("chunk").distinct(), "chunk", "left_semi").select("id").distinct()
            out = out.join(hit, "id", "left_semi")
    return out


def linked_chunks(nodes: DataFrame, tagged: DataFrame, sources: str = "source_chunk_ids", most: int = 200) -> DataFrame:
    """``nodes`` with chunks (array, ascending, null if none): for each node the chunks tagged with its label (``tagged``: keyword, chunk; compared in lower
    case), or, where there are none, its source chunks; the first ``most`` of each.

    A keyword's first chunks are gathered once, before the nodes that share it are joined.
    """
    own = tagged.select(F.lower("keyword").alias("k"), "chunk").where("k IS NOT NULL").distinct()
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.asc_nulls_last("chunk")))  # tasks keep ``most`` rows a keyword before the exchange
    first = own.withColumn("r_", place).where(F.col("r_") <= most).groupBy("k").agg(F.array_sort(F.collect_list("chunk")).alias("by_tag"))
    rest = F.slice(F.array_sort(F.array_compact(F.array_distinct(sources))), 1, most)
    return nodes.withColumn("k", F.lower("label")).join(first, "k", "left").select(*nodes.columns, F.coalesce("by_tag", rest).alias("chunks"))


def batched_reach(edges: DataFrame, seeds: DataFrame, depth: int, max_degree: int, least: float = 0.0) -> DataFrame:
    """As ``reach``, each node following its first ``max_degree`` qualifying edges only, heaviest first."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    top = edges.where(F.col("weight") >= least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_degree).drop("r")
    return reach(top, seeds, depth)


def shortest_paths(edges: DataFrame, source: str, depth: int = 10) -> DataFrame:
    """(id, cost, path) of the cheapest directed paths of at most ``depth`` edges; cost 1 / weight, ties by path."""
    with steps(edges.sparkSession, edges) as keep:
        e = written(edges.select("src", "dst", S.edge_cost(F.col("weight")).alias("c")).groupBy("src", "dst").agg(F.min("c").alias("c")))
        best = written(edges.sparkSession.range(1).select(F.lit(source).alias("id"), F.lit(0.0).alias("cost"), F.lit(source).alias("path"), F.lit(0).alias("at")))
        for step in range(1, depth + 1):
            front = best.where(F.col("at") == step - 1).select(F.col("id").alias("src"), "cost", "path")
            new = front.join(e, "src").select(F.col("dst").alias("id"), (F.col("cost") + F.col("c")).alias("cost"), F.concat_ws(">", "path", "dst").alias("path"), F.lit(step).alias("at"))
            both = best.unionByName(new).groupBy("id").agg(F.min(F.struct(F.round("cost", 12).alias("k"), "path", "cost", "at")).alias("m"))
            best = written(both.select("id", "m.cost", "m.path", "m.at"))
            if best.where(F.col("at") == step).limit(1).count() == 0:
                break
        return keep(best.select("id", "cost", "path"))


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each node is linked with; distributed, for graphs of any size.

    Nodes are numbered in the order of their ids. In a round each node that has a lesser neighbour goes to the least one, such
    steps are followed to their end by doubling, and the nodes that went are contracted: half of those that are still linked
    go at least, and only the edges between different nodes that are left move on, as pairs of numbers.
    """
    with steps(nodes.sparkSession, nodes, edges) as keep:
        names = written(numbered(nodes.select("id").distinct(), "id").select("id", F.col("sequence").alias("v")))
        end = lambda side, out: names.select(F.col("id").alias(side), F.col("v").alias(out))
        links = _pairs(edges.select("src", "dst").where("src <> dst").join(end("src", "a"), "src").join(end("dst", "b"), "dst"))
        root = names.select("v", F.col("v").alias("g"))
        while not links.isEmpty():
            near = links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("up"))  # a < b
            up = written(near)
            while True:
                far = written(up.join(up.select(F.col("v").alias("up"), F.col("up").alias("top")), "up", "left").select("v", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
                moved = not far.where("moved").isEmpty()
                forget(up)
                up = far.select("v", "up")
                if not moved:
                    break
            to = lambda side, u=up: u.select(F.col("v").alias(side), F.col("up").alias(f"g{side}"))
            after = _pairs(links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")))
            forget(links)
            links = after
            root = written(root.join(up.select(F.col("v").alias("g"), "up"), "g", "left").select("v", F.coalesce("up", "g").alias("g")))
        least = names.select(F.col("v").alias("g"), F.col("id").alias("component"))
        return keep(names.join(root, "v").join(least, "g").select("id", "component"))


def _pairs(links: DataFrame) -> DataFrame:
    """Each linked pair of different nodes (a < b) once."""
    return written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line an element; a writer puts them between the document's first and last lines."""
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("k"), F.format_string('<node id="%s"><data key="label">%s</data><data key="type">%s</data></node>', F.col("id"), S.xml_escape(F.col("label")), F.col("entity_type")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.concat_ws(">", "src", "dst").alias("k"), F.format_string('<edge source="%s" target="%s"><data key="predicate">%s</data></edge>', F.col("src"), F.col("dst"), S.xml_escape(F.col("edge_type"))).alias("line"))
    return n.unionByName(e)
