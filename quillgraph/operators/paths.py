"""The path between two nodes, searched from both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import scalars as S
from quillgraph.session import steps, written

_ROWS = "step int, kind string, id string, src string, dst string, cost double"


def _rows(spark: SparkSession, nodes: list[str], costs: list[float]) -> DataFrame:
    """Nodes and edges of a path in turn. A path has at most as many as the search had rounds."""
    rows = []
    for k, v in enumerate(nodes):
        rows.append((2 * k, "node", v, None, None, None))
        if k + 1 < len(nodes):
            rows.append((2 * k + 1, "edge", None, v, nodes[k + 1], costs[k]))
    return spark.createDataFrame(rows, _ROWS)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _trace(rounds: list[DataFrame], node: str, at: int) -> list[tuple[str, float]]:
    """(node, cost of the edge to the one after it) from ``node`` back to the side's end, by the parent table."""
    out = [(node, 0.0)]
    while at > 0:
        row = rounds[at].where(F.col("id") == node).select("parent", "parent_at", "c").first()
        node, at = row.parent, row.parent_at
        out.append((node, row.c))
    return out


def cheapest_path(edges: DataFrame, source: str, target: str, depth: int | None = 10, weighted: bool = True, directed: bool = True) -> DataFrame:
    """step, kind (node or edge), id, src, dst, cost: nodes and edges in turn along the cheapest path of at most ``depth``
    edges (None: any number); cost 1 / weight, or 1 an edge if not ``weighted``. No path gives no rows, a path from a node to
    itself one.

    Both ends grow in turn, the one with the smaller frontier first. A round joins only its frontier with the edges and writes
    only the labels that it improves, each with its parent; labels that cannot lead to a cheaper path than the best one known
    go. The search ends where the cheapest labels of both frontiers together cost as much as that path. Of equally cheap
    paths the one through the least meeting node and least parents is taken.
    """
    spark = edges.sparkSession
    if source == target:
        return _rows(spark, [source], [])
    with steps(spark, edges):
        cost = S.edge_cost(F.col("weight")) if weighted else F.lit(1.0)
        e = edges.select("src", "dst", cost.alias("c"))
        e = e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c"))
        e = written(e.where("src <> dst").groupBy("src", "dst").agg(F.min("c").alias("c")))
        links = (e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c"))
        first = lambda v: written(spark.range(1).select(F.lit(v).alias("id"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("parent_at"), F.lit(0.0).alias("c"), F.lit(0).alias("at")))
        rounds, size, least = ([first(source)], [first(target)]), [1, 1], [0.0, 0.0]
        best, meeting, done = float("inf"), None, 0
        known = lambda side: _union(rounds[side]).groupBy("id").agg(F.min(F.struct(F.round("cost", 12).alias("k"), "at", "cost")).alias("m")).select("id", F.col("m.cost").alias("held"), F.col("m.at").alias("held_at"))
        while (depth is None or done < depth) and size[0] and size[1] and least[0] + least[1] < best - 1e-12:
            side, done = (0 if size[0] <= size[1] else 1), done + 1
            at = len(rounds[side])
            front = rounds[side][-1].select(F.col("id").alias("src"), "cost", "at")
            made = front.join(links[side], "src").select(F.col("dst").alias("id"), (F.col("cost") + F.col("c")).alias("cost"), F.col("src").alias("parent"), F.col("at").alias("parent_at"), "c")
            made = made.where(F.col("cost") < best).groupBy("id").agg(F.min(F.struct(F.round("cost", 12).alias("k"), "parent", "cost", "parent_at", "c")).alias("m"))
            made = made.select("id", "m.cost", "m.parent", "m.parent_at", "m.c").join(known(side), "id", "left").where("held IS NULL OR cost < held - 1e-12").select("id", "cost", "parent", "parent_at", "c", F.lit(at).alias("at"))
            made = written(made)
            rounds[side].append(made)
            found = made.join(known(1 - side), "id").agg(F.min(F.struct(F.round(F.col("cost") + F.col("held"), 12).alias("k"), "id", (F.col("cost") + F.col("held")).alias("sum"), "at", "held_at")).alias("m"), F.lit(1).alias("one")).first()["m"]
            if found is not None and found["sum"] < best - 1e-12:
                best = found["sum"]
                ends = (found["at"], found["held_at"])
                meeting = (found["id"], *(ends if side == 0 else ends[::-1]))
            row = made.agg(F.count("*").alias("n"), F.min("cost").alias("least")).first()
            size[side], least[side] = row.n, row.least if row.n else float("inf")
        if meeting is None:
            return spark.createDataFrame([], _ROWS)
        node, before, after = meeting
        there, back = _trace(rounds[0], node, before), _trace(rounds[1], node, after)
        return _rows(spark, [v for v, _ in reversed(there)] + [v for v, _ in back[1:]], [c for _, c in reversed(there[1:])] + [c for _, c in back[1:]])


def path_between(edges: DataFrame, source: str, target: str, depth: int | None = None) -> DataFrame:
    """As ``cheapest_path``, by the number of edges, whatever their direction."""
    return cheapest_path(edges, source, target, depth, weighted=False, directed=False)
