"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import forget, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b); the label is the component's least node.

    Rounds of least-neighbour labels, each followed by a pointer jump, so chains shrink geometrically and stars take two
    rounds. Sums are partial before they are exchanged, so a hub with very many links costs a task no more than others.
    Every round is written to the shared folder, and the one before it deleted. No links give an empty table.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m"))
        near = label.join(seen, label["node"] == seen["a"]).select("node", "label", F.least("label", "m").alias("near"))
        top = label.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        step = written(near.join(top, near["near"] == top["n2"], "left").select("node", "label", F.least("near", F.coalesce("l2", "near")).alias("next")))
        changed = step.where("label <> next").limit(1).count()
        forget(label)
        label = step.select("node", F.col("next").alias("label"))
        if not changed:
            forget(both)
            return label


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, label; as ``components`` gives it) after further links (a, b): only the components that they join are
    labelled anew, as nodes of a graph of their own. Nodes that are new get a label too."""
    of = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = written(ends.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")))
    up = components(ends.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    new = ends.select(F.col("a").alias("node"), F.col("la").alias("label")).unionByName(ends.select(F.col("b").alias("node"), F.col("lb").alias("label"))).distinct()
    all_ = label.select("node", "label").unionByName(new.join(label.select("node"), "node", "left_anti"))
    return written(all_.join(up.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
