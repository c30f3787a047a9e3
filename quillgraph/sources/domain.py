"""The knowledge graph that the star schema holds: nodes, edges and chunk/entity tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, label, entity_type, confidence of every region, nation, customer, supplier and part."""
    t = lambda name: table(spark, d, name)
    row = lambda df, p, k, n, kind, c: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(n).alias("label"), F.lit(kind).alias("entity_type"), c.cast("double").alias("confidence"))
    scaled = lambda c: F.greatest(F.least(F.col(c) / 10000.0, F.lit(1.0)), F.lit(0.0))
    return (
        row(t("region"), "r:", "r_regionkey", "r_name", "Region", F.lit(0.9))
        .unionByName(row(t("nation"), "n:", "n_nationkey", "n_name", "Nation", F.lit(0.9)))
        .unionByName(row(t("customer"), "c:", "c_custkey", "c_name", "Customer", scaled("c_acctbal")))
        .unionByName(row(t("supplier"), "s:", "s_suppkey", "s_name", "Supplier", scaled("s_acctbal")))
        .unionByName(row(t("part"), "p:", "p_partkey", "p_name", "Part", F.least(F.col("p_retailprice") / 2000.0, F.lit(1.0))))
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, edge_type, weight."""
    t = lambda name: table(spark, d, name)
    ident = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    row = lambda df, s, o, kind: df.select(s.alias("src"), o.alias("dst"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"))
    out = (
        row(t("customer"), ident("c:", "c_custkey"), ident("n:", "c_nationkey"), "located_in")
        .unionByName(row(t("supplier"), ident("s:", "s_suppkey"), ident("n:", "s_nationkey"), "located_in"))
        .unionByName(row(t("nation"), ident("n:", "n_nationkey"), ident("r:", "n_regionkey"), "part_of"))
    )
    counted = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return out.unionByName(counted.select(ident("s:", "l_suppkey").alias("src"), ident("p:", "l_partkey").alias("dst"), F.lit("supplies").alias("edge_type"), F.least(F.col("n") / 10.0, F.lit(1.0)).alias("weight")))


NODES_SQL = """nodes AS (
  SELECT 'r:' || r_regionkey AS id, r_name AS label, 'Region' AS entity_type, 0.9::DOUBLE AS confidence FROM region
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'Nation', 0.9::DOUBLE FROM nation
  UNION ALL SELECT 'c:' || c_custkey, c_name, 'Customer', greatest(least(c_acctbal / 10000.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) FROM customer
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'Supplier', greatest(least(s_acctbal / 10000.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, p_name, 'Part', least(p_retailprice / 2000.0::DOUBLE, 1.0::DOUBLE) FROM part)"""
SMALL_EDGES_SQL = """edges AS (
  SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'located_in' AS edge_type, 1.0::DOUBLE AS weight FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'located_in', 1.0::DOUBLE FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'part_of', 1.0::DOUBLE FROM nation)"""
EDGES_SQL = SMALL_EDGES_SQL[:-1] + """
  UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'supplies', least(count(*) / 10.0::DOUBLE, 1.0::DOUBLE) FROM lineitem GROUP BY l_suppkey, l_partkey)"""
