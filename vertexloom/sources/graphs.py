"""Graphs made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.model import Graph, dealt
from vertexloom.plans.loops import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark, sf_dir) -> Graph:
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"))
    return Graph.of(v, v.where("false").select(F.col("v").alias("src"), F.col("v").alias("dst")))


def nations(spark, sf_dir) -> Graph:
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("v"))
    return Graph.of(v, v.where("false").select(F.col("v").alias("src"), F.col("v").alias("dst")))


def tree(spark, sf_dir) -> Graph:
    """A root, regions from 1, nations from 6, customers from 31."""
    r = table(spark, sf_dir, "region").select(F.lit(0).cast("long").alias("src"), (F.col("r_regionkey") + 1).cast("long").alias("dst"))
    n = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("src"), (F.col("n_nationkey") + 6).cast("long").alias("dst"))
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 6).cast("long").alias("src"), (F.col("c_custkey") + 31).alias("dst"))
    e = r.union(n).union(c)
    return Graph.of(e.select(F.col("dst").alias("v")).union(r.select("src")), e, True)


def supplies(spark, sf_dir) -> Graph:
    """Suppliers and, after them, parts; an edge where a line item joins them."""
    items = table(spark, sf_dir, "lineitem")
    e = cut(dealt(items.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")), items.count(), "src", "dst").distinct())
    return Graph.of(e.select(F.col("src").alias("v")).union(e.select("dst")), e, n_edges=e.count())


def trade(spark, sf_dir) -> Graph:
    """Nations a < b with more trade between customers and suppliers than the average pair."""
    c = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("long").alias("a"))
    s = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey")).select("l_orderkey", F.col("s_nationkey").cast("long").alias("b"))
    w = c.join(s, F.expr("o_orderkey = l_orderkey")).where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    w = w.join(w.agg(F.avg("w").alias("m")), F.expr("w > m")).drop("m")
    return Graph.of(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("v")), w)


def chats(spark, sf_dir) -> Graph:
    """A graph for each conversation: its turns, in a chain with a skip of three."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("v")).distinct()
    e = t.select("graph_id", F.col("v").alias("src"), F.explode(F.array(F.col("v") + 1, F.col("v") + 3)).alias("dst"))
    return Graph.of(t, e, True)
