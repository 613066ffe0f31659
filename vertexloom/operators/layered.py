"""Stages of layered drawings of acyclic graphs as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.model import Graph
from vertexloom.plans.loops import cut


def longest_path(g: Graph, max_rounds: int = 10_000) -> DataFrame:
    """(graph_id, pos, layer) of an acyclic graph: a round for each layer; ValueError on a circle."""
    layer = cut(g.vertices.select("graph_id", "pos", F.lit(0).alias("layer")))
    e = cut(g.edges.where("src <> dst").select("graph_id", "src", "dst").distinct())
    front, k = layer, 0
    while k <= max_rounds:
        k += 1
        front = cut(front.select("graph_id", F.col("pos").alias("src")).join(e, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("pos")).distinct())
        if front.isEmpty():
            return layer
        layer = cut(layer.join(front.withColumn("up", F.lit(k)), ["graph_id", "pos"], "left").select("graph_id", "pos", F.coalesce("up", "layer").alias("layer")))
    raise ValueError("the graph has a circle, or more layers than max_rounds")


def initial_x(layers: DataFrame) -> DataFrame:
    return layers.withColumn("x", F.row_number().over(Window.partitionBy("graph_id", "layer").orderBy("pos")) - 1)


def ghosts(g: Graph, layers: DataFrame) -> DataFrame:
    """(graph_id, src, dst, layer): one for each layer that an edge passes over."""
    s, t = (layers.select("graph_id", F.col("pos").alias(n), F.col("layer").alias(f"l_{n}")) for n in ("src", "dst"))
    e = g.edges.join(s, ["graph_id", "src"]).join(t, ["graph_id", "dst"]).where(F.abs(F.col("l_src") - F.col("l_dst")) > 1)
    low, high = F.least("l_src", "l_dst"), F.greatest("l_src", "l_dst")
    return e.select("graph_id", "src", "dst", F.explode(F.sequence(low + 1, high - 1)).alias("layer"))


def barycenters(g: Graph, at: DataFrame, incoming: bool = True) -> DataFrame:
    """(graph_id, pos, bary): the mean x of the neighbours on one side, one's own x without any."""
    own, other = ("dst", "src") if incoming else ("src", "dst")
    near = g.edges.select("graph_id", F.col(own).alias("pos"), F.col(other).alias("near")).join(at.select("graph_id", F.col("pos").alias("near"), F.col("x").alias("nx")), ["graph_id", "near"])
    mean = near.groupBy("graph_id", "pos").agg(F.avg("nx").alias("m"))
    return at.join(mean, ["graph_id", "pos"], "left").select("graph_id", "pos", F.coalesce("m", F.col("x").cast("double")).alias("bary"))
