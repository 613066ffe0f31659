"""Dendrograms, linkage hierarchies and edge bundling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions import transforms as T
from vertexloom.model import Graph
from vertexloom.operators.primitives import bfs
from vertexloom.plans.loops import cut

TURNS = {"right": (1, 0, 0, 1), "left": (-1, 0, 0, 1), "up": (0, 1, 1, 0), "down": (0, 1, -1, 0)}


def _coordinates(tree: DataFrame) -> DataFrame:
    """tree(graph_id, pos, parent, layer) -> with x = layer and y: leaves 0, 1, 2... by pos; a parent the mean of its children, inner ones of which count as 0."""
    parents = tree.where("parent >= 0").select("graph_id", F.col("parent").alias("pos")).distinct()
    leaf = tree.join(parents, ["graph_id", "pos"], "left_anti").withColumn("y0", (F.row_number().over(Window.partitionBy("graph_id").orderBy("pos")) - 1).cast("double"))
    all_ = tree.join(leaf.select("graph_id", "pos", "y0"), ["graph_id", "pos"], "left").withColumn("y0", F.coalesce("y0", F.lit(0.0)))
    mean = all_.where("parent >= 0 AND layer > 1").groupBy("graph_id", F.col("parent").alias("pos")).agg(F.avg("y0").alias("m"))
    return all_.join(mean, ["graph_id", "pos"], "left").select("graph_id", "pos", "parent", "layer", F.col("layer").cast("double").alias("x"), F.coalesce("m", "y0").alias("y"))


def rectangular_dendrogram(g: Graph, roots: DataFrame, center=None, orientation: str = "right") -> DataFrame:
    a, b, c, d = TURNS[orientation]
    at = _coordinates(bfs(g, roots))
    return T.recenter(at.select("graph_id", "pos", (a * F.col("x") + b * F.col("y")).alias("x"), (c * F.col("x") + d * F.col("y")).alias("y")), center)


def _polar(at: DataFrame, orientation: str, theta: float) -> DataFrame:
    sign = 1 if orientation == "left" else -1
    t = at.withColumn("t", sign * 2 * math.pi * F.col("y") / (F.max("y").over(T.each()) + 1) + theta)
    return t.withColumns({"y": F.col("x") * F.sin("t"), "x": F.col("x") * F.cos("t")}).drop("t")


def circular_dendrogram(g: Graph, roots: DataFrame, center=None, orientation: str = "right", theta: float = 0.0) -> DataFrame:
    return T.recenter(_polar(_coordinates(bfs(g, roots)), orientation, theta).select("graph_id", "pos", "x", "y"), center)


def single_linkage(n: int, edges: np.ndarray) -> np.ndarray:
    """Kruskal's merges (c1, c2, distance) on 1 / (A + A' + 1e-10)."""
    a = np.zeros((n, n))
    for i, j in edges:
        if i != j:
            a[i, j] += 1
            a[j, i] += 1
    d = 1 / (a + 1e-10)
    i, j = np.triu_indices(n, 1)
    out = []
    of = np.arange(n)
    for k in np.lexsort((j, i, d[i, j])):
        x, y = of[i[k]], of[j[k]]
        if x != y:
            new = n + len(out)
            out.append((min(x, y), max(x, y), d[i[k], j[k]]))
            of[(of == x) | (of == y)] = new
    return np.array(out).reshape(-1, 3)


def linkage_hierarchy(linkage: np.ndarray) -> pd.DataFrame:
    """pos, parent, layer, depth of every node of a linkage; step k makes node n + k."""
    n = len(linkage) + 1
    total = 2 * n - 1
    depth, parent, layer = np.zeros(total), np.full(total, -1), np.zeros(total, int)
    for k, (a, b, d) in enumerate(linkage):
        a, b = int(a), int(b)
        parent[[a, b]] = n + k
        depth[n + k] = max(depth[a], depth[b]) + (d - abs(depth[a] - depth[b])) / 2
    for x in range(total - 2, -1, -1):
        layer[x] = layer[parent[x]] + 1
    return pd.DataFrame({"pos": np.arange(total), "parent": parent, "layer": layer, "depth": depth.max() - depth})


def edgebundle(g: Graph, linkage: DataFrame | None = None, center=(0.0, 0.0), orientation: str = "right", theta: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The layout, and routes(graph_id, src, dst, waypoints). linkage(graph_id, step, c1, c2, dist), else single linkage."""
    schema = "graph_id long, pos int, parent int, layer int, depth double, leaf boolean"

    computed = linkage is None

    def tree(key, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        m = single_linkage(len(v), e[["src", "dst"]].to_numpy(int)) if computed else e.sort_values("step")[["c1", "c2", "dist"]].to_numpy(float)
        out = linkage_hierarchy(m)
        return out.assign(graph_id=key[0], leaf=out["pos"] < len(m) + 1)[["graph_id", "pos", "parent", "layer", "depth", "leaf"]]

    h = cut(g.vertices.groupBy("graph_id").cogroup((g.own_edges() if linkage is None else linkage.select(F.col("graph_id").alias("g"), "step", "c1", "c2", "dist")).groupBy("g")).applyInPandas(tree, schema))
    at = _coordinates(h.select("graph_id", "pos", "parent", "layer")).drop("x", "layer").join(h.select("graph_id", "pos", "depth", "leaf"), ["graph_id", "pos"])
    at = cut(T.shift(_polar(at.withColumn("x", F.col("depth")), orientation, theta), center))
    up = cut(h.select("graph_id", F.col("pos").alias("node"), F.col("pos").alias("above"), F.lit(0).alias("k"), "parent"))
    closure = up
    while not up.where("parent >= 0").isEmpty():  # one round for each layer
        up = cut(up.where("parent >= 0").select("graph_id", "node", F.col("parent").alias("above"), (F.col("k") + 1).alias("k")).join(h.select("graph_id", F.col("pos").alias("above"), "parent"), ["graph_id", "above"]).select("graph_id", "node", "above", "k", "parent"))
        closure = closure.union(up)
    s, d = (closure.select("graph_id", F.col("node").alias(n), "above", F.col("k").alias(f"k_{n}")) for n in ("src", "dst"))
    e = g.edges.select("graph_id", "src", "dst").where("src <> dst").distinct()
    meet = e.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst", "above"])
    meet = meet.groupBy("graph_id", "src", "dst").agg(F.min(F.struct("k_src", "k_dst")).alias("m"))
    one = meet.join(s, ["graph_id", "src"]).where("k_src > 0 AND k_src <= m.k_src").select("graph_id", "src", "dst", F.col("k_src").alias("seq"), "above")
    two = meet.join(d, ["graph_id", "dst"]).where("k_dst > 0 AND k_dst < m.k_dst").select("graph_id", "src", "dst", (F.col("m.k_src") + F.col("m.k_dst") - F.col("k_dst")).alias("seq"), "above")
    way = one.union(two).join(at.select("graph_id", F.col("pos").alias("above"), "x", "y"), ["graph_id", "above"])
    way = way.groupBy("graph_id", "src", "dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("waypoints"))
    routes = g.edges.select("graph_id", "src", "dst").distinct().join(way, ["graph_id", "src", "dst"], "left").withColumn("waypoints", F.coalesce("waypoints", F.array().cast("array<struct<x:double,y:double>>")))
    return at.where("leaf").select("graph_id", "pos", "x", "y"), routes
