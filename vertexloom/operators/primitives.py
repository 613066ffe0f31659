"""Graph primitives: degrees, adjacency, breadth-first search, components, distances, bipartition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.model import Graph, each_graph
from vertexloom.plans.loops import cut


def degrees(g: Graph, kind: str = "all") -> DataFrame:
    ends = {"out": ["src"], "in": ["dst"], "all": ["src", "dst"]}[kind]
    touched = [g.edges.select("graph_id", F.col(e).alias("pos")) for e in ends]
    n = (touched[0] if len(touched) == 1 else touched[0].union(touched[1])).groupBy("graph_id", "pos").agg(F.count("*").alias("degree"))
    return g.vertices.join(n, ["graph_id", "pos"], "left").select("graph_id", "v", "pos", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def adjacency(g: Graph) -> DataFrame:
    return g.both_ways().groupBy("graph_id", "src", "dst").agg(F.sum("w").alias("w"))


def bfs(g: Graph, roots: DataFrame) -> DataFrame:
    """(graph_id, pos, parent, layer) from roots(graph_id, pos); a root's parent is -1, others' the least of the layer before."""
    steps = adjacency(g).select("graph_id", "src", "dst")
    seen = cut(roots.select("graph_id", "pos", F.lit(-1).alias("parent"), F.lit(0).alias("layer")))
    layer, front = 0, seen
    while not front.isEmpty():
        layer += 1
        new = front.select("graph_id", F.col("pos").alias("src")).join(steps, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("pos")).agg(F.min("src").alias("parent"))
        front = cut(new.join(seen, ["graph_id", "pos"], "left_anti").select("graph_id", "pos", "parent", F.lit(layer).alias("layer")))
        seen = seen.union(front)
    return seen


def components(g: Graph) -> DataFrame:
    """(graph_id, pos, comp): comp is the least position of the weak component. Labels spread and jump to their label's label."""
    e = g.edges.where("src <> dst").select("graph_id", "src", "dst")
    e = cut(e.union(e.select("graph_id", "dst", "src")).distinct())
    label = cut(g.vertices.select("graph_id", "pos", F.col("pos").alias("comp")))
    while True:
        near = e.join(label, (e.graph_id == label.graph_id) & (e.dst == label.pos)).select(e.graph_id, F.col("src").alias("pos"), "comp").groupBy("graph_id", "pos").agg(F.min("comp").alias("near"))
        step = label.join(near, ["graph_id", "pos"], "left").select("graph_id", "pos", "comp", F.least("comp", "near").alias("to"))
        jump = label.select("graph_id", F.col("pos").alias("to"), F.col("comp").alias("top"))
        new = cut(step.join(jump, ["graph_id", "to"]).select("graph_id", "pos", "comp", F.least("to", "top").alias("now")))
        if new.where("now <> comp").isEmpty():
            return label
        label = new.select("graph_id", "pos", F.col("now").alias("comp"))


def is_connected(g: Graph) -> DataFrame:
    return components(g).groupBy("graph_id").agg((F.countDistinct("comp") <= 1).alias("connected"))


def strong_components(g: Graph) -> DataFrame:
    """(graph_id, pos, comp) by mutual reach; a kernel for each graph."""

    def solve(own, edges, weights):
        n = len(own["pos"])
        r = np.eye(n, dtype=bool)
        r[edges[:, 0], edges[:, 1]] = True
        while True:
            s = r | (r.astype(np.uint8) @ r.astype(np.uint8) > 0)
            if (s == r).all():
                break
            r = s
        return {"pos": np.arange(n), "comp": (r & r.T).argmax(1)}

    return each_graph(g.vertices.select("graph_id", "pos"), g.own_edges(), solve, "graph_id long, pos int, comp int")


def distances(g: Graph, weighted: bool = False) -> DataFrame:
    """(graph_id, i, j, d) of all reachable pairs."""
    steps = cut(adjacency(g).select("graph_id", F.col("src").alias("k"), F.col("dst").alias("j"), (F.col("w") if weighted else F.lit(1.0)).alias("w")))
    best = cut(g.vertices.select("graph_id", F.col("pos").alias("i"), F.col("pos").alias("j"), F.lit(0.0).alias("d")))
    front = best
    # Stored tables are small by their bytes and large by their rows: without the hints they would go through the driver in each round.
    while not front.isEmpty():
        reach = front.withColumnRenamed("j", "k").join(steps.hint("merge"), ["graph_id", "k"]).groupBy("graph_id", "i", "j").agg(F.min(F.col("d") + F.col("w")).alias("new"))
        front = cut(reach.join(best.hint("merge"), ["graph_id", "i", "j"], "left").where("d IS NULL OR new < d").select("graph_id", "i", "j", F.col("new").alias("d")))
        best = cut(best.union(front).groupBy("graph_id", "i", "j").agg(F.min("d").alias("d")))
    return best


def distance_grid(g: Graph, distances: DataFrame) -> DataFrame:
    """(graph_id, i, j, d) for every ordered pair of a graph's vertices: what distances(graph_id, i, j, d) gives, as it stands, and 0 for the rest."""
    i, j = (g.vertices.select("graph_id", F.col("pos").alias(c)) for c in ("i", "j"))
    return i.join(j, "graph_id").join(distances.select("graph_id", "i", "j", F.col("d").cast("double").alias("d")), ["graph_id", "i", "j"], "left").fillna({"d": 0.0})


def bipartition(g: Graph) -> DataFrame:
    """(graph_id, pos, side) by parity of the distance from each component's first vertex; ValueError on an odd circle.

    Each vertex hangs on its least neighbour, if that is less than itself, with the parity of the way there; the trees become
    stars by jumps, stars become vertices, and edges within one, which must tell the same parity, go. That is repeated
    until no edge is left, so most edges are looked at in the first round alone.
    """
    if not g.edges.where("src = dst").isEmpty():
        raise ValueError("the graph is not bipartite")
    side = cut(g.vertices.select("graph_id", "pos", F.col("pos").alias("top"), F.lit(0).alias("odd")))
    e = cut(g.edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("odd")))
    while not e.isEmpty():
        both = e.union(e.select("graph_id", "b", "a", "odd"))
        up = cut(both.groupBy("graph_id", "a").agg(F.min(F.struct("b", "odd")).alias("to")).where("to.b < a").select("graph_id", "a", F.col("to.b").alias("top"), F.col("to.odd").alias("odd")))
        while True:  # to the tops of the trees
            over = up.select("graph_id", F.col("a").alias("top"), F.col("top").alias("over"), F.col("odd").alias("more"))
            higher = cut(up.join(over, ["graph_id", "top"], "left").select("graph_id", "a", F.coalesce("over", "top").alias("top"), F.expr("odd ^ coalesce(more, 0)").alias("odd"), F.col("over").isNotNull().alias("moved")))
            up = higher.drop("moved")
            if higher.where("moved").isEmpty():
                break
        of = lambda end: up.select("graph_id", F.col("a").alias(end), F.col("top").alias(f"top_{end}"), F.col("odd").alias(f"odd_{end}"))
        side = cut(side.join(of("top"), ["graph_id", "top"], "left").select("graph_id", "pos", F.coalesce("top_top", "top").alias("top"), F.expr("odd ^ coalesce(odd_top, 0)").alias("odd")))
        e = e.join(of("a"), ["graph_id", "a"], "left").join(of("b"), ["graph_id", "b"], "left")
        e = e.select("graph_id", F.coalesce("top_a", "a").alias("a"), F.coalesce("top_b", "b").alias("b"), F.expr("odd ^ coalesce(odd_a, 0) ^ coalesce(odd_b, 0)").alias("odd"))
        e = cut(e.where("a <> b OR odd = 1").distinct())
        if not e.where("a = b").isEmpty():
            raise ValueError("the graph is not bipartite")
    return side.select("graph_id", "pos", F.col("odd").alias("side"))
