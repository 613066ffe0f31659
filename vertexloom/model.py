"""Graphs as pairs of DataFrames. A graph_id column lets one job lay out any number of graphs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.plans.loops import cut

LAYOUT = "graph_id long, pos int, x double, y double"

#: Vertices and edges of the graphs that are taken up at once, unless one graph has more; tasks at most; results kept for graphs that are alike, of so many bytes at most.
ROWS, TASKS, KEPT, KEPT_BYTES = 20_000, 512, 1_000, 10_000


def each_graph(vertices: DataFrame, edges: DataFrame, solve: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """graph_id and the columns of solve(own, edges, weights) of every graph, one after another in tasks of many.

    own holds the columns of vertices(graph_id, pos[, ...]) in the order of pos; edges(g, src, dst, w) are sorted by their
    ends. Graphs are told apart by solve() by nothing else, so those that are alike are solved once a task.
    """
    vertices, edges = cut(vertices), cut(edges)
    n = max(1, -(-(vertices.count() + edges.count()) // ROWS))
    names, known = [f.strip().split()[0] for f in schema.split(",")], {}

    def run(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        v, e = v.sort_values(["graph_id", "pos"]), e.sort_values(["g", "src", "dst"])
        ids, g = v["graph_id"].to_numpy(), e["g"].to_numpy()
        from_ = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
        to, at = np.r_[from_[1:], len(ids)], (np.searchsorted(g, ids[from_], side).tolist() for side in ("left", "right"))
        ends, w = e[["src", "dst"]].to_numpy(int), e["w"].to_numpy(float)
        cols = {c: v[c].to_numpy() for c in v.columns if c not in ("graph_id", "bucket")}
        out, size = [], []
        for a, b, c, d in zip(from_.tolist(), to.tolist(), *at):
            own = {k: x[a:b] for k, x in cols.items()}
            key = b"".join([np.int64(b - a).tobytes(), *(x.tobytes() for x in own.values()), ends[c:d].tobytes(), w[c:d].tobytes()])
            got = known.get(key)
            if got is None:
                got = solve(own, ends[c:d], w[c:d])
                if len(key) <= KEPT_BYTES:
                    if len(known) >= KEPT:
                        known.clear()
                    known[key] = got
            out.append(got)
            size.append(len(got[names[1]]))
        if not out:
            return pd.DataFrame({c: [] for c in names})
        return pd.DataFrame({names[0]: np.repeat(ids[from_], size), **{c: np.concatenate([x[c] for x in out]) for c in names[1:]}})

    # A number of partitions keeps Spark from merging small ones, as it would by their bytes.
    dealt = [df.withColumn("bucket", F.pmod(F.xxhash64(c), F.lit(n))).repartition(min(n, TASKS), "bucket").groupBy("bucket") for df, c in ((vertices, "graph_id"), (edges, "g"))]
    return dealt[0].cogroup(dealt[1]).applyInPandas(run, schema)

#: Vertices that are numbered in one task, and rows that a task joins or counts where their number is known.
NUMBERED, DEALT = 200_000, 500_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df of so many rows in partitions of about DEALT rows; as it is if one would do."""
    return df.repartition(-(-rows // DEALT), *by) if rows > DEALT else df


def numbered(vertices: DataFrame, most: int = NUMBERED) -> DataFrame:
    """(graph_id, v, pos) of vertices(graph_id, v) of one graph. Beyond ``most`` they are numbered by ranges of v, and each range's first number is the count of those before."""
    vertices = cut(vertices)
    n = -(-vertices.count() // most)
    order = Window.partitionBy("graph_id").orderBy("v")
    if n <= 1:
        return vertices.select("graph_id", "v", (F.row_number().over(order) - 1).cast("int").alias("pos"))
    # Stored, as ranges are drawn from samples: another run may draw them elsewhere.
    by_range = cut(vertices.repartitionByRange(n, "graph_id", "v").withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy("graph_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_range.groupBy("graph_id", "part").agg(F.count("*").alias("n")).select("graph_id", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("graph_id", "part").orderBy("v"))
    return by_range.withColumn("nth", nth).join(F.broadcast(before), ["graph_id", "part"]).select("graph_id", "v", (F.col("before") + F.col("nth") - 1).cast("int").alias("pos"))


@dataclass(frozen=True)
class Graph:
    """vertices(graph_id, v, pos): pos numbers each graph's vertices from 0. edges(graph_id, src, dst, w): src and dst are pos."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame, directed: bool = False, n_edges: int = 0) -> "Graph":
        """From vertices([graph_id,] v) in the order of v and edges([graph_id,] src, dst[, w]) between values of v. Many edges, as n_edges tells, are joined in tasks of bounded memory."""
        if not {"v"} <= set(vertices.columns) or not {"src", "dst"} <= set(edges.columns):
            raise ValueError("vertices need a column v, edges the columns src and dst")
        one = lambda df: df if "graph_id" in df.columns else df.withColumn("graph_id", F.lit(0).cast("long"))
        vs = one(vertices).select("graph_id", "v").distinct()
        if "graph_id" in vertices.columns:
            vs = vs.withColumn("pos", (F.row_number().over(Window.partitionBy("graph_id").orderBy("v")) - 1).cast("int"))
        else:
            vs = numbered(vs)
        es = one(edges).withColumn("w", F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0))
        a, b = (vs.select("graph_id", F.col("v").alias(end), F.col("pos").alias(f"{end}_pos")) for end in ("src", "dst"))
        at = lambda df, end: dealt(df, n_edges, "graph_id", end)
        es = at(at(es, "src").join(a, ["graph_id", "src"]), "dst").join(b, ["graph_id", "dst"]).select("graph_id", F.col("src_pos").alias("src"), F.col("dst_pos").alias("dst"), "w")
        return Graph(vs, es, directed)

    def sized(self) -> DataFrame:
        return self.vertices.withColumn("n", F.count("*").over(Window.partitionBy("graph_id")))

    def own_edges(self) -> DataFrame:
        """The edges with graph_id as a new column g, to be grouped beside vertices of the same origin."""
        return self.edges.select(F.col("graph_id").alias("g"), "src", "dst", "w")

    def both_ways(self) -> DataFrame:
        """The edges, and for an undirected graph their reverses; loops once."""
        if self.directed:
            return self.edges
        back = self.edges.where("src <> dst").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        return self.edges.unionByName(back)

    def lay_out(self, kernel: Callable[..., np.ndarray], initial: DataFrame | None = None, fixed: DataFrame | None = None) -> DataFrame:
        """Runs kernel(n, edges, weights, initial) on every graph; for graphs of a few thousand vertices.

        With fixed(graph_id, pos) the kernel also gets their positions, as ``fixed``.
        """
        vs = self.vertices.select("graph_id", "pos")
        held = fixed is not None
        if held:
            vs = vs.join(fixed.select("graph_id", "pos").distinct().withColumn("fixed", F.lit(True)), ["graph_id", "pos"], "left").withColumn("fixed", F.col("fixed").isNotNull())
        started = initial is not None
        if started:
            vs = vs.join(initial.select("graph_id", "pos", F.col("x").cast("double"), F.col("y").cast("double")), ["graph_id", "pos"], "left")

        def solve(own: dict[str, np.ndarray], edges: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
            start = None
            if started:
                start = np.c_[own["x"], own["y"]]
                if np.isnan(start).any():
                    raise KeyError("a vertex has no initial coordinates")
            more = {"fixed": np.flatnonzero(own["fixed"])} if held else {}
            xy = kernel(len(own["pos"]), edges, weights, start, **more)
            return {"pos": own["pos"], "x": xy[:, 0], "y": xy[:, 1]}

        return each_graph(vs, self.own_edges(), solve, LAYOUT)
