"""The iterative layouts as calls on a Graph: their checks, and what happens before and after the kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.model import LAYOUT, Graph, each_graph
from vertexloom.operators import kernels as K
from vertexloom.plans.loops import cut

#: Graphs of fewer vertices are laid out by the forces, others by the energy, unless a method is named.
FEW = 500


def spring(g: Graph, initial: DataFrame | None = None, fixed: DataFrame | None = None, center=(0.0, 0.0), scale: float = 1.0, method: str | None = None, k: float | None = None, gravity: float = 1.0, exponent_attraction: float = 1.0, exponent_repulsion: float = -2.0, etol: float = 1e-4, max_iter: int = 50, seed: int = 0) -> DataFrame:
    """Springs by "force" or "energy". Without fixed(graph_id, pos) the result is moved by its mean and to center, then scaled so that the larger range is scale."""
    if method not in (None, "force", "energy"):
        raise ValueError("method must be force, energy or None")

    def run(n, e, w, start, fixed=()):
        free = np.ones(n, bool)
        free[list(fixed)] = False
        p = K.start(n, start, seed)
        if n == 1 or not free.any():
            return p
        if (method or ("force" if n < FEW else "energy")) == "force":
            p = K.spring(n, e, w, p, k, fixed, exponent_attraction, exponent_repulsion, etol, max_iter, seed)
        else:
            p = np.where(free[:, None], K.spring_energy(n, e, w, p, k, gravity, max_iter, seed), p)
        if len(fixed):
            return p
        p = p - p.mean(0) + np.asarray(center)
        wide = np.ptp(p, axis=0).max()
        return p * (scale / wide) if wide > 0 else p

    return g.lay_out(run, initial, fixed)


def neato(g: Graph, initial: DataFrame | None = None, **options) -> DataFrame:
    if g.directed:
        raise ValueError("neato lays out undirected graphs")
    return g.lay_out(lambda n, e, w, p: K.neato(n, e, w, p, **options), initial)


def from_distances(distances: DataFrame, kernel: str = "mds", radius: float = 1.0, max_iter: int = 15000) -> DataFrame:
    """(graph_id, pos, x, y) from full distances(graph_id, i, j, d): "mds" or "kamada_kawai"."""
    if kernel not in ("mds", "kamada_kawai"):
        raise ValueError("kernel must be mds or kamada_kawai")

    def run(d: pd.DataFrame) -> pd.DataFrame:
        n = int(d[["i", "j"]].to_numpy().max()) + 1
        m = np.zeros((n, n))
        m[d["i"], d["j"]] = d["d"]
        xy = K.classical_scaling(m) if kernel == "mds" else K.by_stress(m, None, radius, max_iter)
        return pd.DataFrame({"graph_id": d["graph_id"].iloc[0], "pos": np.arange(n), "x": xy[:, 0], "y": xy[:, 1]})

    return distances.groupBy("graph_id").applyInPandas(run, LAYOUT)


def sugiyama(g: Graph, **options) -> tuple[DataFrame, DataFrame]:
    """The layout, and waypoints(graph_id, src, dst, seq, x, y): where edges over two layers or more pass those between, from src on."""
    if not g.directed:
        raise ValueError("sugiyama lays out directed graphs")

    def solve(own, edges, weights):
        n = len(own["pos"])
        xy, ways = K.sugiyama(n, edges, np.ones(len(edges)), None, waypoints=True, **options)
        rows = [(k, -1, -1, *p) for k, p in enumerate(xy)] + [(i, j, seq, *p) for (i, j), way in ways.items() for seq, p in enumerate(way)]
        return dict(zip(("pos", "dst", "seq", "x", "y"), map(np.array, zip(*rows))))

    both = cut(each_graph(g.vertices.select("graph_id", "pos"), g.own_edges(), solve, "graph_id long, pos int, dst int, seq int, x double, y double"))
    return both.where("seq < 0").select("graph_id", "pos", "x", "y"), both.where("seq >= 0").select("graph_id", F.col("pos").alias("src"), "dst", "seq", "x", "y")
