"""Stress, its Laplacian, double centring, and single force steps as joins and sums over all pairs of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.model import Graph
from vertexloom.plans.loops import cut


def double_centered(distances: DataFrame) -> DataFrame:
    """(graph_id, i, j, b) of full distances(graph_id, i, j, d)."""
    q = distances.withColumn("q", F.col("d") * F.col("d"))
    mean = lambda *by: F.avg("q").over(Window.partitionBy("graph_id", *by))
    return q.select("graph_id", "i", "j", (-0.5 * (F.col("q") - mean("i") - mean("j") + mean())).alias("b"))


def edge_lengths(g: Graph, layout: DataFrame) -> DataFrame:
    a, b = (layout.select("graph_id", F.col("pos").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}")) for n in ("src", "dst"))
    e = g.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    return e.select("graph_id", "src", "dst", "w", F.hypot(F.col("x_src") - F.col("x_dst"), F.col("y_src") - F.col("y_dst")).alias("length"))


def stress(lengths: DataFrame, unit: float = 1.0) -> DataFrame:
    return lengths.groupBy("graph_id").agg(F.sum(F.col("w") * (F.col("length") - unit) * (F.col("length") - unit)).alias("stress"))


def laplacian(lengths: DataFrame) -> DataFrame:
    m = F.when(F.col("length") > 0, -1 / F.col("length")).otherwise(0.0)
    one = lengths.where("src <> dst").select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), m.alias("m"))
    both = one.union(one.select("graph_id", "j", "i", "m"))
    return both.union(both.groupBy("graph_id", "i").agg(F.sum("m").alias("s")).select("graph_id", "i", "i", -F.col("s")))


def _pairs(layout: DataFrame) -> DataFrame:
    """(graph_id, i, j, dx, dy, d, n) of all ordered pairs of a graph's vertices: the forces are between all of them."""
    a, b = (layout.select("graph_id", F.col("pos").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")) for n in ("i", "j"))
    n = layout.groupBy("graph_id").agg(F.count("*").alias("n"))
    p = a.join(b, "graph_id").where("i <> j").join(n, "graph_id").withColumns({"dx": F.col("xi") - F.col("xj"), "dy": F.col("yi") - F.col("yj")})
    return p.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def arf_step(g: Graph, layout: DataFrame, scaling: float = 1.0, spring_strength: float = 1.1, dt: float = 1e-3) -> DataFrame:
    e = g.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(spring_strength).alias("k")).distinct()
    p = _pairs(layout).join(e, ["graph_id", "i", "j"], "left")
    f = F.coalesce("k", F.lit(1.0)) - scaling * F.sqrt("n") / F.col("d")
    force = p.groupBy("graph_id", F.col("j").alias("pos")).agg(F.sum(f * F.col("dx")).alias("fx"), F.sum(f * F.col("dy")).alias("fy"))
    return layout.join(force, ["graph_id", "pos"]).select("graph_id", "pos", (F.col("x") + dt * F.col("fx")).alias("x"), (F.col("y") + dt * F.col("fy")).alias("y"))


def arf_steps(g: Graph, layout: DataFrame, steps: int, **options) -> DataFrame:
    for _ in range(steps):
        layout = cut(arf_step(g, layout, **options))
    return layout


def fa2_step(g: Graph, layout: DataFrame, scaling_ratio: float = 2.0, gravity: float = 1.0, jitter_tolerance: float = 1.0) -> DataFrame:
    """ForceAtlas2's first step from rest: every vertex weighs one more than its neighbours, and moves the less the harder it is pulled."""
    e = g.both_ways().where("src <> dst").groupBy("graph_id", F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("w").alias("w"))
    m = layout.join(e.groupBy("graph_id", F.col("i").alias("pos")).agg(F.count("*").alias("k")), ["graph_id", "pos"], "left").select("graph_id", "pos", (F.coalesce("k", F.lit(0)) + 1.0).alias("m"))
    mi, mj = (m.select("graph_id", F.col("pos").alias(c), F.col("m").alias(f"m{c}")) for c in ("i", "j"))
    p = _pairs(layout).join(e, ["graph_id", "i", "j"], "left").join(mi, ["graph_id", "i"]).join(mj, ["graph_id", "j"])
    d = F.greatest("d", F.lit(0.01))
    f = scaling_ratio * F.col("mi") * F.col("mj") / (d * d) - F.coalesce("w", F.lit(0.0))
    push = p.groupBy("graph_id", F.col("i").alias("pos")).agg(F.sum(f * F.col("dx")).alias("px"), F.sum(f * F.col("dy")).alias("py"))
    mid = layout.groupBy("graph_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    at = layout.join(mid, "graph_id").join(m, ["graph_id", "pos"]).join(push, ["graph_id", "pos"], "left")
    at = at.withColumns({"ox": F.col("x") - F.col("cx"), "oy": F.col("y") - F.col("cy")}).withColumn("far", F.greatest(F.hypot("ox", "oy"), F.lit(0.01)))
    at = at.withColumns({f"f{c}": F.coalesce(f"p{c}", F.lit(0.0)) - gravity * F.col("m") * F.col(f"o{c}") / F.col("far") for c in ("x", "y")}).withColumn("own", F.col("m") * F.hypot("fx", "fy"))
    swing = at.groupBy("graph_id").agg(F.sum("own").alias("swing"), F.first("n").alias("all"))
    # From rest the traction is half the swing.
    best = jitter_tolerance * F.least(F.greatest(0.05 * F.sqrt("all"), jitter_tolerance * F.col("swing") / 2 / (F.col("all") * F.col("all"))), F.lit(10.0))
    speed = swing.select("graph_id", (1 + F.when(F.col("swing") > 0, F.least(best / 2 - 1, F.lit(0.5))).otherwise(0.5)).alias("speed"))
    step = F.col("speed") / (1 + F.sqrt(F.col("speed") * F.col("own")))
    return at.join(speed, "graph_id").select("graph_id", "pos", (F.col("x") + F.col("fx") * step).alias("x"), (F.col("y") + F.col("fy") * step).alias("y"))


def cells(layout: DataFrame, size: float, low: float = 0.0) -> DataFrame:
    """layout with the grid cell (cx, cy) of each vertex; low is the grid's lower end on both axes."""
    return layout.withColumns({f"c{c}": F.floor((F.col(c) - low) / F.lit(size)).cast("long") for c in ("x", "y")})


def cell_neighbours(at: DataFrame) -> DataFrame:
    """(graph_id, i, j): ordered pairs of vertices of cells() in the same cell or in cells that share a side. An equi-join on the cells."""
    side = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = at.select("graph_id", F.col("pos").alias("i"), side.alias("c")).select("graph_id", "i", "c.cx", "c.cy")
    return near.join(at.select("graph_id", "cx", "cy", F.col("pos").alias("j")), ["graph_id", "cx", "cy"]).where("i <> j").select("graph_id", "i", "j")


def cell_counts(at: DataFrame) -> DataFrame:
    """at of cells() with near: how many pairs cell_neighbours() has of each vertex, for those that have any. Counted by cell, so no pair is made."""
    n = at.groupBy("graph_id", "cx", "cy").agg(F.count("*").alias("n"))
    side = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    around = n.select("graph_id", side.alias("c"), "n").groupBy("graph_id", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy")).agg(F.sum("n").alias("all"))
    return at.join(around, ["graph_id", "cx", "cy"]).withColumn("near", F.col("all") - 1).drop("all").where("near > 0")


def fr_step(g: Graph, layout: DataFrame, k: float, temperature: float) -> DataFrame:
    e = g.both_ways().groupBy("graph_id", F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("w").alias("w"))
    p = _pairs(layout).join(e, ["graph_id", "i", "j"], "left")
    f = F.lit(k * k) / (F.col("d") * F.col("d")) - F.coalesce("w", F.lit(0.0)) * F.col("d") / k
    force = p.groupBy("graph_id", F.col("i").alias("pos")).agg(F.sum(f * F.col("dx")).alias("fx"), F.sum(f * F.col("dy")).alias("fy")).withColumn("f", F.hypot("fx", "fy"))
    move = F.when(F.col("f") > 0, F.least("f", F.lit(temperature)) / F.col("f")).otherwise(0.0)
    return layout.join(force, ["graph_id", "pos"]).select("graph_id", "pos", (F.col("x") + F.col("fx") * move).alias("x"), (F.col("y") + F.col("fy") * move).alias("y"))
