"""Closed-form layouts: expressions of a vertex's position in its graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vertexloom.functions import transforms as T
from vertexloom.model import Graph
from vertexloom.plans.loops import cut


def by_pos() -> WindowSpec:
    return Window.partitionBy("graph_id").orderBy("pos")


def so_far() -> WindowSpec:
    return by_pos().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _at(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.withColumns({"x": x, "y": y}).select("graph_id", "v", "pos", "x", "y")


def line(g: Graph, theta: float = 0.0, scale: float = 1.0, center=None) -> DataFrame:
    i = F.col("pos").cast("double")
    return T.recenter(_at(g.vertices, i * math.cos(theta) * scale, i * math.sin(theta) * scale), center)


def circle(g: Graph, radius: float = 1.0, theta: float = 0.0, center=(0.0, 0.0), sizes: DataFrame | None = None) -> DataFrame:
    """sizes(graph_id, pos, size): a wedge for each vertex, with vertex 0 at its start and the others in its middle."""
    df = g.sized()
    if sizes is None:
        angle = 2 * math.pi * F.col("pos") / F.col("n") + theta
    else:
        df = df.join(sizes, ["graph_id", "pos"])
        df = df.withColumn("c", F.sum("size").over(so_far()) / F.sum("size").over(T.each()))
        angle = F.when(F.col("pos") == 0, 0.0).otherwise(math.pi * (F.lag("c", 1, 0.0).over(by_pos()) + F.col("c"))) + theta
    df = df.withColumn("angle", angle)
    one = F.col("n") == 1
    return _at(df, F.when(one, 0.0).otherwise(radius * F.cos("angle")) + float(center[0]), F.when(one, 0.0).otherwise(radius * F.sin("angle")) + float(center[1]))


def uniform(pos: Column, seed: int) -> Column:
    """A number in [0, 1) from pos and seed, the same in any engine with 64-bit integers."""
    m = F.lit(2147483647).cast("long")
    h = (pos.cast("long") * 48271 + seed * 69621 + 1) % m
    return ((h * h + pos + 11) % m).cast("double") / F.lit(2147483647.0)


def random(g: Graph, xmin=-1.0, xmax=1.0, ymin=-1.0, ymax=1.0, seed: int = 0, sizes: DataFrame | None = None, max_tries: int = 10) -> DataFrame:
    """sizes(graph_id, pos, size): disks of these radii that must not overlap; ValueError if some still do after max_tries draws."""
    draw = lambda df, s: _at(df, xmin + (xmax - xmin) * uniform(F.col("pos"), 2 * s), ymin + (ymax - ymin) * uniform(F.col("pos"), 2 * s + 1))
    out = draw(g.vertices, seed)
    if sizes is None:
        return out
    for attempt in range(1, max_tries + 1):
        bad = conflicts(out, sizes).select("graph_id", F.col("b").alias("pos")).distinct()
        if bad.isEmpty():
            return out
        again = draw(out.join(bad, ["graph_id", "pos"], "left_semi").drop("x", "y"), seed + attempt)
        out = cut(out.join(bad, ["graph_id", "pos"], "left_anti").unionByName(again))
    if not conflicts(out, sizes).isEmpty():
        raise ValueError("no placement without overlaps was found")
    return out




def conflicts(layout: DataFrame, sizes: DataFrame) -> DataFrame:
    """(graph_id, a, b) of the pairs a < b whose disks overlap, by a grid of cells as wide as the largest disk."""
    d = layout.join(sizes, ["graph_id", "pos"]).withColumn("cell", 2 * F.max("size").over(T.each()))
    d = d.withColumns({"cx": F.floor(F.col("x") / F.col("cell")), "cy": F.floor(F.col("y") / F.col("cell"))})
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    other = d.select("graph_id", F.col("pos").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("size").alias("bs"), near.alias("k"), "cx", "cy")
    other = other.select("graph_id", "b", "bx", "by", "bs", (F.col("cx") + F.col("k.i")).alias("cx"), (F.col("cy") + F.col("k.j")).alias("cy"))
    hit = d.join(other, ["graph_id", "cx", "cy"]).where("pos < b").where(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) < F.col("size") + F.col("bs"))
    return hit.select("graph_id", F.col("pos").alias("a"), "b")


def shell(g: Graph, shells: DataFrame, scale: float = 1.0, center=(0.0, 0.0), theta: float = 0.0) -> DataFrame:
    """shells(graph_id, pos, shell, j): the j-th of its shell, both from 0."""
    w = Window.partitionBy("graph_id", "shell")
    df = g.vertices.join(shells, ["graph_id", "pos"]).withColumns({"m": F.count("*").over(w), "k": F.max("shell").over(T.each()) + 1})
    df = df.withColumn("m0", F.max(F.when(F.col("shell") == 0, F.col("m"))).over(T.each()))
    r = F.when(F.col("m0") > 1, scale / F.col("k") * (F.col("shell") + 1)).otherwise(F.when(F.col("k") == 1, 0.0).otherwise(scale / (F.col("k") - 1) * F.col("shell")))
    df = df.withColumns({"r": r, "t": theta + 2 * math.pi * F.col("j") / F.col("m")})
    return _at(df, F.col("r") * F.cos("t") + float(center[0]), F.col("r") * F.sin("t") + float(center[1]))


def spiral(g: Graph, scale: float = 1.0, center=(0.0, 0.0), slope: float = 0.25, exponent: float = 1.0, theta: float = 0.0) -> DataFrame:
    df = g.sized().withColumn("r", F.pow((F.col("pos") + 1) * F.lit(float(slope)), F.lit(float(exponent))))
    df = df.withColumns({"t": theta + F.sum(1 / F.col("r")).over(so_far()), "s": scale / F.max("r").over(T.each())})
    one = F.col("n") == 1
    return _at(df, F.when(one, 0.0).otherwise(F.col("r") * F.col("s") * F.cos("t")) + float(center[0]), F.when(one, 0.0).otherwise(F.col("r") * F.col("s") * F.sin("t")) + float(center[1]))


def grid(g: Graph, width: int, shape: str = "square", trim_even_rows: bool = False, center=None) -> DataFrame:
    if width < 1 or shape not in ("square", "triangle") or trim_even_rows and width < 2:
        raise ValueError("width must be positive (2 for trimmed rows) and shape square or triangle")
    i = F.col("pos")
    if shape == "square":
        x, y = (i % width).cast("double"), F.floor(i / width).cast("double")
    elif not trim_even_rows:
        row = F.floor(i / width)
        x, y = i % width + 0.5 * (row % 2), row * (math.sqrt(3) / 2)
    else:
        q, m = F.floor(i / (2 * width - 1)), i % (2 * width - 1)
        x = F.when(m < width, m.cast("double")).otherwise(m - width + 0.5)
        y = (2 * q + F.when(m < width, 0).otherwise(1)) * (math.sqrt(3) / 2)
    return T.recenter(_at(g.vertices, x, y), center)


def bipartite(g: Graph, sides: DataFrame, distance: float = 1.0, theta: float = 0.0) -> DataFrame:
    """sides(graph_id, pos, side): 0 for the first set."""
    df = g.vertices.join(sides, ["graph_id", "pos"]).withColumn("i", F.row_number().over(Window.partitionBy("graph_id", "side").orderBy("pos")) - 1)
    c, s = math.cos(theta), math.sin(theta)
    return _at(df, F.col("side") * distance * c + F.col("i") * s, F.when(F.col("side") == 0, F.col("i") * c).otherwise(F.col("i") * c - distance * s))


def multipartite(g: Graph, layers: DataFrame, distance: float = 1.0, theta: float = 0.0, ycenter: bool = False) -> DataFrame:
    """layers(graph_id, pos, layer, j)."""
    w = Window.partitionBy("graph_id", "layer")
    df = g.vertices.join(layers, ["graph_id", "pos"]).withColumn("m", F.count("*").over(w))
    y = F.col("j") - (F.col("m") - 1) / 2 if ycenter else F.col("j").cast("double")
    return T.rotate(_at(df, F.col("layer") * F.lit(float(distance)), y), theta)
