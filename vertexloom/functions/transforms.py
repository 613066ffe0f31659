"""Coordinate transforms as columns and window expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def each() -> WindowSpec:
    return Window.partitionBy("graph_id")


def tidy(c: Column) -> Column:
    """Rounded to six places and never minus zero."""
    return F.round(c, 6) + F.lit(0.0)


def tidied(layout: DataFrame) -> DataFrame:
    return layout.withColumns({"x": tidy(F.col("x")), "y": tidy(F.col("y"))})


def recenter(layout: DataFrame, center: tuple[float, float] | None) -> DataFrame:
    """Subtracts the middle of the least and greatest of all coordinates, x and y pooled, then adds center."""
    if center is None:
        return layout
    lo, hi = F.least(F.min("x").over(each()), F.min("y").over(each())), F.greatest(F.max("x").over(each()), F.max("y").over(each()))
    mid = layout.withColumn("_m", (lo + hi) / 2)
    return mid.withColumns({"x": F.col("x") - F.col("_m") + float(center[0]), "y": F.col("y") - F.col("_m") + float(center[1])}).drop("_m")


def recenter_many(layouts: DataFrame, center: tuple[float, float] | None) -> DataFrame:
    """Moves all layouts together so that the middle of their common bounding box is center."""
    if center is None:
        return layouts
    box = layouts.agg(((F.min("x") + F.max("x")) / 2).alias("_x"), ((F.min("y") + F.max("y")) / 2).alias("_y"))
    out = layouts.join(F.broadcast(box))  # one row
    return out.withColumns({"x": F.col("x") - F.col("_x") + float(center[0]), "y": F.col("y") - F.col("_y") + float(center[1])}).drop("_x", "_y")


def rescale(layout: DataFrame, scaling: float) -> DataFrame:
    """Makes the larger of the two ranges scaling."""
    span = F.greatest(F.max("x").over(each()) - F.min("x").over(each()), F.max("y").over(each()) - F.min("y").over(each()))
    out = layout.withColumn("_s", F.when(span > 0, scaling / span).otherwise(1.0))
    return out.withColumns({"x": F.col("x") * F.col("_s"), "y": F.col("y") * F.col("_s")}).drop("_s")


def mean_shift(layout: DataFrame, center: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    return layout.withColumns({c: F.col(c) - F.avg(c).over(each()) + float(v) for c, v in zip("xy", center)})


def max_abs_rescale(layout: DataFrame, radius: float) -> DataFrame:
    top = F.max(F.greatest(F.abs("x"), F.abs("y"))).over(each())
    out = layout.withColumn("_s", F.when(top > 0, radius / top).otherwise(1.0))
    return out.withColumns({"x": F.col("x") * F.col("_s"), "y": F.col("y") * F.col("_s")}).drop("_s")


def rotate(layout: DataFrame, theta: float) -> DataFrame:
    c, s = math.cos(theta), math.sin(theta)
    return layout.withColumns({"x": F.col("x") * c + F.col("y") * s, "y": F.col("y") * c - F.col("x") * s})


def shift(layout: DataFrame, by: tuple[float, float]) -> DataFrame:
    return layout.withColumns({"x": F.col("x") + float(by[0]), "y": F.col("y") + float(by[1])})
