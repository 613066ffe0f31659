"""Packing of several layouts: boxes are aggregated in Spark, one row a layout is solved in one task, points are moved by a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import transforms as T
from vertexloom.operators.kernels import pack_circles, pack_rectangles

MOVES = "layout_id long, mx double, my double"


def boxes(layouts: DataFrame) -> DataFrame:
    """(layout_id, cx, cy, width, height, r2): the box, its middle and the greatest squared distance from it."""
    box = layouts.groupBy("layout_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = box.select("layout_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    far = layouts.join(box, "layout_id").groupBy("layout_id").agg(F.max(F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0))).alias("r2"))
    return box.join(far, "layout_id")


def _moved(layouts: DataFrame, moves: DataFrame, center) -> DataFrame:
    out = layouts.join(moves, "layout_id").select((F.col("x") + F.col("mx")).alias("x"), (F.col("y") + F.col("my")).alias("y"), "id", "layout_id")
    return T.recenter_many(out, center)


def circular(layouts: DataFrame, padding: float | None = None, center=None) -> DataFrame:
    """layouts(layout_id, id, x, y) -> (x, y, id, layout_id). Padding is 0.16 of the least positive squared radius unless given.

    No layouts give an empty result; a layout without points has no rows, and the others keep their layout_id; a single one is only moved to the center.
    """

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("layout_id")
        r2 = b["r2"].to_numpy(float)
        pad = padding if padding is not None else 0.16 * (r2[r2 > 0].min() if (r2 > 0).any() else 0.0)
        at = pack_circles(np.sqrt(r2) + pad / 2)
        return pd.DataFrame({"layout_id": b["layout_id"], "mx": at[:, 0] - b["cx"], "my": at[:, 1] - b["cy"]})

    return _moved(layouts, boxes(layouts).groupBy().applyInPandas(solve, MOVES), center)


def rectangular(layouts: DataFrame, padding: float = 0.0, center=None, max_width=None, max_height=None) -> DataFrame:
    """layouts(layout_id, id, x, y) -> (x, y, id, layout_id), in rows of boxes. Empty, single and pointless layouts as in circular()."""

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("layout_id")
        w, h = b["width"].to_numpy(float) + padding / 2, b["height"].to_numpy(float) + padding / 2
        unit = 1000 / max(w.max(), h.max()) if max(w.max(), h.max()) > 0 else 1000.0
        grid = lambda v: None if v is None else int(v * unit)
        at = pack_rectangles(np.c_[(w * unit).astype(int), (h * unit).astype(int)], grid(max_width), grid(max_height)) / unit
        return pd.DataFrame({"layout_id": b["layout_id"], "mx": at[:, 0] - b["cx"] + b["width"] / 2, "my": at[:, 1] - b["cy"] + b["height"] / 2})

    return _moved(layouts, boxes(layouts).groupBy().applyInPandas(solve, MOVES), center)
