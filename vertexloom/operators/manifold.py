"""The stages of the neighbour embedding that are relational: neighbours, membership weights, symmetrisation, schedule, Jacobi epoch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.plans.loops import cut


#: Vectors of a block at most; fewer vectors make up to SPREAD blocks of FEW vectors at least, so that there are tasks enough.
BLOCK, FEW, SPREAD = 32_768, 1024, 8
#: Rows and columns of distances that are worked out at once.
TILE = 256, 2048


def nearest(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of the vectors a the k nearest of b other than itself, ties by id: (id, other's id, distance).

    Matrix products give rough distances; all pairs that rounding leaves in question are worked out one by one.
    """
    # Vectors of no finite length have no distances.
    (ids, a), (others, b) = ((i[ok], v[ok]) for i, v in ((ids, a), (others, b)) for ok in [np.isfinite((v.astype(float) ** 2).sum(1))])
    if not len(a) or not len(b):
        return ids[:0], others[:0], np.zeros(0)
    # Of equal vectors none but the k + 1 first by id can be among the nearest.
    order = np.argsort(others, kind="stable")
    same = np.unique(np.ascontiguousarray(b[order]).view(f"V{b.shape[1] * b.itemsize}").ravel(), return_inverse=True)[1]
    by = np.argsort(same, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(same[by]) != 0])
    nth = np.arange(len(by)) - np.repeat(begin, np.diff(np.r_[begin, len(by)]))
    keep = np.sort(order[by[nth <= k]])
    others, b = others[keep], b[keep]
    a, b = a.astype(float), b.astype(float)
    bb = (b * b).sum(1)
    # The products round by this share of the norms at most, with room to spare.
    slack = 8 * (a.shape[1] + 4) * np.finfo(float).eps
    out = []
    for i in range(0, len(a), TILE[0]):
        x, own = a[i : i + TILE[0]], ids[i : i + TILE[0]]
        xx = (x * x).sum(1)
        loose = slack * (xx + bb.max())
        best, found = np.full((len(x), k), np.inf), []
        for j in range(0, len(b), TILE[1]):
            rough = x @ b[j : j + TILE[1]].T
            rough *= -2
            rough += bb[j : j + TILE[1]]
            rough[own[:, None] == others[j : j + TILE[1]]] = np.inf
            if j == 0 and rough.shape[1] > k:
                best = np.partition(rough, k - 1, axis=1)[:, :k]
            bar = best.max(1) + loose
            r, c = np.divmod(np.flatnonzero(rough <= bar[:, None]), rough.shape[1])
            got = rough[r, c]
            r, c, got = (z[got < np.inf] for z in (r, c, got))
            found.append((r, c + j, got))
            if len(r) and (j or rough.shape[1] <= k):
                at = np.arange(len(r)) - np.searchsorted(r, r)
                more = np.full((len(x), at.max() + 1), np.inf)
                more[r, at] = got
                best = np.partition(np.c_[best, more], k - 1, axis=1)[:, :k]
        r, c, got = map(np.concatenate, zip(*found))
        r, c = (z[got <= (best.max(1) + loose)[r]] for z in (r, c))
        d = np.concatenate([np.zeros(0), *(np.sqrt(((x[r[m : m + 65536]] - b[c[m : m + 65536]]) ** 2).sum(1)) for m in range(0, len(r), 65536))])
        by = np.lexsort((others[c], d, r))
        r, c, d = r[by], c[by], d[by]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((own[r[top]], others[c[top]], d[top]))
    return tuple(map(np.concatenate, zip(*out)))


def knn(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(source, target, distance): exact Euclidean neighbours of vectors(v, e), ties by id.

    Every row is a query. Blocks of rows meet in tasks of bounded memory, as matrix products, and leave the k best of each row
    there. All pairs are compared; a row moves once for each block, in the type that e has.
    """
    rows = vectors.select(F.col("v").cast("long").alias("v"), F.col("e") if dict(vectors.dtypes)["e"] == "array<float>" else F.col("e").cast("array<double>").alias("e"))
    total = rows.count()
    n = max(1, -(-total // block), min(SPREAD, -(-total // FEW)))
    sides = [rows.withColumn(own, F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n * n, "p", "q") for own, other in (("p", "q"), ("q", "p"))]

    def arrays(x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        e = x["e"].combine_chunks()
        if len(set(e.value_lengths().to_pylist())) > 1 or e.null_count:
            raise ValueError("all vectors must have the same length")
        return x["v"].to_numpy(), e.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = nearest(*arrays(left), *arrays(right), k) if len(left) and len(right) else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], ["source", "target", "distance"])

    found = sides[0].groupBy("p", "q").cogroup(sides[1].groupBy("p", "q")).applyInArrow(best, "source long, target long, distance double")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("distance", "target"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def edge_distances(edges: DataFrame, distances: DataFrame | dict | float | None = None) -> DataFrame:
    """(source, target, distance) of edges(source, target): from a DataFrame with these columns, a dictionary of pairs, one number for all, or 1.0. TypeError for anything else; ValueError if an edge has none."""
    pairs = edges.select("source", "target")
    if distances is None or isinstance(distances, (int, float)):
        return pairs.withColumn("distance", F.lit(1.0 if distances is None else float(distances)))
    if isinstance(distances, dict):
        distances = edges.sparkSession.createDataFrame([(int(i), int(j), float(d)) for (i, j), d in distances.items()], "source long, target long, distance double")
    if not isinstance(distances, DataFrame):
        raise TypeError("distances must be a DataFrame, a dictionary, a number or None")
    out = cut(pairs.join(distances.select("source", "target", F.col("distance").cast("double").alias("distance")), ["source", "target"], "left"))
    if not out.where("distance IS NULL").isEmpty():
        raise ValueError("an edge has no distance")
    return out


def unweighted(edges: DataFrame) -> DataFrame:
    """(source, target, weight) of edges(source, target): each pair once, source < target, weight 1."""
    ends = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return ends.where("source < target").distinct().withColumn("weight", F.lit(1.0))


def probability(distance: Column, sigma: Column, rho: Column) -> Column:
    return F.when((distance <= rho) | (sigma == 0), 1.0).otherwise(F.exp(-(distance - rho) / sigma))


def sigmas(edges: DataFrame, bandwidth: float = 1.0, rounds: int = 64) -> DataFrame:
    """(source, sigma, rho) of edges(source, target, distance), as McInnes et al. (2018) define them.

    rho is the least positive distance; sigma makes the memberships of all neighbours but the nearest add up to the
    logarithm of their number, and is a thousandth of the mean distance at least. All sources are bisected at once.
    """
    each = edges.groupBy("source").agg(F.sort_array(F.collect_list(F.col("distance").cast("double"))).alias("d"))
    each = each.withColumn("rho", F.coalesce(F.array_min(F.filter("d", lambda x: x > 0)), F.lit(0.0))).withColumn("want", F.log2(F.size("d")) * bandwidth)
    over = F.transform(F.slice("d", 2, F.size("d")), lambda x: F.greatest(x - F.col("rho"), F.lit(0.0)))
    each = each.withColumn("over", over)

    def halve(state: Column, _: Column) -> Column:
        total = F.aggregate("over", F.lit(0.0), lambda t, x: t + F.exp(-x / state["at"]))
        more, less = total > F.col("want") + 1e-5, total < F.col("want") - 1e-5
        lo, hi = F.when(less, state["at"]).otherwise(state["lo"]), F.when(more, state["at"]).otherwise(state["hi"])
        to = F.when(more, (state["lo"] + state["at"]) / 2).when(less & state["hi"].isNull(), state["at"] * 2).when(less, (state["at"] + state["hi"]) / 2).otherwise(state["at"])
        return F.struct(to.alias("at"), lo.alias("lo"), hi.alias("hi"))

    first = F.struct(F.lit(1.0).alias("at"), F.lit(0.0).alias("lo"), F.lit(None).cast("double").alias("hi"))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, halve, lambda s: s["at"])
    mean = F.aggregate("d", F.lit(0.0), lambda t, x: t + x) / F.size("d")
    return each.select("source", F.greatest(at, 1e-3 * mean).alias("sigma"), "rho")


def symmetrise(edges: DataFrame, operation: str = "union") -> DataFrame:
    """Of edges(source, target, weight), one row for each unordered pair."""
    w, n = F.col("weight"), F.count("*")
    how = {"union": F.sum(w) - (n - 1) * F.product(w), "intersection": F.product(w), "max": F.max(w), "min": F.min(w), "mean": F.avg(w)}
    if operation not in how:
        raise ValueError(f"operation must be one of {', '.join(how)}")
    return edges.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(how[operation].alias("weight"))


def firing(edges: DataFrame, epochs: int) -> DataFrame:
    """(source, target, fired): in how many of the epochs an edge of that weight fires."""
    return edges.select("source", "target", F.least(F.floor(F.lit(epochs - 1) * F.col("weight")), F.lit(epochs)).cast("long").alias("fired"))


def jacobi_epoch(edges: DataFrame, at: DataFrame, a: float, b: float, alpha: float) -> DataFrame:
    """One epoch of attraction with every edge at once: at(v, x, y) -> moved."""
    s, t = (at.select(F.col("v").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}")) for n in ("source", "target"))
    e = edges.join(s, "source").join(t, "target").withColumns({"dx": F.col("x_source") - F.col("x_target"), "dy": F.col("y_source") - F.col("y_target")})
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    e = e.withColumn("f", F.when(d2 < 1e-7, 0.0).otherwise(-2 * a * b * F.pow(d2, F.lit(b - 1)) / (a * F.pow(d2, F.lit(b)) + 1)))
    clip = lambda c: F.greatest(F.least(c, F.lit(4.0)), F.lit(-4.0)) * alpha
    g = e.select("source", "target", clip(F.col("f") * F.col("dx")).alias("gx"), clip(F.col("f") * F.col("dy")).alias("gy"))
    moves = g.select(F.col("source").alias("v"), "gx", "gy").union(g.select("target", -F.col("gx"), -F.col("gy"))).groupBy("v").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
    return at.join(moves, "v", "left").select("v", (F.col("x") + F.coalesce("gx", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("gy", F.lit(0.0))).alias("y"))
