"""Figures that must not grow faster than the input, on small tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.model import Graph, dealt, numbered
from vertexloom.operators import kernels as K
from vertexloom.operators import manifold as M
from vertexloom.operators import primitives as G
from vertexloom.operators import stress as X


def test_vectors_move_a_few_times_each(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((20_000, 2)).astype(np.float32)
    v[:3000] = v[0]  # a large group of equal vectors
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "v long, e array<float>")
    found = M.knn(df, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "42), 8)" in plan  # blocks of 2,048 were 10, and grew with the table
    got = {}
    for r in found.where("source % 4999 = 1").orderBy("source", "distance", "target").collect():
        got.setdefault(r.source, []).append((r.target, r.distance))
    for s in (1, 5000, 9999, 14998, 19997):
        d = np.sqrt(((v[s].astype(float) - v) ** 2).sum(1))
        d[s] = np.inf
        assert got[s] == [(t, d[t]) for t in np.lexsort((np.arange(len(v)), d))[:2].tolist()]


def test_odd_vectors(spark):
    one = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "v long, e array<double>")
    assert {(r.source, r.target) for r in M.knn(one([0.0], [1.0], [float("nan")], [float("inf")]), 3).collect()} == {(0, 1), (1, 0)}
    with pytest.raises(Exception, match="same length"):
        M.knn(one([0.0], [1.0, 2.0]), 1).collect()


def test_given_distances_are_worked_out_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    d = spark.createDataFrame([(i, i + 1, float(i)) for i in range(50)], "source long, target long, distance double").mapInArrow(seen, "source long, target long, distance double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "source long, target long")
    assert {(r.source, r.distance) for r in M.edge_distances(edges, d).collect()} == {(i, float(i)) for i in range(50)}
    assert ran.value == 50


def test_graphs_that_are_alike_are_solved_once_a_task(spark):
    ran = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(7)
    v = [(g, i) for g in range(60) for i in range(3 + g % 2)]
    e = [(g, i, i + 1) for g in range(60) for i in range(2 + g % 2)] + [(58, 2, 0), (99, 0, 1)]
    xy = {(g, i): rng.uniform(-1, 1, 2).tolist() if g in (10, 11) else [float(i), float(i * i)] for g, i in v}
    many = Graph.of(spark.createDataFrame(v, "graph_id long, v long"), spark.createDataFrame(e, "graph_id long, src long, dst long"))
    initial = spark.createDataFrame([(g, i, *p) for (g, i), p in xy.items()], "graph_id long, pos int, x double, y double")

    def kernel(n, edges, weights, start, fixed):
        ran.add(1)
        return K.spring(n, edges, weights, start, fixed=fixed)

    fixed = initial.where("pos = 0 AND graph_id <> 12")
    got = {(r.graph_id, r.pos): (r.x, r.y) for r in many.lay_out(kernel, initial, fixed).collect()}
    assert set(got) == set(v)
    for g in range(60):
        n = 3 + g % 2
        edges = np.array(sorted((s, t) for h, s, t in e if h == g))
        want = K.spring(n, edges, np.ones(len(edges)), np.array([xy[g, i] for i in range(n)]), fixed=[] if g == 12 else [0])
        assert [got[g, i] for i in range(n)] == [tuple(p) for p in want]
    # Of 3 and of 4 vertices, two with places of their own, one with nothing fixed, one with an edge more.
    assert ran.value == 6


def test_neighbours_are_counted_by_cell(spark):
    p = np.random.default_rng(3).integers(0, 9, (60, 2)) / 2
    df = spark.createDataFrame([(i % 2, i // 2, float(x), float(y)) for i, (x, y) in enumerate(p)], "graph_id long, pos int, x double, y double")
    at = X.cells(df, 0.5)
    want = {(r.graph_id, r.i): r["count"] for r in X.cell_neighbours(at).groupBy("graph_id", "i").count().collect()}
    assert 0 < len(want) < 60 and {(r.graph_id, r.pos): r.near for r in X.cell_counts(at).collect()} == want
    # A million vertices in one cell: pairs would be 10^12.
    crowd = spark.range(1_000_000).selectExpr("0L AS graph_id", "cast(id AS int) AS pos", "0.1D AS x", "0.1D AS y")
    assert X.cell_counts(X.cells(crowd, 0.5)).agg({"near": "sum"}).first()[0] == 1_000_000 * 999_999


def test_bipartition_of_long_and_odd_graphs(spark):
    def sides(n, edges, directed=False):
        g = Graph.of(spark.range(n).select(F.col("id").alias("v")), spark.createDataFrame(edges, "src long, dst long"), directed)
        return [r.side for r in G.bipartition(g).orderBy("pos").collect()]

    rng = np.random.default_rng(8)
    n, color = 300, rng.integers(0, 2, 300)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (450, 2)) if color[a] != color[b]]
    near, want = {v: set() for v in range(n)}, [None] * n
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for v in range(n):
        todo = [(v, 0)] if want[v] is None else []
        while todo:
            w, s = todo.pop()
            if want[w] is None:
                want[w] = s
                todo += [(x, 1 - s) for x in near[w]]
    assert sides(n, edges, True) == want
    for circle in (5, 6):
        ring = [(i, (i + 1) % circle) for i in range(circle)]
        if circle % 2:
            with pytest.raises(ValueError):
                sides(circle + 2, ring)
        else:
            assert sides(circle + 2, ring) == [0, 1, 0, 1, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        sides(3, [(0, 1), (1, 1)])


def test_long_paths_take_few_rounds_to_part(spark, monkeypatch):
    cuts, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: cuts.append(1) or cut(df))
    n = 200
    order = np.random.default_rng(9).permutation(n).tolist()
    path = spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long")
    got = {r.pos: r.side for r in G.bipartition(Graph.of(spark.range(n).select(F.col("id").alias("v")), path)).collect()}
    first = order.index(0)
    assert got == {v: abs(k - first) % 2 for k, v in enumerate(order)}
    assert len(cuts) < 60  # a breadth-first search has a round for each step of the path


def test_vertices_of_one_graph_are_numbered_in_several_tasks(spark):
    v = np.random.default_rng(10).permutation(5000).tolist()
    df = spark.createDataFrame([(0, 3 * i) for i in v], "graph_id long, v long")
    got = numbered(df, 700)
    assert {r.v: r.pos for r in got.collect()} == {3 * i: i for i in range(5000)}
    assert dict(got.dtypes)["pos"] == "int" and dict(numbered(df).dtypes)["pos"] == "int"
    most = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg({"count": "max"}).first()[0]
    assert most < 5000


def test_many_rows_are_dealt_over_tasks(spark):
    df = spark.range(10)
    assert dealt(df, 500_000, "id") is df and dealt(df, 1_200_000, "id").rdd.getNumPartitions() == 3


def test_distances_send_nothing_through_the_driver(spark, monkeypatch):
    plans, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    e = spark.createDataFrame([(g, i, i + 1) for g in range(4) for i in range(4)], "graph_id long, src long, dst long")
    g = Graph.of(spark.createDataFrame([(g, i) for g in range(4) for i in range(5)], "graph_id long, v long"), e)
    got = {(r.graph_id, r.i, r.j): r.d for r in G.distances(g).collect()}
    assert got == {(g, i, j): abs(i - j) for g in range(4) for i in range(5) for j in range(5)}
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans[2:])


def test_embedding_moves_as_it_did_in_a_tenth_of_the_time():
    def by_arrays(n, edges, weights, negative, epochs, fixed, seed=0):
        a, b = K.find_ab(1.0, 0.1)
        rng, p = np.random.default_rng(seed), K.start(n, None, seed)
        free = np.ones(n, bool)
        free[fixed] = False
        p[free] = 10 * (p[free] - p[free].min(0)) / np.ptp(p[free], axis=0)
        due = 1 / weights
        for epoch in range(epochs):
            alpha = 1 - epoch / epochs
            for e in np.flatnonzero(due <= epoch):
                i, j = edges[e]
                due[e] += 1 / weights[e]
                if not free[i]:
                    continue
                delta = p[i] - p[j]
                d2 = delta @ delta
                if d2 >= 1e-7:
                    g = np.clip(-2 * a * b * d2 ** (b - 1) / (a * d2**b + 1) * delta, -4, 4) * alpha
                    p[i] += g
                    if free[j]:
                        p[j] -= g
                for k in rng.integers(0, n, negative):
                    delta = p[i] - p[k]
                    d2 = delta @ delta
                    if k != i and d2 >= 1e-14:
                        p[i] += np.clip(2 * b / ((1e-3 + d2) * (a * d2**b + 1)) * delta, -4, 4) * alpha
        return p

    rng = np.random.default_rng(11)
    edges, weights = rng.integers(0, 200, (2000, 2)), rng.uniform(0.05, 1, 2000)
    times = [time.perf_counter()]
    for f in (lambda: by_arrays(200, edges, weights, 2, 20, [3]), lambda: K.umap(200, edges, weights, None, negative_rate=2, max_iter=20, fixed=[3])):
        times += [f(), time.perf_counter()]
    np.testing.assert_allclose(times[3], times[1], atol=1e-6)
    assert times[4] - times[2] < (times[2] - times[0]) / 4


def test_pushes_in_cells_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(K, "AT_ONCE", 30)
    for wide in (3.0, 40.0, 1e-5):  # the last in cells whose numbers don't fit a sorting key
        p, all_ = rng.uniform(-90, 90, (150, 2)), rng.permutation(150)[:120]
        cell = np.floor((p[all_] + 150) / wide)
        force = rng.uniform(-1, 1, p.shape)
        want = force.copy()
        i, j = (all_[x] for x in K._in_cells(cell))
        delta = p[i] - p[j]
        d = np.hypot(*delta.T)
        push = delta * (9.0**2 * (1 / d - d**2 / (np.pi * 150**3)) / d)[:, None]
        np.add.at(want, i, push)
        np.add.at(want, j, -push)
        order, begins = K._by_cells(cell)
        assert (order == np.lexsort(cell.T)).all() and begins.sum() == len(np.unique(cell, axis=0))
        K._push_in_cells(force, p, all_[order], begins, 9.0, 1e-6)
        assert (force == want).all()
