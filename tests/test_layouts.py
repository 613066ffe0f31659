import inspect
import math

import numpy as np
import pytest

from vertexloom.model import Graph
from vertexloom.operators import kernels as K
from vertexloom.operators import manifold as M
from vertexloom.operators import packing as P
from vertexloom.operators import primitives as G
from vertexloom.operators import shapes as S
from vertexloom.operators import trees as R


def graph(spark, n, edges=(), directed=False):
    v = spark.createDataFrame([(i,) for i in range(n)], "v long")
    return Graph.of(v, spark.createDataFrame(list(edges), "src long, dst long"), directed)


def xy(df, key="pos"):
    p = df.toPandas().sort_values(key)
    return p[["x", "y"]].to_numpy()


PATH = np.array([[0, 1], [1, 2], [2, 3]])
START = np.array([[0.0, 0], [1, 0], [1, 1], [2, 1]])


def test_closed_forms(spark):
    g = graph(spark, 4)
    np.testing.assert_allclose(xy(S.circle(g)), [[1, 0], [0, 1], [-1, 0], [0, -1]], atol=1e-14)
    np.testing.assert_allclose(xy(S.line(g, math.pi / 2)), [[0, 0], [0, 1], [0, 2], [0, 3]], atol=1e-14)
    np.testing.assert_allclose(xy(S.grid(graph(spark, 6), 3)), [[0, 0], [1, 0], [2, 0], [0, 1], [1, 1], [2, 1]])
    np.testing.assert_allclose(xy(S.spiral(graph(spark, 10), slope=0.3))[0], [-0.098167, -0.019057], atol=1e-4)


def test_empty_and_single(spark):
    assert S.circle(graph(spark, 0)).count() == 0
    assert xy(S.circle(graph(spark, 1), center=(3.0, 4.0))).tolist() == [[3.0, 4.0]]
    assert graph(spark, 0).lay_out(K.spring).count() == 0


def test_shell(spark):
    shells = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 0), (0, 3, 1, 1), (0, 4, 1, 2), (0, 6, 1, 3), (0, 2, 2, 0), (0, 5, 2, 1)], "graph_id long, pos int, shell int, j int")
    np.testing.assert_allclose(xy(S.shell(graph(spark, 7), shells)), [[0, 0], [0.5, 0], [1, 0], [0, 0.5], [-0.5, 0], [-1, 0], [0, -0.5]], atol=1e-14)


def test_random_without_overlaps(spark):
    g = graph(spark, 20)
    size = g.vertices.selectExpr("graph_id", "pos", "0.02d AS size")
    assert S.conflicts(S.random(g, seed=1, sizes=size), size).isEmpty()
    with pytest.raises(ValueError):
        S.random(g, sizes=g.vertices.selectExpr("graph_id", "pos", "5.0d AS size"), max_tries=1)


def test_arf_golden():
    want = [[-0.00120306794437, -0.000308640753373], [1.00048578644, -0.00141421356237], [0.999414213562, 1.00131421356], [2.00110306794, 1.00030864075]]
    np.testing.assert_allclose(K.arf(4, PATH, np.ones(3), START, max_iter=1), want, atol=1e-11)
    # Those that the layout must have.
    want = [[-0.255030938115, 0.0583515167927], [1.24808329414, -0.574807096034], [0.649176834172, 1.46806023749], [2.12309612965, 0.950474896978]]
    np.testing.assert_allclose(K.arf(4, PATH, np.ones(3), START, max_iter=1000), want, atol=1e-11)


def test_forces_keep_fixed_and_finite():
    p = K.spring(4, PATH, np.ones(3), START, fixed=[0])
    assert (p[0] == START[0]).all() and np.isfinite(p).all()
    assert np.isfinite(K.forceatlas2(4, PATH, np.ones(3), START)).all()
    ring = np.array([[0, 1], [1, 2], [2, 3], [3, 0]])
    for steps, still in ((0, 4), (1, 3), (2, 2), (3, 1), (None, 0)):
        assert (K.gem(4, ring, np.ones(4), START, max_iter=steps) == START).all(1).sum() == still


def test_default_work_is_the_references():
    for f, steps in ((K.forceatlas2, 1000), (K.gem, 1000), (K.kamada_kawai, 15000), (K.umap, 100), (K.lgl, 1000)):
        assert inspect.signature(f).parameters["max_iter"].default == steps


def test_stress_layouts():
    p = K.neato(4, PATH, np.ones(3), np.array([[0.0, 0], [1, 0], [2, 1], [3, -3]]))
    np.testing.assert_allclose(np.hypot(*(p[1:] - p[:-1]).T), 1, atol=1e-2)
    p = K.geometric(3, np.array([[0, 1], [1, 2], [2, 0]]), np.array([10.0, 1, 10]), None, seed=42)
    np.testing.assert_allclose([np.hypot(*(p[0] - p[1])), np.hypot(*(p[1] - p[2])), np.hypot(*(p[2] - p[0]))], [10, 1, 10], rtol=1e-4)
    with pytest.raises(ValueError):
        K.mds(2, np.zeros((0, 2), int), np.zeros(0), None, True)


def test_lgl_star():
    for n in (1, 2, 4):
        p = K.lgl(n + 1, np.array([[0, i + 1] for i in range(n)]), np.ones(n), None, max_iter=0)
        np.testing.assert_allclose(np.hypot(*p[1:].T), n + 1)


def test_lgl_forces():
    # Two vertices in a cell by the wide grid: the edge pulls with d^3 / k, the cell pushes with k^2 (1 / d - d^2 / (pi n^3)).
    path = np.array([[0, 1], [1, 2]])
    still, moved = (K.lgl(3, path, np.ones(2), None, max_iter=m) for m in (0, 1))
    assert np.hypot(*(moved - still).T).max() > 0 and np.hypot(*(moved[1] - still[1])) > 0  # placed vertices of earlier layers move too
    # A star's vertices are one cell apart or more: only attraction acts, and the ring closes on the root.
    star = np.array([[0, i] for i in range(1, 5)])
    at, later = (K.lgl(5, star, np.ones(4), None, max_iter=m) for m in (0, 1000))
    vetted = np.abs(np.floor((at[1:] + 5) / 3) - np.floor((at[:1] + 5) / 3)).sum(1) <= 1
    assert np.isfinite(later).all() and (np.hypot(*(later[1:] - later[0]).T)[vetted] < np.hypot(*at[1:].T)[vetted]).all()
    i, j = K._in_cells(np.array([[0, 0], [1, 0], [0, 0], [0, 0], [1, 0]]))
    assert {frozenset(x) for x in zip(i.tolist(), j.tolist())} == {frozenset(x) for x in ((0, 2), (0, 3), (2, 3), (1, 4))} and len(i) == 4


# The drawings that these graphs must have.
@pytest.mark.parametrize("edges, want", [
    ([(0, 1), (1, 2)], [[0, 0], [0, 1], [0, 2]]),
    ([(0, 1), (0, 2)], [[0.5, 0], [0, 1], [1, 1]]),
    ([(0, 1), (2, 1)], [[0, 0], [0.5, 1], [1, 0]]),
    ([(0, 1), (0, 2), (1, 3), (2, 3)], [[0.5, 0], [0, 1], [1, 1], [0.5, 2]]),
    ([(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)], [[1.5, 0], [0.5, 1], [2.5, 1], [0, 2], [1, 2], [2, 2], [3, 2]]),
])
def test_sugiyama(edges, want):
    np.testing.assert_allclose(K.sugiyama(len(want), np.array(edges), np.ones(len(edges)), None), want, atol=1e-12)


def test_sugiyama_isolated():
    np.testing.assert_allclose(K.sugiyama(3, np.zeros((0, 2), int), np.zeros(0), None, hgap=0.3), [[0, 0], [0.3, 0], [0.6, 0]], atol=1e-12)


def test_dendrogram(spark):
    g = graph(spark, 9, [(0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7), (3, 8)])
    root = g.vertices.where("v = 0").select("graph_id", "pos")
    want = [[0, 0], [1, 0], [2, 0.5], [2, 3], [3, 0], [3, 1], [3, 2], [3, 3], [3, 4]]
    np.testing.assert_allclose(xy(R.rectangular_dendrogram(g, root)), want)
    got = xy(R.circular_dendrogram(g, root))
    t = -2 * np.pi * np.array(want)[:, 1] / 5
    np.testing.assert_allclose(got, np.array(want)[:, :1] * np.c_[np.cos(t), np.sin(t)], atol=1e-12)


def test_edgebundle(spark):
    link = spark.createDataFrame([(0, 0, 0, 1, 1.0), (0, 1, 2, 3, 2.0), (0, 2, 4, 5, 1.5)], "graph_id long, step int, c1 int, c2 int, dist double")
    routes = R.edgebundle(graph(spark, 4, [(0, 1), (1, 2), (2, 3)]), link)[1]
    got = {(r.src, r.dst): [(p.x, p.y) for p in r.waypoints] for r in routes.collect()}
    assert [len(got[k]) for k in ((0, 1), (1, 2), (2, 3))] == [1, 3, 1] and got[1, 2][1] == pytest.approx((0, 0), abs=1e-12)


def test_primitives(spark):
    g = graph(spark, 6, [(0, 1), (1, 2), (3, 4)])
    assert [r.comp for r in G.components(g).orderBy("pos").collect()] == [0, 0, 0, 3, 3, 5]
    d = {(r.i, r.j): r.d for r in G.distances(g).collect()}
    assert d[0, 2] == 2 and d[4, 3] == 1 and (0, 3) not in d
    assert [r.side for r in G.bipartition(g).orderBy("pos").collect()] == [0, 1, 0, 0, 1, 0]
    with pytest.raises(ValueError):
        G.bipartition(graph(spark, 3, [(0, 1), (1, 2), (2, 0)]))
    assert [r.degree for r in G.degrees(graph(spark, 2, [(0, 0)])).orderBy("pos").collect()] == [2, 0]


@pytest.mark.parametrize("how, want", [("union", [0.98, 0.5, 0.4]), ("intersection", [0.72, 0.5, 0.4]), ("max", [0.9, 0.5, 0.4]), ("min", [0.8, 0.5, 0.4]), ("mean", [0.85, 0.5, 0.4])])
def test_symmetrise(spark, how, want):
    e = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5), (1, 0, 0.8), (3, 0, 0.4)], "source long, target long, weight double")
    got = M.symmetrise(e, how).orderBy("source", "target").collect()
    assert [r.weight for r in got] == pytest.approx(want)


def test_umap_clumps():
    e = np.array([(i, j) for a, b in ((0, 5), (5, 10)) for i in range(a, b) for j in range(i + 1, b)])
    p = K.umap(10, e, np.ones(len(e)), None, seed=1)
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    assert max(d[:5, :5].max(), d[5:, 5:].max()) < d[:5, 5:].min()


def test_packing(spark):
    diamond = [(k, i, x, y) for k in range(7) for i, (x, y) in enumerate([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)])]
    df = spark.createDataFrame(diamond, "layout_id long, id long, x double, y double")
    c = P.circular(df, padding=0.0, center=(0, 0)).groupBy("layout_id").avg("x", "y").toPandas().iloc[:, 1:].to_numpy()
    d = np.hypot(*(c[:, None] - c[None]).transpose(2, 0, 1)) + 9 * np.eye(7)
    assert d.min() == pytest.approx(2) and sorted(np.round(np.hypot(*c.T), 6)) == pytest.approx([0] + [2] * 6)
    r = P.rectangular(df, center=(0, 0), max_width=6, max_height=6).groupBy("layout_id").avg("x", "y").toPandas().iloc[:, 1:].to_numpy()
    gap = np.abs(r[:, None] - r[None]).max(2) + 9 * np.eye(7)
    assert gap.min() >= 2 - 1e-2


def test_circles_follow_one_rule_at_every_size():
    radii = np.r_[50.0, np.random.default_rng(4).choice([0.5, 0.7, 1.0], 400), np.linspace(0.8, 1.2, 60)]
    p, order = K.pack_circles(radii), np.argsort(-radii, kind="stable")
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    assert (d + np.eye(len(radii)) * 999 >= radii[:, None] + radii[None] - 1e-6).all()
    # Brute force: the next circle takes the nearest free spot of all pairs.
    for k in (5, 150, 250, 330, 460):
        c, placed = radii[order[k]], order[:k]
        q, r, best = p[placed], radii[placed] + radii[order[k]], np.inf
        for i in range(k):
            delta = q - q[i]
            far = np.hypot(*delta.T)
            js = np.flatnonzero((far < r[i] + r) & (far > 1e-12))
            for j in js:
                along = (r[i] ** 2 - r[j] ** 2 + far[j] ** 2) / (2 * far[j])
                high, e = np.sqrt(max(r[i] ** 2 - along**2, 0)), delta[j] / far[j]
                for s in (q[i] + e * along + np.array([-e[1], e[0]]) * high, q[i] + e * along - np.array([-e[1], e[0]]) * high):
                    if np.hypot(*s) < best and (np.hypot(*(q - s).T) >= r - 1e-9).all():
                        best = np.hypot(*s)
        assert abs(np.hypot(*p[order[k]]) - best) < 1e-6
