import numpy as np
import pytest

from vertexloom.model import Graph
from vertexloom.operators import kernels as K
from vertexloom.operators import manifold as M
from vertexloom.operators import packing as P
from vertexloom.operators import primitives as G
from vertexloom.operators import shapes as S
from vertexloom.operators import solvers as V
from vertexloom.operators import stress as X


def graph(spark, n, edges, directed=False):
    return Graph.of(spark.createDataFrame([(i,) for i in range(n)], "v long"), spark.createDataFrame(edges, "src long, dst long"), directed)


def xy(layout):
    return layout.orderBy("pos").select("x", "y").toPandas().to_numpy()


RING = [(i, (i + 1) % 6) for i in range(6)]


def test_spring_call(spark):
    g = graph(spark, 6, RING)
    start = S.circle(g)
    p = xy(V.spring(g, start, scale=3.0))
    assert np.ptp(p, axis=0).max() == pytest.approx(3) and np.abs(p.mean(0)).max() < 1e-9
    assert np.isfinite(xy(V.spring(g, start, method="energy"))).all()
    np.testing.assert_allclose(xy(V.spring(g, start, g.vertices)), xy(start))
    held = g.vertices.where("pos = 2")
    for method in ("force", "energy"):
        got = xy(V.spring(g, start, held, method=method))
        assert (got[2] == xy(start)[2]).all() and not np.allclose(got[0], xy(start)[0])
    with pytest.raises(ValueError):
        V.spring(g, method="none")


def test_directedness(spark):
    with pytest.raises(ValueError):
        V.neato(graph(spark, 2, [(0, 1)], True))
    with pytest.raises(ValueError):
        V.sugiyama(graph(spark, 2, [(0, 1)]))


def test_ghosts_and_waypoints(spark):
    layer, short, chains = K.with_ghosts(4, np.array([[0, 1], [1, 2], [2, 3], [0, 3], [3, 0]]), np.array([0, 1, 2, 3]))
    assert layer.tolist() == [0, 1, 2, 3, 1, 2, 2, 1] and chains == {(0, 3): [4, 5], (3, 0): [6, 7]} and (4, 5) in set(map(tuple, short))
    layout, ways = V.sugiyama(graph(spark, 4, [(0, 1), (1, 2), (2, 3), (0, 3)], True))
    at, way = xy(layout), ways.orderBy("seq").collect()
    assert at[:, 1].tolist() == [0, 1, 2, 3] and [(r.src, r.dst, r.y) for r in way] == [(0, 3, 1), (0, 3, 2)]
    assert all(abs(r.x - at[int(r.y), 0]) >= 1 - 1e-9 for r in way)  # a ghost keeps its distance from the vertex of its layer


def test_layers_of_a_circle():
    e = np.array([[0, 1], [1, 2], [2, 0], [2, 3]])
    layer = K.layers_of(4, e)
    assert sum(layer[j] <= layer[i] for i, j in e) == 1 and layer.max() == 3


def test_mds_on_a_long_tail():
    """A clique of 60 with a tail of 200: connected, and walks between its ends are too many to count."""
    clique = [(i, j) for i in range(60) for j in range(i)]
    tail = [(i, i + 1) for i in range(59, 259)]
    e = np.array(clique + tail)
    p = K.mds(260, e, np.ones(len(e)), None, True)
    assert np.hypot(*(p[259] - p[200])) > 50
    with pytest.raises(ValueError):
        K.mds(261, e, np.ones(len(e)), None, True)


def test_distances_given(spark):
    square = np.array([[0, 0], [1, 0], [1, 2], [0, 2.0]])
    d = np.hypot(*(square[:, None] - square[None]).transpose(2, 0, 1))
    df = spark.createDataFrame([(0, i, j, float(d[i, j])) for i in range(4) for j in range(4)], "graph_id long, i int, j int, d double")
    for kind, scale in (("mds", 1.0), ("kamada_kawai", None)):
        p = xy(V.from_distances(df, kind))
        got = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
        np.testing.assert_allclose(got * (1 if scale else d[0, 2] / got[0, 2]), d, atol=1e-3)
    grid = G.distance_grid(graph(spark, 3, [(0, 1)]), spark.createDataFrame([(0, 0, 1, 2.5)], "graph_id long, i int, j int, d double"))
    assert {(r.i, r.j): r.d for r in grid.collect()} == {(i, j): 2.5 if (i, j) == (0, 1) else 0.0 for i in range(3) for j in range(3)}


def test_kamada_kawai_path():
    p = K.kamada_kawai(5, np.array([[i, i + 1] for i in range(4)]), np.ones(4), None)
    d = np.hypot(*(p[1:] - p[:-1]).T)
    np.testing.assert_allclose(d, d[0], atol=1e-3)
    assert np.hypot(*(p[4] - p[0])) == pytest.approx(d.sum(), rel=1e-2) and np.abs(p).max() == pytest.approx(1)


def test_first_steps_are_the_kernels(spark):
    g = graph(spark, 6, [*RING, (0, 3)])
    e, start = np.array([*RING, (0, 3)]), np.random.default_rng(2).uniform(-1, 1, (6, 2))
    at = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(start)], "graph_id long, pos int, x double, y double")
    np.testing.assert_allclose(xy(X.fa2_step(g, at)), K.forceatlas2(6, e, np.ones(7), start, max_iter=1), atol=1e-9)
    np.testing.assert_allclose(xy(X.arf_steps(Graph(g.vertices, g.edges, True), at, 3)), K.arf(6, e, np.ones(7), start, max_iter=3), atol=1e-9)


def test_cell_neighbours(spark):
    p = np.random.default_rng(3).uniform(-1, 1, (60, 2))
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "graph_id long, pos int, x double, y double")
    c = np.floor((p + 1) / 0.4)
    want = {(i, j) for i in range(60) for j in range(60) if i != j and np.abs(c[i] - c[j]).sum() <= 1}
    assert {(r.i, r.j) for r in X.cell_neighbours(X.cells(df, 0.4, -1.0)).collect()} == want


def test_knn_is_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((150, 8))
    v[40:60] = v[40]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "v long, e array<double>")
    got = {}
    for r in M.knn(df, 5, block=40).orderBy("source", "distance", "target").collect():
        got.setdefault(r.source, []).append(r.target)
    for i in range(150):
        d = np.sqrt(((v[i] - v) ** 2).sum(1))
        d[i] = np.inf
        assert got[i] == np.lexsort((np.arange(150), d))[:5].tolist()
    assert M.knn(df.where("false"), 5).count() == 0


def test_sigmas(spark):
    rng = np.random.default_rng(5)
    rows = [(s, t, float(x)) for s in range(20) for t, x in enumerate(rng.uniform(0.1, 3, 10))] + [(90, 1, 0.0), (90, 2, 0.0), (91, 1, 2.0)]
    got = {r.source: r for r in M.sigmas(spark.createDataFrame(rows, "source long, target long, distance double")).collect()}
    for s in range(20):
        d = np.sort([x for a, _, x in rows if a == s])
        assert got[s].rho == d[0] and np.exp(-(d[1:] - d[0]) / got[s].sigma).sum() == pytest.approx(np.log2(10), abs=1e-4)
    assert got[90].rho == 0 and got[91].rho == 2 and np.isfinite(got[91].sigma)


def test_embedding_inputs(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 2)], "source long, target long")
    assert [r.distance for r in M.edge_distances(e).collect()] == [1.0] * 4
    assert {r.distance for r in M.edge_distances(e, 2.0).collect()} == {2.0}
    given = {(0, 1): 3.0, (1, 0): 4.0, (1, 2): 5.0, (2, 2): 0.0}
    assert {(r.source, r.target): r.distance for r in M.edge_distances(e, given).collect()} == given
    with pytest.raises(ValueError):
        M.edge_distances(e, {(0, 1): 3.0})
    with pytest.raises(TypeError):
        M.edge_distances(e, "far")
    assert sorted((r.source, r.target, r.weight) for r in M.unweighted(e).collect()) == [(0, 1, 1.0), (1, 2, 1.0)]


def test_curve_of_the_embedding():
    # A and b as published for a spread of 1 and a least distance of 0.1.
    np.testing.assert_allclose(K.find_ab(1.0, 0.1), (1.577, 0.895), atol=2e-3)


def test_geometric_says_when_it_fails():
    with pytest.raises(RuntimeError):
        K.geometric(3, np.array([[0, 1], [1, 2], [2, 0]]), np.array([10.0, 1, 1]), None, max_iter=50)


def test_packing_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(7, 0, 0.0, 0.0), (7, 1, 2.0, 4.0)], "layout_id long, id long, x double, y double")
    for pack in (P.circular, P.rectangular):
        assert pack(df.where("false")).count() == 0
        got = pack(df, center=(0, 0)).orderBy("id").collect()
        assert [(r.layout_id, r.x, r.y) for r in got] == [(7, -1.0, -2.0), (7, 1.0, 2.0)]
