"""Numpy kernels of the iterative layouts: (n, edges, weights, initial) -> coordinates. Each works on one graph of a few thousand vertices."""

from __future__ import annotations

import heapq
import math

import numpy as np


def start(n: int, initial, seed: int) -> np.ndarray:
    return np.array(initial, float) if initial is not None else np.random.default_rng(seed).uniform(-1, 1, (n, 2))


def dense(n: int, edges: np.ndarray, weights: np.ndarray) -> np.ndarray:
    a = np.zeros((n, n))
    for (i, j), w in zip(edges, weights):
        if i != j:
            a[i, j] += w
            a[j, i] += w
    return a


def hops(n: int, edges: np.ndarray, fill: bool = True) -> np.ndarray:
    """Unweighted distances; pairs out of reach get the greatest finite one, or stay infinite."""
    a = dense(n, edges, np.ones(len(edges))) > 0
    d = np.where(np.eye(n, dtype=bool), 0.0, np.inf)
    front, step = np.eye(n, dtype=bool), 0
    while front.any():
        step += 1
        front = (front.astype(np.float32) @ a.astype(np.float32) > 0) & np.isinf(d)
        d[front] = step
    if fill:
        d[np.isinf(d)] = d[np.isfinite(d)].max(initial=0.0)
    return d


def _apart(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    delta = p[:, None] - p[None]
    return delta, np.hypot(delta[..., 0], delta[..., 1])


def arf(n, edges, weights, initial, scaling=1.0, spring_strength=1.1, etol=1e-6, dt=1e-3, max_iter=1000, seed=0):
    """Attractive and repulsive forces (Geipel 2007); a listed edge pulls in its own direction only."""
    if spring_strength <= 1:
        raise ValueError("spring_strength must be above 1")
    p, rho = start(n, initial, seed), scaling * np.sqrt(n)
    k = np.ones((n, n))
    if len(edges):
        k[edges[:, 0], edges[:, 1]] = spring_strength
    for _ in range(max_iter if n > 1 else 0):
        delta, d = _apart(p)
        np.fill_diagonal(d, 1.0)
        change = ((k - rho / d)[..., None] * delta).sum(0)
        p = p + dt * change
        if np.hypot(*change.T).sum() <= etol:
            break
    return p


def spring(n, edges, weights, initial, k=None, fixed=(), exponent_attraction=1.0, exponent_repulsion=-2.0, etol=1e-4, max_iter=50, seed=0):
    """Fruchterman-Reingold (1991): temperature from a tenth of the extent, cooled linearly."""
    p, k = start(n, initial, seed), k or np.sqrt(1 / n)
    a, free = dense(n, edges, weights), np.ones(n, bool)
    free[list(fixed)] = False
    t = max(np.ptp(p[:, 0]), np.ptp(p[:, 1])) * 0.1
    cool = t / (max_iter + 1)
    for _ in range(max_iter if n > 1 and free.any() else 0):
        delta, d = _apart(p)
        d = np.maximum(d, 0.01)
        move = (delta * (k**2 * d**exponent_repulsion - a * d**exponent_attraction / k)[..., None]).sum(1)
        length = np.maximum(np.hypot(*move.T), 0.01)
        step = move * (np.minimum(length, t) / length)[:, None] * free[:, None]
        p = p + step
        t -= cool
        if np.linalg.norm(step) / n < etol:
            break
    return p


def spring_energy(n, edges, weights, initial, k=None, gravity=1.0, max_iter=50, seed=0):
    """Gradient descent on the potential of the spring forces, with a pull to the middle."""
    p, k, a = start(n, initial, seed), k or np.sqrt(1 / n), dense(n, edges, weights)
    rate = 0.1 * k
    for i in range(max_iter if n > 1 else 0):
        delta, d = _apart(p)
        d = np.maximum(d, 0.01)
        g = (delta * (a * d / k - k**2 / d**2)[..., None]).sum(1) + gravity * (p - p.mean(0)) / n
        p = p - rate * (1 - i / max_iter) * g / np.maximum(np.hypot(*g.T), 1e-9)[:, None]
    return p


def forceatlas2(n, edges, weights, initial, jitter_tolerance=1.0, scaling_ratio=2.0, gravity=1.0, distributed_action=False, strong_gravity=False, dissuade_hubs=False, linlog=False, mass=None, size=None, etol=1e-10, max_iter=1000, seed=0):
    """Jacomy et al. (2014) with adaptive speed."""
    p, a = start(n, initial, seed), dense(n, edges, weights)
    m = np.asarray(mass, float) if mass is not None else (a > 0).sum(1) + 1.0
    last, speed, efficiency = np.zeros((n, 2)), 1.0, 1.0
    for _ in range(max_iter if n > 1 else 0):
        delta, d = _apart(p)
        if size is not None:
            d = d - np.asarray(size)[:, None] - np.asarray(size)[None]
        d = np.maximum(d, 0.01)
        pull = a * (np.log1p(d) / d if linlog else 1.0)
        if distributed_action or dissuade_hubs:
            pull = pull / m[:, None]
        push = scaling_ratio * m[:, None] * m[None] / d**2
        np.fill_diagonal(push, 0.0)
        off = p - p.mean(0)
        far = np.maximum(np.hypot(*off.T), 0.01)[:, None]
        f = (delta * (push - pull)[..., None]).sum(1) - gravity * m[:, None] * (off if strong_gravity else off / far)
        swing, traction = (m * np.hypot(*(f - last).T)).sum(), 0.5 * (m * np.hypot(*(f + last).T)).sum()
        best = min(max(0.05 * np.sqrt(n), jitter_tolerance * traction / n**2), 10.0) * jitter_tolerance
        if swing > 2 * traction:
            efficiency, best = max(0.05, efficiency * 0.5), max(best, jitter_tolerance)
        target = best * efficiency * traction / swing if swing else np.inf
        speed += min(target - speed, 0.5 * speed)
        own = m * np.hypot(*(f - last).T)
        step = f * (speed / (1 + np.sqrt(speed * own)))[:, None]
        p, last = p + step, f
        if np.abs(step).sum() < etol:
            break
    return p


def smacof(target, weight, p, max_iter=50, atol=1e-6, rtol=1e-4):
    """Stress majorisation (Gansner et al. 2005)."""
    lap = np.diag(weight.sum(1)) - weight
    inverse = np.linalg.pinv(lap)
    before = None
    for _ in range(max_iter):
        _, d = _apart(p)
        stress = (weight * (d - target) ** 2).sum() / 2
        if before is not None and (before - stress < atol or before - stress < rtol * before):
            break
        before = stress
        b = -weight * target / np.where(d > 1e-12, d, np.inf)
        np.fill_diagonal(b, 0.0)
        np.fill_diagonal(b, -b.sum(1))
        p = inverse @ (b @ p)
    return p


def kamada_kawai(n, edges, weights, initial, radius=1.0, max_iter=15000):
    return by_stress(hops(n, edges), initial, radius, max_iter)


def by_stress(d: np.ndarray, initial, radius: float, max_iter: int) -> np.ndarray:
    """Positions whose distances are nearest to d, the farther apart the less; the farthest coordinate is radius from the mean."""
    n = len(d)
    if n == 1:
        return np.zeros((1, 2))
    t = 2 * np.pi * np.arange(n) / n
    p = np.array(initial, float) if initial is not None else np.sqrt(n) / 2 * np.c_[np.cos(t), np.sin(t)]
    p = smacof(d, np.where(d > 0, 1 / np.maximum(d, 1e-9) ** 2, 0.0), p, max_iter, 1e-10, 1e-9)
    top = np.abs(p - p.mean(0)).max()
    return (p - p.mean(0)) * (radius / top if top > 0 else 1.0)


def neato(n, edges, weights, initial, max_iter=50, atol=1e-6, rtol=1e-4, scale=1.0, seed=0):
    """Unit edges by stress majorisation over the edges alone."""
    a = (dense(n, edges, np.ones(len(edges))) > 0).astype(float)
    return smacof(a, a, start(n, initial, seed), max_iter - 1, atol, rtol) * scale if n > 1 else np.zeros((1, 2))


def gem(n, edges, weights, initial, max_iter=1000, seed=0):
    """Graph embedder (Frick et al. 1994): one vertex a step, in shuffled order, at constant temperature."""
    rng = np.random.default_rng(seed)
    p = np.array(initial, float) if initial is not None else rng.uniform(-1, 1, (n, 2)) * n
    a = dense(n, edges, np.ones(len(edges))) > 0
    phi, order = a.sum(1) * (1 + a.sum(1) / 2), []
    for _ in range((40 * n * n if max_iter is None else max_iter) if n > 1 else 0):
        if not order:
            order = rng.permutation(n).tolist()
        v = order.pop()
        pull = (p.mean(0) - p[v]) / 16 * phi[v] + 32 * rng.uniform(-1, 1, 2)
        delta = p - p[v]
        d2 = (delta**2).sum(1)
        near = d2 > 0
        pull -= 128**2 * (delta[near] / d2[near, None]).sum(0)
        pull += phi[v] / 128**2 * (delta[a[v]] * d2[a[v], None]).sum(0)
        size = np.hypot(*pull)
        if size:
            p[v] += pull / size * np.sqrt(n)
    return p


def _in_cells(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of the same cell."""
    order = np.lexsort(cell.T)
    own = np.r_[0, np.cumsum((np.diff(cell[order], axis=0) != 0).any(1))]
    i, a, b = np.arange(len(own)), [], []
    for k in range(1, len(own)):
        i = i[i + k < len(own)]
        i = i[own[i + k] == own[i]]
        if not len(i):
            break
        a.append(order[i])
        b.append(order[i + k])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


#: Vertices whose pairs are worked out at once; a cell is not cut.
AT_ONCE = 16_384


def _by_cells(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their cells, as lexsort() has them, and whether each begins a cell."""
    half = 1 << 18
    if len(cell) < 1 << 24 and np.abs(cell).max(initial=0) < half:  # in one number, which sorts many times faster
        whole = (cell + half).astype(np.int64)
        key = np.sort((whole[:, 1] << 43) + (whole[:, 0] << 24) + np.arange(len(cell)))
        order, key = key & ((1 << 24) - 1), key >> 24
        return order, np.r_[True, key[1:] != key[:-1]]
    order = np.lexsort(cell.T)
    return order, np.r_[True, (np.diff(cell[order], axis=0) != 0).any(1)]


def _push_in_cells(force: np.ndarray, p: np.ndarray, order: np.ndarray, begins: np.ndarray, pull_k: float, etol: float) -> None:
    """Adds the pushes between the vertices of a cell to force, in the order of the pairs of _in_cells(), some cells at a time."""
    n, own, starts = len(p), np.cumsum(begins), np.r_[np.flatnonzero(begins), len(order)]
    lo = 0
    while lo < len(order):
        hi = int(starts[min(np.searchsorted(starts, lo + AT_ONCE), len(starts) - 1)])
        v, cell = order[lo:hi], own[lo:hi]
        (x, y), (fx, fy) = p[v].T.copy(), force[v].T.copy()
        i, pairs = np.arange(hi - lo), []
        for k in range(1, hi - lo):
            i = i[: np.searchsorted(i, hi - lo - k)]
            i = i[cell[i + k] == cell[i]]
            if not len(i):
                break
            dx, dy = x[i] - x[i + k], y[i] - y[i + k]
            d = np.maximum(np.hypot(dx, dy), etol)
            by = pull_k**2 * (1 / d - d**2 / (np.pi * n**3)) / d
            dx *= by
            dy *= by
            fx[i] += dx
            fy[i] += dy
            pairs.append((i + k, dx, dy))
        for j, dx, dy in pairs:
            fx[j] -= dx
            fy[j] -= dy
        force[v] = np.c_[fx, fy]
        lo = hi


def lgl(n, edges, weights, initial, root=0, seed=0, max_iter=1000, etol=1e-6):
    """Layers of a breadth-first tree around the root (Adai et al. 2004). After each layer all placed vertices are relaxed: those of a grid cell repel, edges to children in the same or a neighbouring cell attract."""
    rng = np.random.default_rng(seed)
    near: list[list[int]] = [[] for _ in range(n)]
    for i, j in edges:
        near[i].append(j)
        near[j].append(i)
    parent, layers = {root: -1}, [[root]]
    while layers[-1]:
        layers.append([w for v in layers[-1] for w in sorted(set(near[v])) if w not in parent and parent.setdefault(w, v) is not None])
    layers.pop()
    p, pull_k = np.zeros((n, 2)), np.sqrt(np.pi * n)
    scale = n / max(sum(1 / k for k in range(1, len(layers) - 1)), 1.0) if len(layers) > 2 else float(n)
    unit = lambda x: x / max(np.hypot(*x), 1e-12)
    done = [root]
    for k, layer in enumerate(layers[1:], 1):
        mid = p[done].mean(0)
        for v in dict.fromkeys(parent[w] for w in layer):
            kids = [w for w in layer if parent[w] == v]
            t = 2 * np.pi * np.arange(len(kids)) / len(kids) if k == 1 else rng.uniform(0, 2 * np.pi, len(kids))
            base = p[v] + (unit(p[v] - mid) if k > 1 else 0.0)
            p[kids] = base + scale / k * np.c_[np.cos(t), np.sin(t)]
        done += layer
        wide = np.ceil(np.sqrt(n))
        up, all_ = np.array([parent[w] for w in layer]), np.array(done)
        vetted = np.abs(np.floor((p[layer] + n) / wide) - np.floor((p[up] + n) / wide)).sum(1) <= 1
        up, down = up[vetted], np.array(layer)[vetted]
        cell = None
        for it in range(max_iter):
            delta = p[down] - p[up]
            pull = delta * ((delta**2).sum(1) / pull_k)[:, None]
            force = np.c_[np.bincount(up, pull[:, 0], n), np.bincount(up, pull[:, 1], n)].astype(float)
            force[down] -= pull
            last, cell = cell, np.floor((p[all_] + n) / wide)
            if last is None or not np.array_equal(last, cell):
                order, begins = _by_cells(cell)
                order = all_[order]
            _push_in_cells(force, p, order, begins, pull_k, etol)
            size, most = np.hypot(*force.T), (1 + etol) * ((max_iter - it) / max_iter) ** 1.5
            force *= np.where(size > most, most / np.maximum(size, 1e-300), 1.0)[:, None]
            p += force
            if np.abs(force).max() <= etol:
                break
    rest = [v for v in range(n) if v not in parent]
    p[rest] = rng.uniform(-n, n, (len(rest), 2))
    return p


def geometric(n, edges, lengths, initial, tol=1e-7, seed=0, max_iter=20000):
    """Positions with given edge lengths: each edge is in turn put to its length, from a spring layout. RuntimeError if max_iter rounds don't bring all within tol."""
    p = spring(n, edges, np.ones(len(edges)), initial, seed=seed) * (np.mean(lengths) if len(lengths) else 1.0)
    for _ in range(max_iter):
        worst = 0.0
        for (i, j), want in zip(edges, lengths):
            delta = p[j] - p[i]
            d = np.hypot(*delta)
            if d < 1e-12:
                delta, d = np.array([1.0, 0.0]), 1.0
            worst = max(worst, abs(d - want))
            p[i] += delta * (d - want) / d / 2
            p[j] -= delta * (d - want) / d / 2
        if worst < tol:
            return p - p.mean(0)
    raise RuntimeError(f"after {max_iter} rounds an edge is still {worst:g} off its length")


def mds(n, edges, weights, initial, check_connected=False):
    """Classical scaling (Torgerson 1952); each axis' largest component is positive."""
    if n == 1:
        return np.zeros((1, 2))
    if check_connected and np.isinf(hops(n, edges, fill=False)).any():
        raise ValueError("the graph is not connected")
    return classical_scaling(hops(n, edges))


def classical_scaling(d: np.ndarray) -> np.ndarray:
    n = len(d)
    c = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * c @ (d**2) @ c)
    top = np.argsort(-np.abs(values), kind="stable")[:2]
    xy = vectors[:, top] * np.sqrt(np.maximum(values[top], 0.0))
    xy *= np.where(xy[np.abs(xy).argmax(0), np.arange(xy.shape[1])] < 0, -1, 1)
    return np.c_[xy, np.zeros((n, 2 - xy.shape[1]))]


def find_ab(spread=1.0, min_dist=0.1):
    """a, b of 1 / (1 + a x^2b) nearest to the offset exponential, by Gauss-Newton."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(200):
        f = 1 / (1 + a * x ** (2 * b))
        j = np.c_[-(f**2) * x ** (2 * b), -(f**2) * a * x ** (2 * b) * 2 * np.log(x)]
        da, db = np.linalg.lstsq(j, y - f, rcond=None)[0]
        a, b = max(a + da, 1e-3), max(b + db, 1e-3)
        if abs(da) + abs(db) < 1e-12:
            break
    return a, b


def umap(n, edges, weights, initial, min_dist=0.1, spread=1.0, negative_rate=None, max_iter=100, seed=0, fixed=()):
    """Stochastic gradient descent on symmetric weights; an edge fires whenever its own clock, of period 1 / weight, is due."""
    a, b = find_ab(spread, min_dist)
    rng = np.random.default_rng(seed)
    p = start(n, initial, seed)
    free = np.ones(n, bool)
    free[list(fixed)] = False
    if free.any() and n > 1:
        q = p[free]
        p[free] = 10 * (q - q.min(0)) / np.maximum(np.ptp(q, axis=0), 1e-12)
    negative = max(2, int(5 * n / max(1, len(edges)))) if negative_rate is None else negative_rate
    due = 1 / np.maximum(weights, 1e-9)
    # One move after another, as each sees those before it: in plain floats, which take a tenth of the time of arrays of two. fma() rounds as BLAS does.
    (x, y), loose, a, b = p.T.tolist(), free.tolist(), float(a), float(b)
    pull, push = -2 * a * b, 2 * b
    for epoch in range(max_iter):
        alpha = 1 - epoch / max_iter
        fires = np.flatnonzero(due <= epoch)
        due[fires] += 1 / weights[fires]
        fires = fires[free[edges[fires, 0]]] if len(fires) else fires
        for (i, j), others in zip(edges[fires].tolist(), rng.integers(0, n, (len(fires), negative)).tolist()):
            xi, yi = x[i], y[i]
            dx, dy = xi - x[j], yi - y[j]
            d2 = math.fma(dy, dy, dx * dx)
            if d2 >= 1e-7:
                f = pull * d2 ** (b - 1) / (a * d2**b + 1)
                gx, gy = min(max(f * dx, -4.0), 4.0) * alpha, min(max(f * dy, -4.0), 4.0) * alpha
                xi += gx
                yi += gy
                if loose[j]:
                    x[j] -= gx
                    y[j] -= gy
            for k in others:
                dx, dy = xi - x[k], yi - y[k]
                d2 = math.fma(dy, dy, dx * dx)
                if k != i and d2 >= 1e-14:
                    f = push / ((1e-3 + d2) * (a * d2**b + 1))
                    xi += min(max(f * dx, -4.0), 4.0) * alpha
                    yi += min(max(f * dy, -4.0), 4.0) * alpha
            x[i], y[i] = xi, yi
    return np.c_[x, y]


def layers_of(n: int, edges: np.ndarray) -> np.ndarray:
    """Layers after the edges against an Eades-Lin-Smyth order are set aside: the longest path to each vertex."""
    out = [set() for _ in range(n)]
    into = [set() for _ in range(n)]
    for i, j in edges:
        if i != j:
            out[i].add(int(j))
            into[j].add(int(i))
    left, head, tail = set(range(n)), [], []
    o, i_ = [len(x) for x in out], [len(x) for x in into]

    def take(v: int) -> None:
        left.discard(v)
        for w in out[v] & left:
            i_[w] -= 1
        for w in into[v] & left:
            o[w] -= 1

    while left:
        sink = next((v for v in sorted(left) if o[v] == 0), None)
        source = next((v for v in sorted(left) if i_[v] == 0), None)
        if source is not None:
            head.append(source)
            take(source)
        elif sink is not None:
            tail.append(sink)
            take(sink)
        else:
            v = max(sorted(left), key=lambda v: o[v] - i_[v])
            head.append(v)
            take(v)
    order = head + tail[::-1]
    rank, layer = {v: k for k, v in enumerate(order)}, np.zeros(n, int)
    for v in order:
        for w in out[v]:
            if rank[w] > rank[v]:
                layer[w] = max(layer[w], layer[v] + 1)
    return layer


def with_ghosts(n: int, edges: np.ndarray, layer: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], list[int]]]:
    """The graph with a ghost vertex on each layer that an edge passes over: layers of all vertices, edges between next layers, and each long edge's ghosts from its source on."""
    layers, short, chains = layer.tolist(), [], {}
    for i, j in dict.fromkeys(map(tuple, edges.tolist())):
        gap = layer[j] - layer[i]
        if gap == 0:
            continue
        way = [i, *range(len(layers), len(layers) + abs(gap) - 1), j]
        layers += range(layer[i] + np.sign(gap), layer[j], np.sign(gap))
        short += zip(way, way[1:])
        if len(way) > 2:
            chains[i, j] = way[1:-1]
    return np.array(layers, int), np.array(short, int).reshape(-1, 2), chains


def sugiyama(n, edges, weights, initial, theta=0.0, shift=(0.0, 0.0), max_crossing=100, hgap=1.0, waypoints=False):
    """Layered drawing: layers, ghosts on long edges, barycentre sweeps, four alignments to neighbours' medians, components side by side.

    With waypoints also a dictionary from each edge over two layers or more to the places of its ghosts, from its source on.
    """
    if n == 1:
        return (np.zeros((1, 2)), {}) if waypoints else np.zeros((1, 2))
    y, short, chains = with_ghosts(n, edges, layers_of(n, edges))
    total = len(y)
    a: list[set[int]] = [set() for _ in range(total)]
    for i, j in short:
        a[i].add(int(j))
        a[j].add(int(i))
    link = [set(x) for x in a]
    for i, j in edges:  # those within a layer too
        link[i].add(int(j))
        link[j].add(int(i))
    comp = np.full(total, -1)
    for v in range(total):
        todo = [v] if comp[v] < 0 else []
        while todo:
            w = todo.pop()
            if comp[w] < 0:
                comp[w] = v
                todo += link[w]
    x, left = np.zeros(total), 0.0
    for c in np.unique(comp):
        own = np.flatnonzero(comp == c).tolist()
        rows = [[v for v in own if y[v] == k] for k in range(y[own].max() + 1)]
        place = {v: float(k) for row in rows for k, v in enumerate(row)}
        for _ in range(max_crossing):
            before = [list(r) for r in rows]
            for seq, step in ((range(1, len(rows)), -1), (range(len(rows) - 2, -1, -1), 1)):
                for k in seq:
                    bary = {v: np.mean([place[w] for w in a[v] if y[w] == k + step] or [place[v]]) for v in rows[k]}
                    rows[k].sort(key=lambda v: (bary[v], v))
                    place.update({v: float(q) for q, v in enumerate(rows[k])})
            if rows == before:
                break
        tries = []
        for down in (True, False):
            for flip in (False, True):
                tries.append(_aligned(rows, a, y, down, flip))
        width = [max(t.values()) - min(t.values()) for t in tries]
        best = tries[int(np.argmin(width))]
        lo, hi = min(best.values()), max(best.values())
        for k, t in enumerate(tries):
            move = hi - max(t.values()) if k % 2 else lo - min(t.values())
            tries[k] = {v: s + move for v, s in t.items()}
        for v in own:
            four = sorted(t[v] for t in tries)
            x[v] = (four[1] + four[2]) / 2
        x[own] += left - (x[own].min() if left else 0.0)
        left = x[own].max() + hgap
    c, s = np.cos(theta), np.sin(theta)
    xy = np.c_[x * c + y * s, y * c - x * s] + np.asarray(shift)
    return (xy[:n], {e: xy[g] for e, g in chains.items()}) if waypoints else xy[:n]


def _aligned(rows, a, y, down: bool, flip: bool) -> dict[int, float]:
    """One of the four drawings of Brandes and Koepf (2001): vertices in chains of median neighbours, placed as far to one side as order lets them."""
    order = [row[::-1] if flip else list(row) for row in (rows if down else rows[::-1])]
    at = {v: k for row in order for k, v in enumerate(row)}
    root = {v: v for row in order for v in row}
    align = dict(root)
    for k in range(1, len(order)):
        reach = -1
        for v in order[k]:
            near = sorted((w for w in a[v] if w in at and y[w] == y[order[k - 1][0]]), key=at.get) if order[k - 1] else []
            for m in {(len(near) - 1) // 2, len(near) // 2} if near else ():
                if align[v] == v and at[near[m]] > reach:
                    align[near[m]], root[v] = v, root[near[m]]
                    align[v], reach = root[v], at[near[m]]
    before = {row[k]: row[k - 1] for row in order for k in range(1, len(row))}
    chains: dict[int, list[int]] = {}
    for v, r in root.items():
        chains.setdefault(r, []).append(v)
    x: dict[int, float] = {}
    for _ in range(len(root) + 1):  # longest paths between chains; ends when nothing moves
        moved = False
        for r, vs in chains.items():
            new = max([0.0, *(x.get(root[before[v]], 0.0) + 1 for v in vs if v in before)])
            if x.get(r) != new:
                x[r], moved = new, True
        if not moved:
            break
    return {v: (-x[r] if flip else x[r]) for v, r in root.items()}


def pack_circles(radii: np.ndarray) -> np.ndarray:
    """Centres of touching circles, larger first: each goes tangent to two placed ones, to the free spot nearest the middle (after Wang et al. 2006)."""
    n, order = len(radii), np.argsort(-radii, kind="stable")
    r, p = radii[order].astype(float), np.zeros((n, 2))
    if n > 1:
        p[1] = (-(r[0] + r[1]), 0)
    # Pairs between which a circle fits; circles only get smaller, so none comes back. What blocks a spot beside j is in near[j].
    near: list[list[int]] = [[] for _ in range(n)]
    pairs, spots, size = np.zeros((0, 2), int), [], None

    def add(ij: np.ndarray, c: float) -> None:
        i, j = ij.T
        delta = p[j] - p[i]
        d = np.hypot(*delta.T)
        ok = (d < r[i] + r[j] + 2 * c) & (d > 1e-12)
        i, j, delta, d = i[ok], j[ok], delta[ok], d[ok]
        along = ((r[i] + c) ** 2 - (r[j] + c) ** 2 + d**2) / (2 * d)
        high = np.sqrt(np.maximum((r[i] + c) ** 2 - along**2, 0))
        e = delta / d[:, None]
        foot, side = p[i] + e * along[:, None], np.c_[-e[:, 1], e[:, 0]] * high[:, None]
        for sign, at in ((0, foot + side), (1, foot - side)):
            spots.extend(zip(np.round(np.hypot(*at.T), 9).tolist(), [sign] * len(i), i.tolist(), j.tolist(), at[:, 0].tolist(), at[:, 1].tolist()))

    for k in range(1, n):
        if k > 1:
            c = r[k]
            if c != size:
                gap = np.hypot(*(p[pairs[:, 0]] - p[pairs[:, 1]]).T) - r[pairs].sum(1)
                pairs, spots, size = pairs[gap < 2 * c], [], c
                add(pairs, c)
                heapq.heapify(spots)
            while spots:
                *_, j, x, y = heapq.heappop(spots)
                b = near[j] + [j]
                if (np.hypot(p[b, 0] - x, p[b, 1] - y) >= r[b] + c - 1e-9).all():
                    p[k] = x, y
                    break
            else:
                p[k] = np.max(p[:k, 0] + r[:k]) + c, 0
        c = r[min(k + 1, n - 1)]
        new = np.flatnonzero(np.hypot(*(p[:k] - p[k]).T) < r[:k] + r[k] + 2 * c)
        near[k] = new.tolist()
        for j in near[k]:
            near[j].append(k)
        new = np.c_[new, np.full(len(new), k)]
        pairs = np.concatenate([pairs, new])
        if c == size:
            before, spots = spots, []
            add(new, c)
            for s in spots:
                heapq.heappush(before, s)
            spots = before
    out = np.zeros((n, 2))
    out[order] = p
    return out


def pack_rectangles(sizes: np.ndarray, max_width=None, max_height=None) -> np.ndarray:
    """Lower left corners: columns of rectangles, tallest first, in a box near a square unless bounded."""
    w, h = sizes[:, 0], sizes[:, 1]
    limit = max_height if max_height is not None else max(h.max(), np.ceil(np.sqrt((w * h).sum())))
    while True:
        out, x, y, wide = np.zeros((len(sizes), 2)), 0.0, 0.0, 0.0
        for k in np.lexsort((np.arange(len(w)), -h, -w)):
            if y + h[k] > limit + 1e-9 and y > 0:
                x, y, wide = x + wide, 0.0, 0.0
            out[k], y, wide = (x, y), y + h[k], max(wide, w[k])
        if h.max() > limit + 1e-9 or max_width is not None and x + wide > max_width + 1e-9:
            if max_height is not None or max_width is not None and w.max() > max_width:
                raise ValueError("the rectangles don't fit")
            limit += max(1.0, h.min())
            if limit > h.sum() + h.max():
                raise ValueError("the rectangles don't fit")
            continue
        return out
