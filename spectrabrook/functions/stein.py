"""Graph Stein discrepancy of weighted points with scores, on a verified 2-spanner under the L1 norm."""

from __future__ import annotations

import numpy as np


def spanner(points: np.ndarray, stretch: float = 2.0) -> list[tuple[int, int]]:
    """Greedy edges, short ones first, so that graph distances are at most stretch times L1 distances; verified."""
    n = len(points)
    dist = np.abs(points[:, None] - points[None]).sum(2)
    graph = np.full((n, n), np.inf)
    np.fill_diagonal(graph, 0)
    i, j = np.triu_indices(n, 1)
    edges = []
    for k in np.argsort(dist[i, j], kind="stable"):
        a, b = int(i[k]), int(j[k])
        if graph[a, b] > stretch * dist[a, b]:
            edges.append((a, b))
            through = graph[:, [a]] + dist[a, b] + graph[[b], :]
            graph = np.minimum(graph, np.minimum(through, through.T))
    if (graph > stretch * dist * (1 + 1e-9) + 1e-12).any():
        raise ValueError("the graph is no spanner")
    return edges


def linear_program(c: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 200, gap: float = 1e-8) -> tuple[np.ndarray, float]:
    """max c'x with a x <= b by a primal-dual interior point with predictor and corrector; the relative gap is checked."""
    m, n = a.shape
    x, s, z = np.zeros(n), np.maximum(b, 1.0), np.ones(m)
    for _ in range(rounds):
        primal, dual = a @ x + s - b, a.T @ z - c
        mu = s @ z / m
        value = c @ x
        if max(np.abs(primal).max(), np.abs(dual).max()) <= 1e-8 * (1 + np.abs(b).max() + np.abs(c).max()) and s @ z <= gap * (1 + abs(value)):
            return x, float(value)
        w = z / s
        h = a.T @ (w[:, None] * a) + 1e-13 * np.eye(n)

        def direction(target: np.ndarray, primal=primal, dual=dual, w=w, h=h):
            # s dz + z ds = target - s z, ds = -primal - a dx, a' dz = -dual
            r = (target - s * z) / s
            dx = np.linalg.solve(h, -dual - a.T @ (r + w * primal))
            ds = -primal - a @ dx
            return dx, ds, r - w * ds

        dx, ds, dz = direction(np.zeros(m))
        full = lambda v, d: min(1.0, float((-v[d < 0] / d[d < 0]).min())) if (d < 0).any() else 1.0
        after = (s + full(s, ds) * ds) @ (z + full(z, dz) * dz) / m
        dx, ds, dz = direction((after / mu) ** 3 * mu - ds * dz)
        ps, pz = 0.99 * full(s, ds), 0.99 * full(z, dz)
        x, s, z = x + ps * dx, s + ps * ds, z + pz * dz
    raise ValueError("the linear program doesn't close its gap")


def discrepancy(points: np.ndarray, scores: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Sum over coordinates of max E[g' + g score] over functions and gradients bounded by one with Lipschitz gradients.

    Per coordinate the unknowns are values and gradients of g at the points;
    edges of the spanner bound differences of values, of gradients, and of
    first-order expansions.
    """
    n, d = points.shape
    w = np.full(n, 1 / n) if weights is None else np.asarray(weights, float) / np.sum(weights)
    edges = spanner(points) if n > 1 else []
    total = 0.0
    for k in range(d):
        size = n * (1 + d)
        grad = lambda i, j: n + i * d + j
        c = np.zeros(size)
        c[:n] = w * scores[:, k]
        c[[grad(i, k) for i in range(n)]] = w
        rows, rhs = [], []

        def bound(coef: dict[int, float], most: float, size=size, rows=rows, rhs=rhs):
            r = np.zeros(size)
            for at, v in coef.items():
                r[at] += v
            rows.extend([r, -r])
            rhs.extend([most, most])

        for i in range(n):
            bound({i: 1.0}, 1.0)
            for j in range(d):
                bound({grad(i, j): 1.0}, 1.0)
        for a, b in edges:
            step = points[a] - points[b]
            dist = float(np.abs(step).sum())
            bound({a: 1.0, b: -1.0}, dist)
            for j in range(d):
                bound({grad(a, j): 1.0, grad(b, j): -1.0}, dist)
            for base in (a, b):
                bound({a: 1.0, b: -1.0, **{grad(base, j): -float(step[j]) for j in range(d)}}, dist * dist / 2)
        total += linear_program(c, np.array(rows), np.array(rhs))[1]
    return total
