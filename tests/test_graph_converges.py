"""Centralities run until they stand still: compared with dense power iteration on a slowly mixing graph."""

import inspect

import numpy as np

from corpusloom.operators import graph as G


def test_pagerank_converges(spark):
    n = 8
    arcs = [(k, (k + 1) % n, 1.0) for k in range(n)] + [(0, 4, 3.0), (7, 8, 1.0)]
    m = np.zeros((n + 1, n + 1))
    for a, b, w in arcs:
        m[b, a] = w
    total = m.sum(0)
    m = np.where(total > 0, m / np.where(total > 0, total, 1), 1 / (n + 1))
    x = np.full(n + 1, 1 / (n + 1))
    for _ in range(2000):
        x = 0.15 / (n + 1) + 0.85 * m @ x
    got = {r.node: r["rank"] for r in G.pagerank(spark.createDataFrame(arcs, "src long, dst long, weight double")).collect()}
    assert np.allclose([got[k] for k in range(n + 1)], x, atol=1e-7)


def test_eigenvector_converges(spark):
    links = [(k, k + 1, 1.0) for k in range(5)]
    m = np.zeros((6, 6))
    for a, b, w in links:
        m[a, b] = m[b, a] = w
    true = np.abs(np.linalg.eigh(m)[1][:, -1])
    got = {r.node: r.centrality for r in G.eigenvector(spark.createDataFrame(links, "a long, b long, weight double")).collect()}
    assert np.allclose([got[k] for k in range(6)], true, atol=1e-6)
    assert inspect.signature(G.eigenvector).parameters["rounds"].default == 2000
