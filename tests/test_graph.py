"""Loops of the graph operators run until nothing moves."""

import pytest

from sparkloom.operators import graph


def test_loops_end_by_convergence_only(spark):
    n = 24
    edges = spark.createDataFrame([(k, k + 1, float(n - k)) for k in range(1, n)], "src long, dst long, weight double").coalesce(1)
    assert graph.shortest_path(edges, 1, n) == list(range(1, n + 1))
    short = edges.where("src < 9")
    assert {r.label for r in graph.communities(short).collect()} == {1}


def test_rank_reaches_the_tolerance(spark):
    pairs = [(1, 2), (2, 1), (2, 3), (3, 1)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double").coalesce(1)
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long").coalesce(1)
    r = dict.fromkeys((1, 2, 3), 1 / 3)
    for _ in range(200):
        r = {k: 0.05 + 0.85 * sum(r[a] / (2 if a == 2 else 1) for a, b in pairs if b == k) for k in r}
    found = {x.id: x.rank for x in graph.pagerank(nodes, edges, tol=1e-3).collect()}
    assert found == pytest.approx(r, abs=5e-3)
