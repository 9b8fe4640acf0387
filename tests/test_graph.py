"""Graph algorithms against small plain-Python versions."""

import itertools
import random

import pytest

from mailweave.operators import graph


@pytest.fixture(scope="module")
def edges():
    r = random.Random(1)
    return sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(28)})


@pytest.fixture(scope="module")
def frame(spark, edges):
    return spark.createDataFrame([(a, b, a % 3 + 1) for a, b in edges], "src long, dst long, weight long")


def around(edges):
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def test_components(frame, edges):
    near, want = around(edges), {}
    for n in sorted(near):
        if n in want:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert {r["id"]: r["component"] for r in graph.connected_components(frame.select("src", "dst")).collect()} == want


def test_pagerank(frame, edges):
    weight = {}
    for a, b in edges:
        weight[a, b] = weight[b, a] = a % 3 + 1
    nodes = sorted({a for a, _ in weight})
    total = {n: sum(w for (a, _), w in weight.items() if a == n) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        rank = {n: 0.15 / len(nodes) + 0.85 * sum(rank[a] * w / total[a] for (a, b), w in weight.items() if b == n) for n in nodes}
    got = {r["id"]: r["rank"] for r in graph.weighted_pagerank(frame).collect()}
    assert got == {n: pytest.approx(r, abs=1e-9) for n, r in rank.items()}


def test_directed_pagerank_keeps_all_rank(frame):
    assert sum(r["rank"] for r in graph.directed_pagerank(frame.select("src", "dst")).collect()) == pytest.approx(1, abs=1e-9)


def test_label_propagation_splits_cliques(spark):
    two = [*itertools.combinations(range(5), 2), *itertools.combinations(range(10, 15), 2), (0, 10)]
    got = {r["id"]: r["label"] for r in graph.label_propagation(spark.createDataFrame(two, "src long, dst long")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1
    assert got[1] != got[11]


def test_paths_and_shortest(frame, edges, spark):
    near = around(edges)
    start = edges[0][0]
    level, hops = {start: 0}, 0
    while True:
        new = {n for x, h in level.items() if h == hops for n in near[x]} - level.keys()
        if not new:
            break
        hops += 1
        level |= dict.fromkeys(new, hops)
    both = graph.undirected(frame.select("src", "dst"))
    assert {r["id"]: r["hop"] for r in graph.breadth_first(both, start, 30).collect()} == level
    far = max(level, key=lambda n: (level[n], n))
    every, todo = [], [[start]]
    while todo:
        p = todo.pop()
        if p[-1] == far:
            every.append(p)
        elif len(p) <= 9:
            todo += [[*p, n] for n in near[p[-1]] if n not in p]
    found = graph.shortest_paths(frame, start, far, 9, 5).collect()
    assert [r["nodes"] for r in found] == sorted(every, key=lambda p: (len(p), p))[:5] and len(found) > 1
    assert graph.shortest_paths(frame, start, 999, 8, 1).count() == 0
    for r in graph.paths(frame.select("src", "dst"), start, 3).collect():
        assert all(b in near[a] for a, b in zip(r["nodes"], r["nodes"][1:]))


def test_betweenness(spark):
    line = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(line, spark.createDataFrame([(i,) for i in range(1, 5)], "id long")).collect()}
    assert got[2] == got[3] == pytest.approx(4) and got[1] == got[4] == 0


def test_first_paths_of_a_dense_graph(spark, monkeypatch):
    """Layers of 12 nodes, each joined with all of the next: few of the thousands of paths are grown."""
    layers = [[0], *[list(range(100 * k, 100 * k + 12)) for k in (1, 2, 3)], [999]]
    edges = [(a, b) for one, two in zip(layers, layers[1:]) for a in one for b in two]
    grown, plain = [], graph.measured
    monkeypatch.setattr(graph, "measured", lambda df, **m: (lambda out: grown.append(out[1]["n"]) or out)(plain(df, **m)))
    df = spark.createDataFrame(edges, "src long, dst long")
    got = [tuple(r["nodes"]) for r in graph.shortest_paths(df, 0, 999, 6, 3).collect()]
    assert got == [(0, 100, 200, 300, 999), (0, 100, 200, 301, 999), (0, 100, 200, 302, 999)]
    assert max(grown) <= 12 * graph.PREFIXES * 3


def test_first_paths_lead_nowhere(spark, monkeypatch):
    """The first partial paths of a length have no simple end, so more are grown until the path is found."""
    monkeypatch.setattr(graph, "PREFIXES", 1)
    # of four hops only 0 - 50 - 60 - 70 - 9 goes; 0 - 1 - 2 - ... could only come back through 1
    edges = [(0, 9), (0, 1), (1, 2), (1, 3), (1, 9), (0, 50), (50, 60), (60, 70), (70, 9)]
    got = [tuple(r["nodes"]) for r in graph.shortest_paths(spark.createDataFrame(edges, "src long, dst long"), 0, 9, 4, 3).collect()]
    assert got == [(0, 9), (0, 1, 9), (0, 50, 60, 70, 9)]
