"""Betweenness by blocks against plain Python over several blocks, without a row for each source and node; samples that meet in the middle."""

import random
from collections import defaultdict, deque

from mailweave.operators import graph, pathblocks


def brandes(edges, sources):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    total = {}
    for s in sources:
        dist, paths, order, todo = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                total[w] = total.get(w, 0.0) + dep[w]
    return total


def test_blocks_match_plain_python(spark):
    r = random.Random(3)
    edges = [(i, max(0, i - r.randrange(1, 400))) for i in range(1, 2600)] + [(r.randrange(2600), r.randrange(2600)) for _ in range(3000)]
    edges += [(i, j) for i in range(60) for j in range(i)] + [(9001, 9002)]
    sources = [*range(0, 2600, 9), 9001]
    assert len(sources) > pathblocks.SOURCES and 2600 > pathblocks.NODES
    got = graph.betweenness(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(s,) for s in sources], "id long"))
    got, want = {r["id"]: r["betweenness"] for r in got.collect()}, brandes(edges, sources)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_no_row_for_each_source_and_node(spark, monkeypatch):
    """A star of 300 leaves has 90,000 pairs of leaves two steps apart."""
    rows, kept = [], graph.cut

    def cut(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    edges = spark.createDataFrame([(0, k) for k in range(1, 301)], "src long, dst long")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(edges, spark.range(301)).collect()}
    assert got[0] == 300 * 299 and sum(got.values()) == 300 * 299 and max(rows) <= 600


def test_dense_and_sparse_products_agree():
    import numpy as np

    r = np.random.default_rng(5)
    left = np.where(r.random((pathblocks.SOURCES, pathblocks.NODES)) < 0.01, 3.0, 0.0)
    left[40:90] = 0
    at = np.sort(r.choice(pathblocks.NODES**2, pathblocks.NODES**2 // 200, replace=False)).astype("<u4")
    bits = np.zeros(pathblocks.NODES**2, np.uint8)
    bits[at] = 1
    by_edge, whole = np.zeros_like(left), np.zeros_like(left)
    pathblocks.add_product(by_edge, left, at.tobytes())
    pathblocks.add_product(whole, left, np.packbits(bits).tobytes())
    assert (by_edge == whole).all() and by_edge.any()
