"""PageRank of directed edges as a sum of walks: the same ranks as pass by pass, and no rows where no walk arrives."""

import random

from mailweave.operators import graph


def by_passes(edges, damping, passes):
    edges, nodes = set(edges), sorted({x for e in edges for x in e})
    out = {v: [b for a, b in edges if a == v] for v in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(passes):
        lost = sum(rank[v] for v in nodes if not out[v])
        new = dict.fromkeys(nodes, (1 - damping + damping * lost) / len(nodes))
        for v in nodes:
            for b in out[v]:
                new[b] += damping * rank[v] / len(out[v])
        rank = new
    return rank


def test_equal_ranks(spark):
    r = random.Random(2)
    chains = [(k, k - 1) for k in range(1, 60) if k % 5]
    loops = [(r.randrange(100, 130), r.randrange(100, 130)) for _ in range(70)] + [(200, 200), (3, 100), (3, 7), (3, 7)]
    for edges, passes in ((chains, 20), (chains + loops, 20), (loops, 1), (chains, 2)):
        got = {x["id"]: x["rank"] for x in graph.directed_pagerank(spark.createDataFrame(edges, "src long, dst long"), 0.8, passes).collect()}
        want = by_passes(edges, 0.8, passes)
        assert got.keys() == want.keys() and max(abs(got[v] - want[v]) for v in want) < 1e-10


def test_walks_end_with_the_chains(spark, monkeypatch):
    """Chains of three edges: rows for walks of up to three, not one for each node and pass."""
    rows, cut, measured = [], graph.cut, graph.measured

    def counted(made, out):
        rows.append(out.count())
        return made

    monkeypatch.setattr(graph, "cut", lambda df: counted(out := cut(df), out))
    monkeypatch.setattr(graph, "measured", lambda df, **k: counted(made := measured(df, **k), made[0]))
    edges = spark.createDataFrame([(k, k + 1) for k in range(400) if k % 4 != 3], "src long, dst long")
    ranks = graph.directed_pagerank(edges).collect()
    assert len(ranks) == 400 and len(rows) <= 8 and sum(rows) <= 300 * 2 + 400 + 300 + 200 + 100
