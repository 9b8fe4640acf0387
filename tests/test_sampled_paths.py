"""Samples of paths by a search from both ends: it stops where the two meet."""

from mailweave.operators import graph


def test_searches_meet_in_the_middle(spark, monkeypatch):
    """20 stars of 20 leaves around a hub: from one end alone, a sample meets nearly every leaf."""
    rows, cut, measured = [], graph.cut, graph.measured

    def counted(made, out):
        rows.append(out.count() if "paths" in out.columns else 0)
        return made

    monkeypatch.setattr(graph, "cut", lambda df: counted(out := cut(df), out))
    monkeypatch.setattr(graph, "measured", lambda df, **k: counted(made := measured(df, **k), made[0]))
    edges = spark.createDataFrame([(0, k) for k in range(1, 21)] + [(k, 100 * k + j) for k in range(1, 21) for j in range(20)], "src long, dst long")
    both = graph.undirected(edges)
    nodes, n = graph.numbered(both.select(graph.F.col("src").alias("id")).distinct())
    times = {r["id"]: r["times"] for r in graph._paths_through(both, nodes, n, 0, 100, 1).collect()}
    assert times.keys() <= set(range(21)) and 80 <= times[0] <= 100 and sum(times.values()) > 200
    assert max(rows) <= 4500
