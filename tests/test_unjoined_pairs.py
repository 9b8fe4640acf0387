"""Sampled paths on parts that aren't joined: a pair of two parts isn't searched for."""

from mailweave.operators import graph


def test_pairs_of_two_parts_cost_nothing(spark, monkeypatch):
    """40 parts of 12 people, all joined to one another: one pair in forty is of one part, and each of those is a direct edge."""
    rows, cut, measured = [], graph.cut, graph.measured

    def counted(made, out):
        rows.append(out.count() if "paths" in out.columns else 0)
        return made

    monkeypatch.setattr(graph, "cut", lambda df: counted(out := cut(df), out))
    monkeypatch.setattr(graph, "measured", lambda df, **k: counted(made := measured(df, **k), made[0]))
    edges = spark.createDataFrame([(40 * i + k, 40 * j + k) for k in range(40) for i in range(12) for j in range(i)], "src long, dst long")
    found, bound = graph.sampled_betweenness(edges, 0.3)
    assert {r["betweenness"] for r in found.collect()} == {0.0} and 0 < bound and found.count() == 480
    assert sum(rows) < 1_000
