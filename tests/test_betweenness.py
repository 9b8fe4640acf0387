"""Sampled betweenness against the exact one: within its bound, with few rows, on ties, hubs and parts that aren't joined."""

import random

from pyspark.sql import functions as F

from mailweave.operators import graph


def made():
    r = random.Random(8)
    edges = [(i, r.randrange(i)) for i in range(1, 60)] + [(r.randrange(60), r.randrange(60)) for _ in range(25)]
    edges += [(100, 101), (101, 102), (102, 103), (103, 100)]  # a ring of its own, with two paths between opposite nodes
    edges += [(0, 200 + k) for k in range(30)] + [(7, 7), (3, 1), (1, 3)]
    return edges


def test_within_the_bound(spark):
    edges = spark.createDataFrame(made(), "src long, dst long")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    exact = {r["id"]: r["betweenness"] for r in graph.betweenness(edges, nodes).collect()}
    found, bound = graph.sampled_betweenness(edges, 0.08)
    got = {r["id"]: r["betweenness"] for r in found.collect()}
    n = nodes.count()
    assert got.keys() == exact.keys() and 0 < bound <= 0.08 * n * (n - 1)
    assert max(abs(got[i] - exact[i]) for i in exact) <= bound
    assert max(got, key=got.get) == max(exact, key=exact.get) and all(got[200 + k] == 0 for k in range(30))
    again, same = graph.sampled_betweenness(edges, 0.08)
    assert same == bound and {r["id"]: r["betweenness"] for r in again.collect()} == got


def test_small_graphs(spark):
    one = spark.createDataFrame([(1, 2)], "src long, dst long")
    for edges in (one, one.limit(0)):
        found, bound = graph.sampled_betweenness(edges)
        assert bound == 0.0 and all(r["betweenness"] == 0 for r in found.collect())
    pair = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    assert {r["betweenness"] for r in graph.sampled_betweenness(pair, 0.5)[0].collect()} == {0.0}


def test_numbers_have_no_gaps(spark):
    rows, n = graph.numbered(spark.range(1000).repartition(7))
    assert n == 1000 and sorted(r["number"] for r in rows.collect()) == list(range(1000))
    assert graph.numbered(spark.range(0))[1] == 0
