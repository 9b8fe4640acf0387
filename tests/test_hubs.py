"""Graph steps where one vertex has nearly all edges: the same results, and no task holds them all."""

import random

import pytest
from pyspark.sql import functions as F

from mailweave.operators import graph


@pytest.fixture
def edges(spark):
    r = random.Random(4)
    rows = [(0, i) for i in range(1, 400)] + [(r.randrange(1, 500), r.randrange(1, 500)) for _ in range(150)] + [(900, 901)]
    return spark.createDataFrame(rows, "src long, dst long").withColumn("weight", F.lit(2))


def test_equal_results(edges, monkeypatch):
    run = lambda: [
        sorted(map(tuple, f(edges).collect()))
        for f in (graph.connected_components, lambda e: graph.weighted_pagerank(e).select("id", F.round("rank", 9)), graph.label_propagation)
    ]
    plain = run()
    monkeypatch.setattr(graph, "HOT_EDGES", 20)
    assert run() == plain


def test_a_star_of_a_million(spark):
    """A hub's edges stay spread: beside their vertex no partition has more than a few times the median."""
    star = spark.range(1, 1_000_001, numPartitions=8).select(F.lit(0).alias("src"), F.col("id").alias("dst"))
    degrees = star.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    hot = graph.hot_vertices(degrees, 1_000_000)
    values = degrees.select("id", F.lit(1.0).alias("rank"))
    for rows in (graph.with_vertex(star, "src", values, hot), graph.with_vertex(graph.undirected(star), "src", spark.range(1_000_001).withColumn("rank", F.lit(1.0)), hot)):
        held = sorted(r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        assert sum(held) in (1_000_000, 2_000_000) and held[-1] <= 4 * held[len(held) // 2]
    assert graph.connected_components(star).agg(F.count("*"), F.max("component")).first()[:] == (1_000_001, 0)
