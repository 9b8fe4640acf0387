"""Queries and operators do the whole job: nothing is cut to a subset."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from mailweave.plans import derived, registry, reports
from mailweave.sources import mail
from mailweave.tables import driver_archive

DATA = os.environ.get("MAILWEAVE_TESTDATA", "/root/testdata/sf0.001")
TABLES = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@TABLES
@pytest.mark.parametrize("name", ["weighted_pagerank", "label_propagation", "betweenness"])
def test_graph_queries_cover_all_addressed(spark, name):
    pairs = reports.addressed_pairs(driver_archive(spark, DATA))
    nodes = {r[0] for r in pairs.select("left").union(pairs.select("right")).distinct().collect()}
    assert any(n >= "s4" for n in nodes)
    assert {r["id"] for r in registry.queries()[name](spark, DATA).collect()} == nodes


@TABLES
def test_searches_from_every_hundredth(spark):
    vectors = driver_archive(spark, DATA).vectors
    want = {r[0] for r in vectors.filter("id % 100 = 0 and vector is not null").select("id").collect()}
    got = registry.queries()["semantic_neighbours"](spark, DATA)
    assert {r[0] for r in got.select("query").distinct().collect()} == want and len(want) > 1
    assert got.filter(F.col("query") == F.col("id")).count() == len(want)


@TABLES
def test_refs_reach_the_topics(spark):
    raw = b"From: a@x.org\r\nTo: b@x.org\r\nSubject: fix ABC-77\r\nMessage-ID: <1@x.org>\r\n\r\nsee #1234\r\n"
    parsed = mail.parsed_messages(spark.createDataFrame([("1", raw)], "path string, content binary"))
    assert mail.ground_truth(parsed)["messages"].first()["refs"] == ["#1234", "ABC-77"]
    a = driver_archive(spark, DATA)
    two = a.messages.orderBy("id").limit(2).withColumn("subject_norm", F.col("id").cast("string")).withColumn("refs", F.array(F.lit("ABC-77")))
    got = derived.signal_buckets(reports.facts(replace(a, messages=two))).filter("signal = 'ref'").collect()
    assert {r["id"] for r in got} == {r["id"] for r in two.collect()}


@TABLES
def test_importance_and_rebuild_use_every_part(spark):
    found, plain = (registry.queries()[q](spark, DATA).select("id", "importance") for q in ("importance_all", "importance"))
    assert found.exceptAll(plain).count() > 0
    counts = {r["name"]: r["n"] for r in registry.queries()["rebuild_counts"](spark, DATA).collect()}
    assert counts["similar_skipped"] == 0 and counts["keywords"] > 0 and "templates" in counts and "automated" in counts
