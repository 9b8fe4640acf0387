"""Nearest vectors of a large model: equal to comparing block by block, and candidates aren't shuffled to every block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailweave.plans import semantic


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(9)
    rows = [(f"v{i}", "large", r.integers(-2, 3, 12).astype(float).tolist()) for i in range(2300)] + [(f"w{i}", "small", r.normal(size=12).tolist()) for i in range(40)]
    rows += [("v7", "large", rows[9][2]), ("none", "large", None)]  # an id twice, many equal distances
    return spark.createDataFrame(rows, "id string, model string, vector array<float>").repartition(3)


def held(df):
    return sorted((r["left"], r["distance"], r["right"]) for r in df.collect())


@pytest.mark.parametrize("own", [False, True])
def test_equal_to_blocks(spark, vectors, monkeypatch, own):
    plain = held(semantic.nearest_of_all(vectors, 4, blocks=3, own=own))
    asked = held(semantic.nearest_of_all(vectors, 4, blocks=3, queries=vectors.filter("id < 'v5'"), own=own))
    monkeypatch.setattr(semantic, "WIDE", 300)
    monkeypatch.setattr(semantic, "GROUP", 4000)
    assert held(semantic.nearest_of_all(vectors, 4, own=own)) == plain
    assert held(semantic.nearest_of_all(vectors, 4, queries=vectors.filter("id < 'v5'"), own=own)) == asked


def test_a_vector_is_shuffled_once(spark, vectors, monkeypatch):
    monkeypatch.setattr(semantic, "WIDE", 100)
    rows = vectors.filter(F.col("model") == "large")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert semantic.nearest_of_all(rows, 4).count() == 4 * 2300
    assert written() - before < 1_500_000
