"""Hard negatives against all pairs in plain Python; bounds, odd rows and repeated rows."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailweave.llm import hard_negatives as hn
from mailweave.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, key string, score long, block string"


def made():
    r = random.Random(5)
    rows = []
    for i in range(700):
        length = 10 ** r.uniform(-2, 1)  # norms of many sizes, so that bounds prune
        rows.append((i, [float(np.float32(r.gauss(0, 1) * length)) for _ in range(6)], r.randrange(3)))
    rows[100] = (100, rows[300][1], rows[300][2])  # ties
    rows[301] = (301, rows[300][1], rows[300][2])
    rows += [(300, rows[300][1], rows[300][2])] * 2  # repeated rows, an anchor among them
    rows += [(None, rows[5][1], 1), (800, None, 1), (900, [1.0, None] * 3, 1), (1000, [float("nan")] * 6, 1), (1100, [math.inf] * 6, 2), (1200, [1.0] * 6, None)]
    rows += [(1300, [2.0, 1.0], 1), (1400, [], 2), (1500, [0.0] * 6, 0), (1600, [3e38] * 6, 1), (-100, [1.0] * 6, -2)]
    return rows


def expected(rows, best=5):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        if sum(x * x for x in w) < 2**62:
            kept.append((i, w, math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, (ai, av, al) in enumerate(kept):
        if ai is None or ai % 100:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, label == al) for b, (i, v, label) in enumerate(kept) if b != a]
        for ps, pi, _ in sorted((x for x in scored if x[2]), key=order)[:best]:
            fit = sorted((x for x in scored if not x[2] and 80 * ps <= 100 * x[0] <= 100 * ps), key=order)[:best]
            out += [(ai, pi, k + 1, ni, ps, ns) for k, (ns, ni, _) in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows, folder):
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    got = queries.op11_hard_negatives(spark, folder)
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


@pytest.mark.parametrize(("stripe", "block"), [(2048, 1 << 14), (64, 3)])
def test_all_pairs(spark, tmp_path, monkeypatch, stripe, block):
    monkeypatch.setattr(hn, "LEAST_STRIPE", stripe)
    monkeypatch.setattr(hn, "STRIPE", stripe)
    monkeypatch.setattr(hn, "BLOCK", block)
    rows = made()
    assert mined(spark, rows, str(tmp_path)) == expected(rows)


def test_no_rows(spark, tmp_path):
    assert mined(spark, [], str(tmp_path)) == []
    assert mined(spark, [(1, [1.0], 1), (2, None, None)], str(tmp_path)) == []
    assert mined(spark, [(100, [1.0], 1)], str(tmp_path)) == []


def test_bounds_prune(monkeypatch):
    """Buckets after the bound aren't scored: most of them where norms differ."""
    r = np.random.default_rng(1)
    v = (r.normal(size=(4096, 8)) * np.sort(10 ** r.uniform(0, 3, 4096))[::-1, None]).astype("<i4")
    norm = np.sqrt((v.astype(float) ** 2).sum(1))
    order = np.argsort(-norm)
    blocks = np.array_split(order, 64)
    buckets = pd.DataFrame(
        {
            "top": [norm[b].max() for b in blocks], "held": [len(b) for b in blocks], "ids": [np.sort(b).astype("<i8").tobytes() for b in blocks],
            "labels": [np.zeros(len(b), "<i8").tobytes() for b in blocks], "keys": [np.sort(b).astype("<i8").tobytes() for b in blocks],
            "width": 8, "vectors": [v[np.sort(b)].tobytes() for b in blocks],
        }
    )
    anchors = pd.DataFrame({"key": [5000 + i for i in range(20)], "label": 0, "norm": norm[:20], "vector": [v[i].tobytes() for i in range(20)], "scores": None})
    scored = []
    monkeypatch.setattr(hn, "_scores", lambda a, b, bound, f=hn._scores: scored.append(len(b)) or f(a, b, bound))
    got = hn.search_stripe(anchors, buckets, 5, None)
    s = v[:20].astype(np.int64) @ v.T.astype(np.int64)
    want = {(5000 + i, int(j)) for i in range(20) for j in np.lexsort((np.arange(4096), -s[i]))[:5]}
    assert set(zip(got["key"], got["other"])) == want
    assert sum(scored) < 4096 / 3


def test_whole_numbers_beyond_doubles(spark, tmp_path):
    big = [(100, [4e6, 1.0], 1), (1, [4e6, 2.0], 1), (2, [4e6, 1.5], 2), (3, [4e6, 1.5 + 1 / 256], 2)]
    assert mined(spark, big, str(tmp_path)) == expected(big)


def test_other_columns_are_ignored(spark):
    rows = spark.createDataFrame([(100, [1.0], 1, "a", 2, "b")], SCHEMA)
    assert hn.mine_negatives(rows, F.lit(True), F.col("label")).count() == 0
