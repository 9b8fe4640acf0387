"""Faults that only larger tables showed, on small tables."""

import pytest

from pyspark.sql import functions as F

from mailweave.plans import derived

CHANCE = (101297, 200261)


@pytest.mark.parametrize("name", ["template_instances", "template_summaries"])
def test_fingerprints_near_by_chance_stay_apart(name, spark, tmp_path):
    import duckdb

    from mailweave.plans import registry

    # two customers of one direction whose digests differ in five bits
    rows = [(k, CHANCE[k % 2], k) for k in range(12)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, day int")
    orders = orders.select("o_orderkey", "o_custkey", F.date_add(F.lit("1996-01-01").cast("date"), F.col("day") * F.col("day")).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    df = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    plain = lambda v: round(v, 5) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else v
    assert sorted(tuple(map(plain, (r[c] for c in columns))) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want)


def test_keys_of_fingerprints_stay_off_the_driver(spark, tmp_path):
    spark.range(500).select(F.lit("sent").alias("scope"), F.xxhash64("id").alias("simhash")).write.parquet(str(tmp_path / "leaders"))
    near = derived.near_leaders(spark.read.parquet(str(tmp_path / "leaders")))
    near.collect()
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_shuffled_by_blocks_of_their_own_model(spark):
    from mailweave.plans import semantic

    rows = spark.range(6000).select("id", F.concat(F.lit("m"), F.col("id") % 6).alias("model"), F.array(*[F.hash("id", F.lit(k)).cast("float") for k in range(4)]).alias("vector"))
    seen = []
    best, semantic._best = semantic._best, lambda sides, *rest: seen.append(sides.count()) or best(sides, *rest)
    try:
        semantic.nearest_of_all(rows, 3)
        semantic.nearest_of_all(rows, 3, queries=rows.filter("id % 100 = 0"))
    finally:
        semantic._best = best
    assert seen == [12_000, 3_060]  # ids divisible by 100 are in three of the models


def test_nearest_in_tiles_equals_brute_force():
    import numpy as np

    from mailweave.plans import semantic

    rng = np.random.default_rng(2)
    unit = semantic._unit(rng.integers(-2, 3, (700, 3)) + 0.0)  # many equal vectors, some zero
    ids = np.sort(rng.integers(0, 600, 700))  # repeated ids
    tile, semantic.TILE = semantic.TILE, (64, 50)
    try:
        for own in (False, True):
            for k in (1, 5, 60):
                at, to, d = semantic._nearest(unit[:300], unit, ids[:300], ids, k, own)
                got = sorted(zip(at.tolist(), d.tolist(), to.tolist()))
                want = []
                for q in range(300):
                    all_ = sorted((round(float(x), 9), j) for j, x in enumerate(np.round(1 - unit @ unit[q], 9)) if own or ids[j] != ids[q])
                    want += [(q, x, j) for x, j in all_[:k]]
                assert [(a, round(x, 8), j) for a, x, j in got] == [(a, round(x, 8), j) for a, x, j in want]
    finally:
        semantic.TILE = tile


@pytest.mark.parametrize("few, hot", [(0, 10_000), (0, 1), (1 << 30, 10_000)])
def test_ranks_and_labels_are_alike_whether_vertices_or_edges_move(few, hot, spark, monkeypatch):
    from mailweave.operators import graph

    edges = spark.createDataFrame([(f"a{x}", f"a{y}", x + y) for x in range(12) for y in range(12) if (x * y) % 5 == 1 and x != y], "src string, dst string, weight long")
    made = []
    join = graph.with_vertex
    monkeypatch.setattr(graph, "with_vertex", lambda *x: made.append(join(*x)) or made[-1])
    monkeypatch.setattr(graph, "FEW_VERTICES", few)
    monkeypatch.setattr(graph, "HOT_EDGES", hot)
    rank = {r["id"]: r["rank"] for r in graph.weighted_pagerank(edges).collect()}
    label = {r["id"]: r["label"] for r in graph.label_propagation(edges).collect()}
    sent = ["strategy=broadcast" in df._jdf.queryExecution().analyzed().toString() for df in made]
    assert sent == [few > 0 or hot == 1] * len(sent)  # copies of hot vertices are sent too
    near = {}
    for r in edges.collect():
        near.setdefault(r["src"], {}).setdefault(r["dst"], 0)
        near.setdefault(r["dst"], {}).setdefault(r["src"], 0)
        near[r["src"]][r["dst"]] += r["weight"]
        near[r["dst"]][r["src"]] += r["weight"]
    want = {v: 1 / len(near) for v in near}
    for _ in range(graph.PASSES):
        want = {v: 0.15 / len(near) + 0.85 * sum(want[u] * near[u][v] / sum(near[u].values()) for u in near[v]) for v in near}
    assert {v: round(x, 8) for v, x in rank.items()} == {v: round(x, 8) for v, x in want.items()}
    assert all(label[v] in {label[u] for u in near[v]} for v in near)
