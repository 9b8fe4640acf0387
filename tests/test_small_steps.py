"""Small graphs run in few tasks, however many shuffle partitions the session has."""

from mailweave.operators import graph


def test_components_of_a_small_graph_write_few_files(spark, monkeypatch):
    files, kept = [], graph.measured

    def measured(df, **k):
        out, seen = kept(df, **k)
        files.append(len(out.inputFiles()))
        return out, seen

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    monkeypatch.setattr(graph, "measured", measured)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(k, k + 1) for k in range(0, 600) if k % 30 != 29] + [(7000, 7000), (None, 3)], "src long, dst long")
        got = {r["id"]: r["component"] for r in graph.connected_components(edges).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {k: k - k % 30 for k in range(601) if k != 600} | {7000: 7000}
    # the first table is the distinct edges, whose number isn't known before
    assert len(files) > 6 and max(files[1:]) <= graph.LEAST_TASKS
