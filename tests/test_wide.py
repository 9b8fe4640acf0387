"""A message to more people than any bound: all of its pairs reach the graph queries."""

import os

import pytest
from pyspark.sql import functions as F

DATA = os.environ.get("MAILWEAVE_TESTDATA", "/root/testdata/sf0.001")

if not os.path.isdir(DATA):
    pytest.skip("the driver's tables aren't here", allow_module_level=True)

from mailweave.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """The driver's tables, with a message to 40 people whom no other message names."""
    import duckdb

    out = tmp_path_factory.mktemp("wide")
    for t in os.listdir(DATA):
        if t != "lineitem.parquet":
            os.symlink(f"{DATA}/{t}", out / t)
    lines = f"'{DATA}/lineitem.parquet'"
    duckdb.sql(f"""COPY (SELECT * FROM {lines} UNION ALL
    SELECT l.* REPLACE (9000 + k AS l_suppkey, 'N' AS l_returnflag) FROM (SELECT * FROM {lines} ORDER BY ALL LIMIT 1) l, range(40) r(k)) TO '{out}/lineitem.parquet' (FORMAT parquet)""")
    return str(out)


def test_communities_hold_the_people_of_wide_messages(spark, wide):
    plain, found = (registry.queries()["communities"](spark, d).agg(F.sum("size")).first()[0] for d in (DATA, wide))
    assert found == plain + 40


def test_importance_ranks_by_wide_messages(spark, wide, monkeypatch):
    """Importance gets the ranks of all addressed, from edges of all messages."""
    given, rank = [], registry.graph.weighted_pagerank
    monkeypatch.setattr(registry.graph, "weighted_pagerank", lambda edges: given.append(edges) or rank(edges))
    registry.queries()["importance_all"](spark, wide)
    edges = given[0].filter("src >= 's9000' and dst <= 's9039' and length(src) = 5 and length(dst) = 5")
    assert edges.agg(F.count("*"), F.sum("weight")).first()[:] == (40 * 39 // 2, 40 * 39 // 2)


@pytest.fixture(scope="module")
def duck(wide):
    import duckdb

    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{wide}/{t}.parquet'")
    return con


def equals_sql(name, spark, wide, duck):
    df = registry.queries()[name](spark, wide)
    got = {r[0]: r[1] for r in df.collect()}
    want = dict(duck.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    assert got.keys() == want.keys() and {"s9000", "s9039"} <= got.keys()
    return got, want


def test_labels_of_wide_messages(spark, wide, duck):
    got, want = equals_sql("label_propagation", spark, wide, duck)
    assert got == want and len({got[f"s{9000 + k}"] for k in range(40)}) == 1


def test_ranks_of_wide_messages(spark, wide, duck):
    got, want = equals_sql("weighted_pagerank", spark, wide, duck)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-7
