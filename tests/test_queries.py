"""Every registered query of the engine runs; those with SQL equal it."""

import os

import pytest

DATA = os.environ.get("MAILWEAVE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

if not os.path.isdir(DATA):
    pytest.skip("the driver's tables aren't here", allow_module_level=True)

from mailweave.plans import registry  # noqa: E402

@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    def plain(v):
        if isinstance(v, float):
            return round(v, 4)
        return v.isoformat()[:19] if hasattr(v, "isoformat") else v

    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows_of(columns, [tuple(r[c] for c in columns) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got and registry.queries().keys() >= {name}
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = rows_of(columns, duck.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(e.queries())
