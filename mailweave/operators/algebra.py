"""Graph-query primitives over the archive's tables, each a composition of DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def traverse(nodes: DataFrame, key: str, edges: DataFrame, source: str, optional: bool = False) -> DataFrame:
    """Expand along an edge table; an optional expand keeps nodes without an edge."""
    return nodes.join(edges, nodes[key] == edges[source], "left" if optional else "inner")


def branch(nodes: DataFrame, key: str, *branches: DataFrame) -> DataFrame:
    """Star expand: each branch is already aggregated to one row per ``key``, so nothing multiplies."""
    for b in branches:
        nodes = nodes.join(b, key, "left")
    return nodes


def collect_distinct(c: Column) -> Column:
    """Sorted distinct values, nulls skipped."""
    return F.sort_array(F.collect_set(c))


def total(c: Column) -> Column:
    """Sum that is 0 where there is nothing to sum."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def top(df: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    """Sorted page; callers give a total order."""
    page = df.orderBy(*order)
    return (page.offset(offset) if offset else page).limit(limit)


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next page of a cursor over ``key``."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def pick(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of the given ids in their order (unwind and match)."""
    wanted = df.sparkSession.createDataFrame(
        [(x, i) for i, x in enumerate(ids)], df.select(F.col(key).alias("__id"), F.lit(0).alias("position")).schema
    )
    hit = df.join(F.broadcast(wanted), df[key] == wanted["__id"]).drop("__id")  # a page of ids
    return hit.orderBy("position")


def merge(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows replace those of ``base`` with the same keys."""
    fresh = rows.dropDuplicates(keys)
    return base.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def append_new(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert what isn't there; what is there keeps its provenance."""
    fresh = rows.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def set_existing(base: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Set properties of rows that exist; values for others are dropped. Given columns are overwritten."""
    given = [c for c in values.columns if c != key]
    new = values.dropDuplicates([key]).select(F.col(key).alias("__key"), F.struct(*given).alias("__new"))
    joined = base.join(new, base[key] == new["__key"], "left")
    hit = F.col("__key").isNotNull()
    changed = {c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) if c in base.columns else F.col(f"__new.{c}") for c in given}
    return joined.withColumns(changed).drop("__key", "__new")


def delete(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(F.col(key).alias("__key")), base[key] == F.col("__key"), "left_anti")


def combinations(items: Column) -> Column:
    """All pairs (left, right) of a sorted array, left before right."""
    return F.flatten(
        F.transform(
            items,
            lambda x, i: F.transform(
                F.slice(items, i + 2, F.greatest(F.size(items), F.lit(1))), lambda y: F.struct(x.alias("left"), y.alias("right"))
            ),
        )
    )
