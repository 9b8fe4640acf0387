"""Merkle manifest of a table by window-based levels.

A row's leaf is the SHA-256 of its named columns. Rows are ranked inside their source by a range
partition; then each level is one window: nodes are partitioned by source and parent index, and the
ordered list over the full frame is both the parent's preimage and the source of every sibling.
The first node of each run goes on as the parent (so parents come out once), and levels follow
until a source has one node, its subroot; the subroots of all sources are joined to the root alike.
A run has ``fanout`` nodes at most, so no window grows with a source. Proofs come back top down:
a node's path is its own siblings and then its parent's path, so one join a level carries them,
over tables that shrink by the fanout. Digests are 32 bytes in the tables and hex in the preimages.

Defined results: null columns are ``-``; a null source is a source, the first; null doc_ids come
first in their source, rows of one doc_id by their leaf; repeated rows are leaves of their own; a
lone row is its source's subroot; without siblings the proof is the digest of nothing; an empty
table gives no rows; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailweave.llm.common import broadcast_if_small, counted, materialize, shuffle_partitions
from mailweave.session import measured

#: Columns of a leaf, in order; nodes of a run.
COLUMNS, FANOUT = ("doc_id", "source", "lang", "n_chars", "text"), 3
#: Nodes that are broadcast at most (a path holds 64 bytes for each level above).
BROADCAST_NODES = 20_000
#: Where monotonically_increasing_id puts the number of the partition.
_PARTITION_BIT = 33


def digest(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs, concatenated."""
    return F.sha2(F.concat(*inputs), 256)


def leaf_of(columns: dict[str, Column]) -> Column:
    """Digest of a row: each column with its length in bytes, ``-`` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return digest(*parts)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place of a row in its group, and ``n``, the size of the group.

    Rows are dealt by ranges of (group, order), so a large group is spread over many tasks; only a
    row for each partition and group is summed.
    """
    keys = [group, *order]
    rows = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"part": F.shiftright("at", _PARTITION_BIT), "at": F.col("at").bitwiseAND((1 << _PARTITION_BIT) - 1)})
    runs = rows.groupBy("part", F.col(group).alias("run")).agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before, whole = W.partitionBy("run").orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("run")
    runs = runs.withColumns({"before": F.coalesce(F.sum("held").over(before), F.lit(0)), "n": F.sum("held").over(whole)})
    runs, many = counted(runs.select(F.col("part").alias("of"), "run", "first", "before", "n"))
    match = (F.col("part") == F.col("of")) & F.col(group).eqNullSafe(F.col("run"))
    joined = rows.join(broadcast_if_small(runs, many, BROADCAST_NODES), match)
    return joined.withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "of", "run", "first", "before")


def levels(nodes: DataFrame, fanout: int) -> list[tuple[DataFrame, int]]:
    """The levels above ranked nodes (g, i, n, h, ...): tables (g, i, n, h, left, right) with their row counts.

    A table holds every node of its level, the lowest also the other columns of ``nodes``; left and
    right are the digests beside a node in its run, null for a group's last node.
    """
    out: list[tuple[DataFrame, int]] = []
    while True:
        run = W.partitionBy("g", (F.col("i") / fanout).cast("long")).orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        place = (F.col("i") % fanout).cast("int")
        glued = lambda some: F.aggregate(some, F.lit(b""), lambda a, x: F.concat(a, x))
        level = nodes.withColumn("run", F.when(F.col("n") > 1, F.collect_list("h").over(run)))
        level = level.select(
            *nodes.columns,
            glued(F.slice("run", F.lit(1), place)).alias("left"),
            glued(F.slice("run", place + 2, F.lit(fanout))).alias("right"),
            F.when(place == 0, F.unhex(digest(*[F.coalesce(F.lower(F.hex(F.get("run", F.lit(k)))), F.lit("")) for k in range(fanout)]))).alias("parent"),
        )
        level, seen = measured(level, rows=F.count(F.lit(1)), most=F.max("n"))
        out.append((level.drop("parent"), seen["rows"]))
        if not seen["rows"] or seen["most"] <= 1:
            return out
        nodes = level.filter("n > 1 AND parent IS NOT NULL").select(
            "g", (F.col("i") / fanout).cast("long").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), F.col("parent").alias("h")
        )


def paths(tables: list[tuple[DataFrame, int]], tops: DataFrame, many: int, fanout: int) -> DataFrame:
    """The lowest nodes with ``path``: their siblings from level to level, then the path that ``tops`` (of, rest) has for their group."""
    above: DataFrame | None = None
    size = 0
    tops = broadcast_if_small(tops, many, BROADCAST_NODES)
    for level, rows in reversed(tables):
        kept = [c for c in level.columns if c not in ("n", "left", "right")]
        here = level.filter("n = 1").join(tops, F.col("g").eqNullSafe(F.col("of"))).select(*kept, F.col("rest").alias("path"))
        if above is not None:
            parents = above.select(F.col("g").alias("of"), F.col("i").alias("up"), F.col("path").alias("rest"))
            match = F.col("g").eqNullSafe(F.col("of")) & ((F.col("i") / fanout).cast("long") == F.col("up"))
            below = level.filter("n > 1").join(broadcast_if_small(parents, size, BROADCAST_NODES), match)
            here = here.unionByName(below.select(*kept, F.concat(F.array(F.struct("left", "right")), "rest").alias("path")))
        above, size = here, rows
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, x: digest(F.lower(F.hex(x["left"])), h, F.lower(F.hex(x["right"]))))


def proof_digest(path: Column) -> Column:
    beside = F.transform(path, lambda x: F.concat(F.lower(F.hex(x["left"])), F.lower(F.hex(x["right"]))))
    return F.sha2(F.array_join(beside, ""), 256)


def build_manifest(docs: DataFrame, changed: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, source, leaf, leaf_now, subroot, root, path) of every row.

    path: siblings (left, right) of each level from the leaf to the root, as bytes. leaf_now is the
    leaf after ``changed`` replaced some columns, to be verified by :func:`folded`.
    """
    now = {c: (changed or {}).get(c, F.col(c)) for c in columns}
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("g"), leaf_of({c: F.col(c) for c in columns}).alias("leaf"), leaf_of(now).alias("now"))
    rows = rows.select("id", "g", F.unhex("leaf").alias("h"), F.when(F.col("leaf") != F.col("now"), F.unhex("now")).alias("now"))
    rows = materialize(rows.withColumn("salt", F.monotonically_increasing_id()))
    up = levels(ranked(rows, "g", ["id", "h", "salt"]).drop("salt"), fanout)
    subroots = reduce(DataFrame.unionByName, [t.filter("n = 1").select(F.col("g").alias("source"), "h", F.lit(0).alias("g")) for t, _ in up])
    over = levels(ranked(subroots, "g", ["source"]), fanout)
    many = over[0][1]
    top = over[-1][0].filter("n = 1").select("h").first()
    none = docs.sparkSession.range(1).select(F.lit(0).alias("of"), F.expr("CAST(array() AS array<struct<left:binary,right:binary>>)").alias("rest"))
    tops = materialize(paths(over, none, 1, fanout).select(F.col("source").alias("of"), F.lower(F.hex("h")).alias("subroot"), F.col("path").alias("rest")))
    whole = paths(up, tops.select("of", "rest"), many, fanout)
    whole = whole.join(broadcast_if_small(tops.select("of", "subroot"), many, BROADCAST_NODES), F.col("g").eqNullSafe(F.col("of")))
    return whole.select(
        F.col("id").alias("doc_id"), F.col("g").alias("source"), F.lower(F.hex("h")).alias("leaf"), F.lower(F.hex(F.coalesce("now", "h"))).alias("leaf_now"),
        "subroot", F.lit(top["h"].hex() if top else None).cast("string").alias("root"), "path",
    )
