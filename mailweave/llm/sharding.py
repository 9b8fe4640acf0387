"""Sharding by histogram sort: shards of nearly equal bytes, with equal texts side by side.

Rows are ordered by (hash of the text, hash of the doc_id, hash of the row), three keys of 60 bits
that are spread evenly. Splitters are found by counting: a pass sums exact bytes and rows below
evenly spaced probes of every interval that still holds an open splitter, and the next pass probes
only inside the bin where the splitter fell. Sums combine before the shuffle and only bins reach the
driver, at most ``2 ** digit`` for each open interval. Passes end when every splitter is the best
there is: the boundary between two groups of equal texts that is nearest to its target, if it is near
enough, else (inside a group too large for that) the nearest boundary between two rows. Bins with
many rows are split on too, so that a bin is a bounded part of the table. Then the rows are exchanged
once, by bin; a row's slot is the number of rows in its shard's bins before, and its place in its own.

The law is ``bytes``: near enough is half of the largest row or of a two-hundredth of a shard, so each
shard's size differs from the mean by less than the larger of the two. DataFrame functions only.

Defined results: a null text has no bytes and counts as equal to the empty one; a null doc_id is a
doc_id; repeated rows are rows, each with its slot; shards stay empty where rows are fewer or larger
than shards; an empty table gives no rows; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailweave.llm.common import materialize, shuffle_partitions
from mailweave.session import measured

SHARDS, ROW_BYTES = 40, 16
#: Bits of a key; bits of a probe pass after the first; near enough, as a part of a shard.
BITS, DIGIT, NEAR = 60, 6, 200
#: No bin holds more rows than this part of the table.
EVEN = 512
#: Bins that are broadcast at most; their number is bounded by the shards and ``EVEN``, not by the rows.
BROADCAST_BINS = 500_000


@dataclass(frozen=True)
class Interval:
    """Rows with the key values ``fixed`` whose next key begins with ``prefix`` of ``bits`` bits."""

    fixed: tuple[int, ...]
    bits: int
    prefix: int


@dataclass
class Bin:
    at: Interval
    size: int
    rows: int
    low: int  # least and greatest of the key that the bin is cut by
    high: int


def hashed(value: Column) -> Column:
    """60 bits of a text's MD5 as a number; null counts as empty."""
    return F.conv(F.left(F.md5(F.coalesce(value, F.lit(""))), F.lit(15)), 16, 10).cast("long")


def _literal(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _within(rows: DataFrame, some: list[tuple[int, Interval]]) -> DataFrame:
    """The rows (k1, k2, k3) of numbered intervals, all of one level and width; as many as splitters and heavy bins at most."""
    level, bits = len(some[0][1].fixed), some[0][1].bits
    of = [{"bin": n, "p": x.prefix} | {f"f{j}": v for j, v in enumerate(x.fixed)} for n, x in some]
    table = _literal(rows.sparkSession, of, ", ".join(["bin: long", "p: long", *(f"f{j}: long" for j in range(level))]))
    match = F.shiftright(F.col(f"k{level + 1}"), BITS - bits) == table["p"]
    for j in range(level):
        match &= F.col(f"k{j + 1}") == table[f"f{j}"]
    return rows.join(F.broadcast(table), match).drop("p", *(f"f{j}" for j in range(level)))


def _probe(rows: DataFrame, open_: list[Bin], first: int) -> dict[Interval, list[Bin]]:
    """One pass: the bins of every open interval, cut ``DIGIT`` bits finer, or by the next key where one value is left."""
    finer: list[tuple[Interval, int, int]] = []  # interval, key that cuts it, bits after the cut
    for x in open_:
        if x.low == x.high and len(x.at.fixed) < 2:
            finer.append((Interval((*x.at.fixed, x.low), 0, 0), len(x.at.fixed) + 2, min(BITS, first)))
        else:
            finer.append((x.at, len(x.at.fixed) + 1, min(BITS, x.at.bits + DIGIT if x.at.bits else first)))
    classes: dict[tuple[int, int], list[int]] = {}
    for n, (at, _, _) in enumerate(finer):
        classes.setdefault((len(at.fixed), at.bits), []).append(n)
    passes = []
    for (level, bits), numbers in sorted(classes.items()):
        key, cut = finer[numbers[0]][1:]
        inside = _within(rows, [(n, finer[n][0]) for n in numbers]) if level or bits else rows.withColumn("bin", F.lit(numbers[0]).cast("long"))
        passes.append(inside.select("bin", F.shiftright(f"k{key}", BITS - cut).alias("p"), F.lit(cut).alias("bits"), F.col(f"k{key}").alias("k"), "size"))
    union = passes[0]
    for p in passes[1:]:
        union = union.unionByName(p)
    sums = union.groupBy("bin", "bits", "p").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"))
    out: dict[Interval, list[Bin]] = {x.at: [] for x in open_}
    for r in sums.collect():  # at most 2 ** DIGIT (at first 2 ** first) for each open interval
        at = Interval(finer[r["bin"]][0].fixed, r["bits"], r["p"])
        out[open_[r["bin"]].at].append(Bin(at, r["size"], r["rows"], r["low"], r["high"]))
    return {k: sorted(v, key=lambda b: b.at.prefix) for k, v in out.items()}


def _nearest(at: list[int], i: int, shards: int, total: int) -> int:
    """The boundary nearest to the i-th target, the lower one of two."""
    return min(at, key=lambda b: (abs(b * shards - i * total), b))


def splitters(rows: DataFrame, shards: int, largest: int, total: int, count: int, first: int) -> tuple[list[Bin], list[int], list[int]]:
    """The bins in order, the bytes before each, and the bytes before each splitter."""
    # a splitter is near enough at half of the largest row, or of a NEAR-th of a shard
    near = lambda b, i: 2 * NEAR * abs(b * shards - i * total) <= max(NEAR * largest * shards, total)
    bins = [Bin(Interval((), 0, 0), total, count, -1, -2)]
    while True:
        ends = [0]
        for b in bins:
            ends.append(ends[-1] + b.size)
        chosen, open_, reach = [], {}, [e * shards for e in ends[1:]]
        for i in range(1, shards):
            k = bisect_right(reach, i * total - 1)  # the bin whose end reaches the target
            b, sides = bins[k], [ends[k], ends[k + 1]]
            best = _nearest(sides, i, shards, total)
            single = b.low == b.high
            done = best * shards == i * total or b.rows == 1 or single and (len(b.at.fixed) == 2 or not b.at.fixed and near(best, i))
            if not done:
                open_[k] = b
            chosen.append(best)
        for k, b in enumerate(bins):
            if b.rows * EVEN > count and b.rows > 1 and not (len(b.at.fixed) == 2 and b.low == b.high):
                open_[k] = b
        if not open_:
            break
        cut = _probe(rows, list(open_.values()), first)
        bins = [x for b in bins for x in cut.get(b.at, [b])]
    # inside a group that had to be cut, the nearest boundary of groups still goes first where it is near enough
    groups = [0, *(e for e, b, after in zip(ends[1:], bins, [*bins[1:], None]) if after is None or not b.at.fixed or b.at.fixed[:1] != after.at.fixed[:1])]
    out = []
    for i, row in zip(range(1, shards), chosen):
        at = bisect_right(groups, row)
        group = _nearest(groups[max(0, at - 2) : at + 2], i, shards, total)
        out.append(max(group if near(group, i) else row, out[-1] if out else 0))
    return bins, ends, out


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, carry: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with __size, __crc, __shard and __slot, exchanged once by ranges of equal texts.

    carry: the columns that go along, all unless given.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.columns if carry is None else carry
    keyed = docs.select(
        F.struct(*own).alias("row"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("crc"),
        hashed(F.col("text")).alias("k1"), hashed(F.col("doc_id").cast("string")).alias("k2"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS).alias("k3"),
    )
    keyed, seen = measured(keyed, rows=F.count(F.lit(1)), total=F.sum("size"), largest=F.max("size"))
    if not seen["rows"]:
        placed = keyed.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    else:
        first = max(10, min(16, (8 * shuffle_partitions(docs.sparkSession)).bit_length()))
        placed = _exchange(keyed, *splitters(keyed.select("size", "k1", "k2", "k3"), shards, seen["largest"], seen["total"], seen["rows"], first))
    return placed.select(
        *[F.col("row")[c].alias(c) for c in own], F.col("size").alias("__size"), F.col("crc").alias("__crc"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot")
    )


def _exchange(keyed: DataFrame, bins: list[Bin], ends: list[int], cuts: list[int]) -> DataFrame:
    """Give each row the shard of its bin and its slot there: the one exchange of rows."""
    table, filled = [], {}
    for b, before in zip(bins, ends):
        s = bisect_right(cuts, before)
        table.append({"n": len(table), "level": len(b.at.fixed), "bits": b.at.bits, "p": b.at.prefix, "s": s, "before": filled.get(s, 0)} | {f"f{j}": v for j, v in enumerate(b.at.fixed)})
        filled[s] = filled.get(s, 0) + b.rows
    kinds = sorted({(x["level"], x["bits"]) for x in table})
    places = materialize(_literal(keyed.sparkSession, table, "n: long, level: int, bits: int, p: long, s: int, before: long, f0: long, f1: long"))
    rows = keyed.withColumn("place", F.lit(None).cast("struct<n: long, s: int, before: long>"))
    for level, bits in kinds:
        of = places.filter((F.col("level") == level) & (F.col("bits") == bits)).select("p", "f0", "f1", F.struct("n", "s", "before").alias("here"))
        match = F.shiftright(F.col(f"k{level + 1}"), BITS - bits) == of["p"]
        for j in range(level):
            match &= F.col(f"k{j + 1}") == of[f"f{j}"]
        of = F.broadcast(of) if len(table) <= BROADCAST_BINS else of
        rows = rows.join(of, match, "left").withColumn("place", F.coalesce("place", "here")).drop("p", "f0", "f1", "here")
    rows = rows.select("*", "place.*")
    place = F.row_number().over(W.partitionBy("n").orderBy("k1", "k2", "k3"))
    return rows.withColumns({"shard": F.col("s"), "slot": F.col("before") + place - 1})
