"""Mixing sources to target weights by the cube method.

Water filling gives each source a target. A document enters its source's mix
``floor(rate)`` times for certain, where rate = target / size of the source, and once more
with the fractional inclusion probability. The cube method decides these fractions: the flight
phase moves three undecided probabilities at a time along the null space of the two balancing
equations (words and documents), so both totals keep their expectation exactly, until at most
two documents of a block are undecided. Large documents are decided first, so the rest is small.
Blocks of a source are flown independently, the undecided rest of all blocks meets in the next
round, and the last block of a source lands: when ``LANDING`` documents are left, of all their
roundings the one nearest to the balanced totals is taken, and while it brings the words nearer,
two of the block's documents are decided anew, one in and one out.

Blocks are dealt by hash, so a hot source becomes many blocks of bounded size. The generator of
a block is seeded by source, round and block and rows are ordered by hash: reruns agree.

Defined results: null text has size 0; null source is a source of its own, last in order; rows
that repeat are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailweave.llm.common import broadcast_if_small, counted, materialize, word_count
from mailweave.session import measured

#: Weights of the sources in order, repeated (fixed by the contract of the query).
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and the most times that a source may be taken.
SHARE, MOST = 1.5, 2.0
#: Documents that one block of the flight holds.
BLOCK_ROWS = 4096
#: Undecided documents of a source whose roundings are all tried.
LANDING = 12
BROADCAST_SOURCES = 100_000


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: its order, documents, size, weight and target.

    The targets solve ``sum(min(most * size, level * weight)) = share * all sizes``: sources are
    ordered by the level at which they fill up and running sums give the level. The two windows
    without a partition run over one row per source, never over documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("place", place).withColumn("weight", F.get(cycle, F.col("place") % len(weights)))
    filled = most * F.col("source_size") / F.col("weight")
    by_level = W.orderBy("filled", "place")
    budget = share * F.sum("source_size").over(W.partitionBy())
    before = F.sum(most * F.col("source_size")).over(by_level) - most * F.col("source_size")
    left = F.sum("weight").over(W.partitionBy()) - F.sum("weight").over(by_level) + F.col("weight")
    levels = ranked.withColumn("filled", filled).withColumn("level", (budget - before) / left)
    level = F.min(F.when(F.col("level") <= F.col("filled"), F.struct("filled", "place", "level"))).over(W.partitionBy())["level"]
    return levels.withColumn("water", level).select(
        "source",
        "place",
        "n_docs",
        "source_size",
        "weight",
        F.coalesce(F.least(most * F.col("source_size"), F.col("water") * F.col("weight")), F.lit(0.0)).alias("target"),
    )


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, rest: int = 2) -> np.ndarray:
    """Flight phase of one block: probabilities of which about ``rest`` (or two) are still fractional.

    Both ``sum(p)`` and ``sum(p * size)`` are kept but for rounding errors.
    """
    p = p.astype(float).copy()
    z = size.astype(float)
    pool = [i for i in np.argsort(size, kind="stable").tolist() if 0 < p[i] < 1]  # the last are taken first
    draws = rng.random(len(p) + 1)
    step, tiny = 0, 1e-12
    live: list[int] = []
    while True:
        if len(live) + len(pool) <= rest:
            return p
        while len(live) < 3 and pool:
            live.append(pool.pop())
        if len(live) < 3:
            if len(live) == 2 and z[live[0]] == z[live[1]]:
                v = (1.0, -1.0)
            else:
                return p
        else:
            a, b, c = (z[i] for i in live)
            v = (b - c, c - a, a - b)
            if not any(v):
                v = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(live, v, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(live, v, strict=True) if x)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        for i, x in zip(live, v, strict=True):
            p[i] += move * x
            if p[i] < tiny:
                p[i] = 0.0
            elif p[i] > 1 - tiny:
                p[i] = 1.0
        live = [i for i in live if 0 < p[i] < 1]


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Round the few fractional probabilities so that words, then documents, stay nearest."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) == 0:
        return p
    masks = np.array([[m >> k & 1 for k in range(len(open_))] for m in range(1 << len(open_))], float)
    words = np.abs((masks - p[open_]) @ size[open_].astype(float))
    docs = np.abs((masks - p[open_]).sum(1))
    p[open_] = masks[np.lexsort((docs, words))[0]]
    return p


def swap(size: np.ndarray, p: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exchange pairs of one taken and one left document while the words come nearer to ``wanted``."""
    p = p.copy()
    z = size.astype(float)
    miss = float(((wanted - p) * z).sum())
    for _ in range(len(p)):
        taken, left = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if not len(taken) or not len(left):
            break
        left = left[np.argsort(z[left], kind="stable")]
        at = np.searchsorted(z[left], z[taken] + miss)
        other = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(left) - 1)])
        off = np.abs(z[left[other]] - z[taken] - miss)
        k, i = np.unravel_index(int(off.argmin()), off.shape)
        if off[k, i] >= abs(miss):
            break
        j = left[other[k, i]]
        miss -= z[j] - z[taken[i]]
        p[taken[i]], p[j] = 0.0, 1.0
    return p


def _flight(number: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dealt", "doc_id", "size"], kind="stable")
        rng = np.random.default_rng([number, int(key[0]), int(key[1])])
        size = pdf["size"].to_numpy(np.int64)
        last = pdf["n_blocks"].iloc[0] == 1
        p = fly(size, pdf["p"].to_numpy(float), rng, LANDING if last else 2)
        if last:
            p = swap(size, land(size, p), pdf["p"].to_numpy(float))
        return pdf.assign(p=p)[["place", "doc_id", "text_hash", "size", "dealt", "p"]]

    return run


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, copies and taken of every row of ``docs``."""
    sized = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    )
    targets, n_sources = counted(source_targets(sized, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    plan = targets.select("place", F.col("source").alias("of"), rate.alias("rate"))
    todo = sized.join(
        broadcast_if_small(plan, n_sources, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")), "inner"
    ).select(
        "place",
        "doc_id",
        "text_hash",
        "size",
        F.xxhash64("doc_id", "text_hash").alias("dealt"),
        (F.col("rate") - F.floor("rate")).alias("p"),
    )
    schema = ", ".join(f"{c} {t}" for c, t in todo.dtypes)
    decided, number = [], 0
    while True:
        counts = todo.filter("p > 0 and p < 1").groupBy("place").agg(F.count("*").alias("n"))
        blocks = counts.select("place", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("n_blocks"))
        dealt = todo.filter("p > 0 and p < 1").join(
            broadcast_if_small(blocks, n_sources, BROADCAST_SOURCES), "place"
        ).withColumn("block", F.pmod(F.xxhash64(F.col("dealt"), F.lit(number)), F.col("n_blocks")))
        flown = materialize(dealt.groupBy("place", "block").applyInPandas(_flight(number), schema))
        decided += [todo.filter("p <= 0 or p >= 1")]
        open_rows = flown.filter("p > 0 and p < 1").limit(1).count()
        todo, number = flown, number + 1
        if not open_rows:
            decided += [flown]
            break
    done = decided[0]
    for d in decided[1:]:
        done = done.unionByName(d)
    facts = targets.withColumn("whole", F.floor(rate)).select("place", "source", "source_size", "target", "whole")
    out = done.join(broadcast_if_small(facts, n_sources, BROADCAST_SOURCES), "place")
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` repeated as often as the mix takes them, with all of their columns.

    Rows are matched by doc_id and text; what rows equal in both take together is dealt out among
    them, so that their copies differ by one at most.
    """
    plan, seen = measured(
        mix_sources(docs.select("doc_id", "text", "source"), **settings)
        .groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"))
        .agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")),
        repeated=F.count_if(F.col("rows") > 1),
    )
    # the row travels as one value, so no column of it can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("text_hash"))
    hit = rows.join(plan.filter("copies > 0"), F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash")))
    taken = hit.filter("rows = 1").select("row", F.col("copies").alias("n"))
    if seen["repeated"]:
        place = F.row_number().over(W.partitionBy("id", "text_hash").orderBy(F.xxhash64("row")))
        share = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("place") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
        taken = taken.unionByName(hit.filter("rows > 1").withColumn("place", place).select("row", share.cast("long").alias("n")).filter("n > 0"))
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).select("row.*")
