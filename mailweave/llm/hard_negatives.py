"""Hard negatives by norm-bucketed search for the largest inner products.

Vectors become integers (floor of ``SCALE`` times each component), so inner products are exact.
Candidates are sorted by falling norm and cut into buckets that know their largest norm. Anchors go
in blocks, buckets in stripes that each hold buckets of all norms, and a task meets one block with
one stripe, from the longest vectors on. By Cauchy and Schwarz no score in a bucket exceeds its
largest norm times the anchor's; where that stays under an anchor's running k-th score, or under the
lower limit of its window, the bucket and all later ones are left out for it. The first search finds
each anchor's positives (the best of its label), which set windows of scores; the second finds the best of
other labels inside each window, and only buckets that can reach the lowest limit of a block are sent to it.
Every task gives k rows at most for each anchor or window, and one window function merges them.

Rows that an anchor is compared with number (anchors x candidates) less what the bounds prune; with
norms all alike they prune nothing but scores under a window. No bucket, candidate or window is capped.

Defined results: rows with a null label or vector or a component that is null or not finite take no
part, nor do vectors whose scaled norm reaches 2^31 (their scores need not fit a long); vectors of
unlike length are compared as if zeros followed; a null vec_id is no anchor and comes last among ties;
repeated rows are rows: each is an anchor, and a copy is another row; an anchor without rows of its
label has no windows, nor has a window below zero any score (80 per cent of it lie above it); an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailweave.llm.common import release, shuffle_partitions
from mailweave.session import measured

SCALE, BEST, LOW_PERCENT = 256.0, 5, 80
#: Rows of a bucket, of a stripe at most, of a stripe at least, of a block of anchors, and of what is compared at once.
BUCKET, STRIPE, LEAST_STRIPE, BLOCK, PART = 1024, 1 << 17, 1 << 11, 1 << 14, 256
#: Norms are rounded sums: bounds are taken this much larger.
_SLACK = 1 + 1e-9
_LAST = 2**63 - 1
#: Up to here sums of products are exact in floating point.
_EXACT = 2.0**53


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, norm, vector) with integer vectors as bytes, without rows that take no part."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, labels, norms, vectors = [], [], [], []
            for at, vector in zip(range(len(pdf)), pdf["vector"]):
                x = np.array([np.nan if v is None else v for v in vector], np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(SCALE * x)
                norm = float(np.sqrt(np.dot(x, x)))
                if norm < 2.0**31:
                    ids.append(pdf["vec_id"].iat[at])
                    labels.append(pdf["label"].iat[at])
                    norms.append(norm)
                    vectors.append(x.astype("<i4").tobytes())
            yield pd.DataFrame({"vec_id": ids, "label": labels, "norm": norms, "vector": vectors})
            release()

    rows = rows.select(F.coalesce("vec_id", F.lit(_LAST)).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").alias("vector"))
    return rows.filter("label IS NOT NULL AND vector IS NOT NULL").mapInPandas(scan, "vec_id long, label long, norm double, vector binary")


def matrix(vectors) -> np.ndarray:
    """The vectors as rows, shorter ones followed by zeros."""
    rows = [np.frombuffer(v, "<i4") for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def bucketed(rows: DataFrame, size: int = BUCKET) -> DataFrame:
    """(top, held, ids, labels, keys, width, vectors): buckets of rows with nearly equal norms; ``top`` is the largest."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                # inside a bucket by vec_id, so that the first of equal scores is the least
                part = pdf.iloc[at : at + size].sort_values("vec_id", kind="stable")
                m = matrix(part["vector"]).astype("<i4")
                yield pd.DataFrame(
                    {
                        "top": [part["norm"].max()], "held": [len(part)], "ids": [part["vec_id"].to_numpy("<i8").tobytes()], "labels": [part["label"].to_numpy("<i8").tobytes()],
                        "keys": [part["key"].to_numpy("<i8").tobytes()], "width": [m.shape[1]], "vectors": [m.tobytes()],
                    }
                )
            release()

    by = [F.desc("norm"), F.asc("key")]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    return dealt.mapInPandas(pack, "top double, held long, ids binary, labels binary, keys binary, width int, vectors binary")


def _scores(anchors: np.ndarray, bucket: np.ndarray, bound: float) -> np.ndarray:
    wide = min(anchors.shape[1], bucket.shape[1])
    a, b = anchors[:, :wide], bucket[:, :wide]
    if bound < _EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Best:
    """The k best (score, id) of each window so far; ties go to the smaller id."""

    def __init__(self, windows: int, k: int) -> None:
        self.k = k
        self.window = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.kth = np.full(windows, -(2**63), np.int64)  # of windows with k scores

    def add(self, window: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        w, s, i = np.concatenate([self.window, window]), np.concatenate([self.score, score]), np.concatenate([self.id, ident])
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        place = np.arange(len(w)) - np.repeat(first, np.diff(np.r_[first, len(w)]))
        keep = place < self.k
        self.window, self.score, self.id = w[keep], s[keep], i[keep]
        full = place == self.k - 1
        self.kth[w[full]] = s[full]


def search_stripe(anchors: pd.DataFrame, buckets: pd.DataFrame, k: int, low_percent: int | None) -> pd.DataFrame:
    """(key, window, score, other): the k best of each anchor (``low_percent`` None) or of each of its windows in these buckets."""
    buckets = buckets.sort_values("top", ascending=False, kind="stable")
    found = []
    for at in range(0, len(anchors), PART):
        part = anchors.iloc[at : at + PART]
        a, norm, label, key = matrix(part["vector"]), part["norm"].to_numpy(), part["label"].to_numpy(), part["key"].to_numpy()
        if low_percent is None:
            of, place, most = np.arange(len(part)), np.zeros(len(part), np.int64), np.full(len(part), _LAST)
            least = np.full(len(part), -(2**63), np.int64)
        else:
            scores = [np.asarray(x, np.int64) for x in part["scores"]]
            of = np.repeat(np.arange(len(part)), [len(x) for x in scores])
            place = np.concatenate([np.arange(len(x)) for x in scores]) if scores else np.zeros(0, np.int64)
            most = np.concatenate(scores) if scores else np.zeros(0, np.int64)
            least = -((-most * low_percent) // 100)  # of 100 * score >= low_percent * most
        best = Best(len(of), k)
        for b in buckets.itertuples(index=False):
            need = np.maximum(best.kth, least)
            live = np.flatnonzero(norm[of] * b.top * _SLACK >= need.astype(np.float64) * (1 - 1e-12))
            live = live[most[live] >= least[live]]
            if not len(live):
                break  # buckets after this one have smaller norms
            used = np.unique(of[live])
            held = int(b.held)
            m = np.frombuffer(b.vectors, "<i4").reshape(held, b.width).astype(np.float64)
            ids, labels, keys = (np.frombuffer(x, "<i8") for x in (b.ids, b.labels, b.keys))
            s = _scores(a[used], m, float(norm[used].max() * b.top))
            row = np.searchsorted(used, of[live])
            mine = labels[None, :] == label[used][:, None]
            fits = mine & (keys[None, :] != key[used][:, None]) if low_percent is None else ~mine
            hit = fits[row] & (s[row] >= need[live][:, None]) & (s[row] <= most[live][:, None])
            w, c = np.nonzero(hit)
            if len(w):
                best.add(live[w], s[row[w], c], ids[c])
        found.append(pd.DataFrame({"key": key[of[best.window]], "window": place[best.window].astype(np.int32), "score": best.score, "other": best.id}))
    release()
    return pd.concat(found) if found else pd.DataFrame({"key": [], "window": [], "score": [], "other": []})


def _search(anchors: DataFrame, buckets: DataFrame, stripes: int, k: int, low_percent: int | None) -> DataFrame:
    """(key, window, rank, score, other): merged over the stripes. anchors: key, block, label, norm, vector, scores."""
    need = F.lit(float("-inf")) if low_percent is None else F.when(F.array_max("scores") >= 0, F.array_min(F.filter("scores", lambda x: x >= 0)) * (low_percent / 100) / F.greatest("norm", F.lit(1e-300)))
    if low_percent is not None:
        anchors = anchors.filter(F.array_max("scores") >= 0)  # no score lies in a window below zero
    anchors = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    blocks = anchors.groupBy(F.col("block").alias("to"), F.col("stripe").alias("part")).agg(F.min(need).alias("need"))
    # a bucket goes to the blocks of which a window can be reached in it
    sent = buckets.join(blocks, (F.col("in_stripe") == F.col("part")) & (F.col("top") * _SLACK >= F.col("need"))).drop("in_stripe", "need")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_stripe(left, right, k, low_percent)

    met = anchors.groupBy("block", "stripe").cogroup(sent.groupBy("to", "part")).applyInPandas(meet, "key long, window int, score long, other long")
    place = F.row_number().over(W.partitionBy("key", "window").orderBy(F.desc("score"), F.asc("other")))
    return met.withColumn("rank", place).filter(F.col("rank") <= k)


def mine_negatives(
    rows: DataFrame, anchor: Column, label: Column, positives: int = BEST, negatives: int = BEST, low_percent: int = LOW_PERCENT
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, ...).

    anchor: which rows are anchors; label: the label of a row.
    """
    clean = usable(rows, label).withColumn("key", F.monotonically_increasing_id())
    clean, seen = measured(clean, rows=F.count(F.lit(1)))
    stripes = max(-(-seen["rows"] // STRIPE), min(shuffle_partitions(rows.sparkSession), -(-seen["rows"] // LEAST_STRIPE)), 1)
    # buckets are dealt to stripes by chance, so that every stripe has some of all norms
    buckets = measured(bucketed(clean).withColumn("in_stripe", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(stripes)).cast("int")))[0]
    asked = clean.filter((F.col("vec_id") != _LAST) & anchor)
    asked, seen = measured(asked, rows=F.count(F.lit(1)))
    blocks = max(1, -(-seen["rows"] // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    near = measured(_search(asked.withColumn("scores", F.lit(None).cast("array<long>")), buckets, stripes, positives, None))[0]
    windows = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "other"))).alias("best"))  # positives at most
    asked = measured(asked.join(windows, "key").withColumn("scores", F.col("best.score")))[0]
    far = _search(asked.drop("best"), buckets, stripes, negatives, low_percent)
    named = asked.select("key", F.col("vec_id").alias("anchor_id"), F.posexplode("best").alias("window", "positive"))
    ident = lambda c: F.nullif(c, F.lit(_LAST))
    return far.join(named, ["key", "window"]).select(
        "anchor_id", ident(F.col("positive.other")).alias("positive_id"), "rank", ident(F.col("other")).alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
