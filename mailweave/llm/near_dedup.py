"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, exact verification.

A document is the set of its distinct word shingles (64-bit hashes). How many words a shingle has
and which similarity links are the rule: ``CONTRACT`` (3 words, 0.85) for the query op10,
``STAGE`` (5 words, 0.8) for the pipeline's stage. Documents with equal sets are one class. A
sketch holds ``Rule.registers`` truncated minima on an exponential scale:
``floor(1 - log_b(min of Exp(a) hashes))``, limited to [0, q + 1]. Sketches merge by maximum and
are locality-sensitive: two registers are equal with a probability of at least the similarity.

Bands of registers give buckets. Pairs of small buckets are kept if the joint likelihood of the
register comparisons (smaller, equal, larger, given both set sizes) peaks at no less than
the threshold less ``Rule.margin``; members of large buckets are tied to the bucket's smallest class, with
no pair left out. The connected components of these ties are candidate clusters; all
documents that may be linked are in one cluster. A cluster's full sets are then compared: one
task per shard of clusters, counting intersections exactly. A wide cluster is dealt into blocks;
a few pivots of the cluster join every block, so that the parts that the blocks find grow
together, and what is still outside the largest component is then compared with all blocks.

A rule has as many bands of 5 registers as it takes to miss a pair at its threshold with a
probability under 5e-7 (25 at 0.85, 37 at 0.8); every link that is returned is confirmed on the
full sets.

Defined results: texts without words (null, empty) have an empty set, are linked with nothing
and keep their own doc_id; rows with the same doc_id are one document; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import (
    blocks,
    broadcast_if_small,
    counted,
    encoded,
    keep_rows,
    lower_ascii,
    materialize,
    mix,
    parts,
    prefix_hash,
    span_hash,
    word_spans,
)
from mailweave.llm.exact_dedup import repeated_fingerprints
from mailweave.operators import graph

ROWS, MISSED = 5, 5e-7
#: Base, rate and limit of the registers (2 bytes each).
BASE, SCALE, LIMIT = 1.001, 20.0, 65534


@dataclass(frozen=True)
class Rule:
    """Words of a shingle and the least similarity of a link: 100 * intersection >= percent * union."""

    words: int
    percent: int

    @property
    def bands(self) -> int:
        return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-min(self.percent / 100, 0.999) ** ROWS))))

    @property
    def registers(self) -> int:
        return self.bands * ROWS

    @property
    def margin(self) -> float:
        """Six standard deviations of the estimate at the threshold."""
        share = self.percent / 100
        return 6 * float(np.sqrt(share * (1 - share) / self.registers))


#: Fixed by the contract of the query op10; the rule of a stage that drops near-duplicates.
CONTRACT, STAGE = Rule(3, 85), Rule(5, 80)
#: Largest bucket whose pairs are all estimated.
SMALL_BUCKET = 8
#: Documents and shingles of a block of a cluster; pivots in each block; shingles of a shard of clusters.
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS, SHARD_SHINGLES = 512, 250_000, 8, 250_000
#: Bytes of sets or sketches, and characters of text, that a task handles at once.
PART_BYTES, PART_TEXT = 1 << 22, 1 << 20
BROADCAST_ROWS = 1_200_000
_LOWEST = -(2**63)


@functools.lru_cache
def _salts(registers: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    xor = rng.integers(0, 1 << 32, registers, dtype=np.uint64).astype(np.uint32)
    return xor, (rng.integers(0, 1 << 32, registers, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingle_sets(texts: list[bytes], words: int = CONTRACT.words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, _, data, offsets in blocks(texts):
        start, end, upto = word_spans(data, offsets)
        h = span_hash(prefix_hash(lower_ascii(data)), start, end)
        many = max(0, len(h) - words + 1)
        sh = np.full(many, 0x243F6A8885A308D3, np.uint64)
        for k in range(words):
            sh = mix(sh * np.uint64(0x9E3779B97F4A7C15) + h[k : k + many])
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(sh[a : b - words + 1]))
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    one = mix(one * np.uint64(0xD1B54A32D192ED03) + h[k : k + 1])
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray], registers: int = CONTRACT.registers) -> np.ndarray:
    """SetSketch registers of non-empty sets: (sets, registers) of unsigned 16-bit numbers."""
    xor, multiply = _salts(registers)
    out = np.empty((len(sets), registers), np.float64)
    at = 0
    while at < len(sets):
        last, total = at, 0
        while last < len(sets) and (last == at or total + len(sets[last]) <= 1 << 16):
            total += len(sets[last])
            last += 1
        flat = (np.concatenate(sets[at:last]) >> np.uint64(32)).astype(np.uint32)
        begin = np.cumsum([0, *[len(s) for s in sets[at : last - 1]]])
        work = np.empty_like(flat)
        for r in range(registers):
            np.bitwise_xor(flat, xor[r], out=work)
            np.multiply(work, multiply[r], out=work)
            out[at:last, r] = np.minimum.reduceat(work, begin)
        at = last
    least = -np.log1p(-(out + 0.5) / 2**32) / SCALE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity at which the joint likelihood of two sketches peaks, on a grid of 1/100.

    Given sizes in proportion u : v and similarity J, a register of the first set is larger with
    probability p(u - v J), smaller with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b).
    """
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.arange(0, 1.001, 0.01)[None, :]
    j = grid * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-9
    like = more * np.log(up + tiny) + less * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, 0) + tiny)
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _set_hash(sets: list[np.ndarray], salt: int) -> np.ndarray:
    return np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def _scan(rule: Rule):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches, size=PART_TEXT):
            sets = shingle_sets(encoded(part["text"]), rule.words)
            regs = np.full(len(sets), None, object)
            full = [k for k, s in enumerate(sets) if len(s)]
            if full:
                rows = sketch([sets[k] for k in full], rule.registers)
                for k, row in zip(full, rows, strict=True):
                    regs[k] = row.astype("<u2").tobytes()
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].array,
                    "text_hash": part["text_hash"].array,
                    "n_shingles": np.array([len(s) for s in sets], np.int64),
                    "s1": _set_hash(sets, 0x5BD1E995),
                    "s2": _set_hash(sets, 0x1B873593A5A5A5A5),
                    "regs": regs,
                }
            )

    return scan


def _band_rows(rule: Rule):
    def band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches, "regs", PART_BYTES // 16):
            regs = np.frombuffer(b"".join(pdf["regs"]), "<u2").reshape(len(pdf), rule.bands, ROWS)
            h = np.broadcast_to(mix(np.arange(rule.bands, dtype=np.uint64) + np.uint64(77)), regs.shape[:2])
            for r in range(ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r].astype(np.uint64))
            yield pd.DataFrame({"fp": h.reshape(-1).view(np.int64), "cid": np.repeat(pdf["cid"].to_numpy(), rule.bands)})

    return band_rows


def _estimate(rule: Rule):
    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches, "regs_a", PART_BYTES // 16):
            a, b = (np.frombuffer(b"".join(pdf[c]), "<u2").reshape(len(pdf), rule.registers) for c in ("regs_a", "regs_b"))
            j = likely_similarity(a, b, pdf["n_a"].to_numpy(float), pdf["n_b"].to_numpy(float))
            keep = j >= rule.percent / 100 - rule.margin - 0.01
            yield pdf.loc[keep, ["a", "b"]]

    return estimate


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the undirected edges (a, b); component is the smallest node."""
    found = graph.connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.withColumnRenamed("id", "node")


class Union:
    """Union by smallest root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x
        return x != y


def linked(sets: list[np.ndarray], known: list | None = None, left: int | None = None, percent: int = CONTRACT.percent) -> list[tuple[int, int]]:
    """Links that connect what the exact rule connects, as pairs of positions.

    Positions with the same ``known`` label count as connected. With ``left``, only pairs of one of
    the first ``left`` sets with any set matter. A pair is skipped if it is connected by then.
    """
    n = len(sets)
    union, found = Union(n), []
    if known is not None:
        first: dict = {}
        for i, k in enumerate(known):
            union.join(first.setdefault(k, i), i)
    size = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.zeros(0), np.zeros(0, np.int64))
    begin = np.cumsum(size) - size
    mark = np.zeros(len(words), np.int32)
    for i in range(n if left is None else min(left, n)):
        own = union.root(i)
        if len(sets) == 2:
            others = np.array([j for j in range(i + 1, n) if union.root(j) != own], np.int64)
        else:
            roots = np.fromiter((union.root(j) for j in range(i + 1, n)), np.int64, n - i - 1)
            others = i + 1 + np.flatnonzero(roots != own)
        near = 100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])
        others = others[near]
        if not len(others):
            continue
        mine = flat[begin[i] : begin[i] + size[i]]
        mark[mine] = 1
        length = size[others]
        cut = np.cumsum(length) - length
        at = np.repeat(begin[others] - cut, length) + np.arange(length.sum())
        shared = np.add.reduceat(mark[flat[at]], cut)
        mark[mine] = 0
        hit = others[100 * shared >= percent * (size[i] + length - shared)]
        for j in hit.tolist():
            if union.join(i, j):
                found.append((i, j))
    return found


def _sets_of(rule: Rule):
    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches, size=PART_TEXT):
            sets = shingle_sets(encoded(part["text"]), rule.words)
            right = (_set_hash(sets, 0x5BD1E995) == part["s1"].to_numpy()) & (_set_hash(sets, 0x1B873593A5A5A5A5) == part["s2"].to_numpy())
            out = part.loc[right, ["cid", "cluster", "n_docs", "n_all"]].copy()
            out["items"] = [s.tobytes() for s, ok in zip(sets, right, strict=True) if ok]
            yield out

    return sets_of


def _read_sets(items) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in items]


def _link_shard(rule: Rule):
    def link_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cluster", "cid"]).drop_duplicates("cid")
        cid, cluster = pdf["cid"].to_numpy(), pdf["cluster"].to_numpy()
        items = pdf["items"].tolist()
        cuts = np.append(np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1)), len(cluster))
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out += [(cid[a + i], cid[a + j]) for i, j in linked(_read_sets(items[a:b]), percent=rule.percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return link_shard


def _link_across(rule: Rule):
    """One block of rows outside the largest component (side 0) against one block of all (side 1)."""

    def link_across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "cid"]).drop_duplicates("cid")
        cid = pdf["cid"].to_numpy()
        links = linked(_read_sets(pdf["items"]), pdf["component"].tolist(), int((pdf["side"] == 0).sum()), rule.percent)
        return pd.DataFrame([(cid[i], cid[j]) for i, j in links], columns=["a", "b"], dtype="int64")

    return link_across


def _candidate_edges(classes: DataFrame, rule: Rule) -> DataFrame:
    """Ties (a, b) between classes; classes that may be linked are connected by them."""
    sketches = classes.select("cid", "regs")
    bands = sketches.mapInPandas(_band_rows(rule), "fp long, cid long")
    shared, n = counted(repeated_fingerprints(sketches, of=_band_rows(rule)).withColumnRenamed("n", "members"))
    member = materialize(bands.join(broadcast_if_small(shared, n, BROADCAST_ROWS), "fp"))
    small = (
        member.filter(F.col("members") <= SMALL_BUCKET)
        .groupBy("fp").agg(F.sort_array(F.collect_list("cid")).alias("c"))
        .select(F.explode(F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, SMALL_BUCKET), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
        .select("p.a", "p.b").distinct()
    )
    left = classes.select(F.col("cid").alias("a"), F.col("regs").alias("regs_a"), F.col("n_shingles").alias("n_a"))
    right = classes.select(F.col("cid").alias("b"), F.col("regs").alias("regs_b"), F.col("n_shingles").alias("n_b"))
    likely = small.join(left, "a").join(right, "b").select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInPandas(_estimate(rule), "a long, b long")
    large = member.filter(F.col("members") > SMALL_BUCKET)
    leader = large.groupBy("fp").agg(F.min("cid").alias("a"))
    stars = large.join(leader, "fp").filter("cid != a").select("a", F.col("cid").alias("b")).distinct()
    return likely.unionByName(stars)


def _exact_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, rule: Rule) -> DataFrame:
    """Confirmed links (a, b) between classes that connect each component."""
    sizes = (
        clusters.join(classes.select(F.col("cid").alias("node"), "n_shingles"), "node")
        .groupBy("cluster").agg(F.count("*").alias("n_docs"), F.sum("n_shingles").alias("n_all"))
    )
    wanted, n = counted(
        clusters.join(sizes, "cluster").join(classes.select(F.col("cid").alias("node"), "low", "s1", "s2"), "node")
        .select(F.col("node").alias("cid"), "cluster", "n_docs", "n_all", "low", "s1", "s2")
    )
    sets = docs.select("doc_id", "text").join(
        broadcast_if_small(wanted, n, BROADCAST_ROWS // 4), F.coalesce("doc_id", F.lit(_LOWEST)) == F.col("low")
    ).select("cid", "cluster", "n_docs", "n_all", "s1", "s2", "text").mapInPandas(
        _sets_of(rule), "cid long, cluster long, n_docs long, n_all long, items binary"
    )
    sets = materialize(sets)
    wide = (F.col("n_docs") > BLOCK_DOCS) | (F.col("n_all") > BLOCK_SHINGLES)
    total = sizes.agg(F.sum("n_all")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_SHINGLES))
    n_blocks = F.greatest(F.ceil(F.col("n_docs") / BLOCK_DOCS), F.ceil(F.col("n_all") / BLOCK_SHINGLES)).cast("long")
    block = F.pmod(F.xxhash64("cid"), n_blocks)
    narrow = (
        sets.filter(~wide)
        .withColumn("shard", F.pmod(F.xxhash64("cluster"), F.lit(shards)))
        .select("shard", "cluster", "cid", "items")
        .groupBy("shard").applyInPandas(_link_shard(rule), "a long, b long")
    )
    if not sets.filter(wide).limit(1).count():
        return materialize(narrow)
    broad = sets.filter(wide).withColumn("n_blocks", n_blocks).withColumn("block", block)
    # The first document by hash of each of a cluster's first blocks joins all of its blocks.
    place = F.struct(F.xxhash64("cid", F.lit(9)).alias("h"), "cid")
    first = broad.filter(F.col("block") < PIVOTS).groupBy("cluster", "block").agg(F.min(place).alias("p")).select("p.cid")
    pivots = broad.join(first, "cid", "left_semi")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    inside = (
        broad.select("cluster", "block", "cid", "items").unionByName(pivots.withColumn("block", every).select("cluster", "block", "cid", "items"))
        .groupBy("cluster", "block").applyInPandas(_link_shard(rule), "a long, b long")
    )
    links = materialize(narrow.unionByName(inside))
    part = connected_components(links).withColumnRenamed("node", "cid")
    # What isn't in its cluster's largest component is compared with all blocks of the cluster.
    labelled = materialize(broad.join(part, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    most = (
        labelled.groupBy("cluster", "component").agg(F.count("*").alias("k"))
        .groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("largest"))
    )
    rest = labelled.join(most, "cluster").filter("component != largest")
    # as many blocks of the rest as its own size asks for
    weight = rest.groupBy("cluster").agg(F.count("*").alias("k"), F.sum(F.length("items") / 8).alias("s"))
    n_rest = F.greatest(F.ceil(F.col("k") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("long")
    rest = materialize(
        rest.join(weight.select("cluster", n_rest.alias("n_rest")), "cluster")
        .withColumn("rest_block", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("n_rest")))
    )
    columns = ["cluster", "cid", "component", "items"]
    used = rest.select("cluster", "rest_block").distinct()
    one = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    across = (
        one.select(*columns, "rest_block", "block", F.lit(0).alias("side"))
        .unionByName(labelled.join(used, "cluster").select(*columns, "rest_block", "block", F.lit(1).alias("side")))
        .groupBy("cluster", "rest_block", "block").applyInPandas(_link_across(rule), "a long, b long")
    )
    return materialize(links.unionByName(across))


def _judged(docs: DataFrame, rule: Rule) -> DataFrame:
    """Every row with its component: doc_id, n_shingles, text_hash, part (a number of the component, null without words), component_low.

    Nulls of doc_id are the smallest long.
    """
    low = F.coalesce("doc_id", F.lit(_LOWEST)).cast("long").alias("doc_id")
    sketched = materialize(
        docs.select(low, F.xxhash64("text").alias("text_hash"), "text")
        .mapInPandas(_scan(rule), "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, regs binary")
    )
    classes = materialize(
        sketched.filter("n_shingles > 0").groupBy("s1", "s2")
        .agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.min_by("regs", "doc_id").alias("regs"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    clusters = materialize(connected_components(_candidate_edges(classes, rule))).withColumnRenamed("component", "cluster")
    parts = materialize(connected_components(_exact_links(docs, classes, clusters, rule)))
    of = parts.join(classes.select(F.col("cid").alias("node"), "low", "s1", "s2"), "node")
    least = of.groupBy("component").agg(F.min("low").alias("component_low"))
    moved = of.join(least, "component").select("s1", "s2", "component", "component_low")
    best = classes.select("s1", "s2", "low", "cid").join(moved, ["s1", "s2"], "left")
    best, n = counted(best.select("s1", "s2", F.coalesce("component", "cid").alias("part"), F.coalesce("component_low", "low").alias("component_low")))
    out = sketched.select("doc_id", "text_hash", "n_shingles", "s1", "s2").join(
        broadcast_if_small(best, n, BROADCAST_ROWS // 2), ["s1", "s2"], "left"
    )
    some = F.col("n_shingles") > 0
    return out.select(
        "doc_id", "text_hash", "n_shingles", F.when(some, F.col("part")).alias("part"),
        F.when(some, F.col("component_low")).otherwise(F.col("doc_id")).alias("component_low"),
    )


def near_components(docs: DataFrame, words: int = CONTRACT.words, percent: int = CONTRACT.percent) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    known = lambda c, name: F.when(F.col(c) != _LOWEST, F.col(c)).alias(name)
    return _judged(docs, Rule(words, percent)).select(
        known("doc_id", "doc_id"), "n_shingles", known("component_low", "component_id"), (F.col("component_low") == F.col("doc_id")).alias("kept")
    )


def keep_one_of_near(docs: DataFrame, words: int = STAGE.words, percent: int = STAGE.percent) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, with all of its columns.

    Where several rows of a component have that doc_id (or none), the one whose text has the
    smallest hash stays, and one of rows that are equal in both. Texts without words all stay.
    """
    rows = _judged(docs.select("doc_id", "text"), Rule(words, percent)).filter("component_low = doc_id")
    texts = rows.groupBy("part", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    one = texts.filter("part is not null").groupBy("part").agg(F.min_by(F.struct("doc_id", "text_hash", "rows"), "text_hash").alias("x")).select("x.*")
    chosen = one.unionByName(texts.filter("part is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("rows")))
    chosen = chosen.select(F.when(F.col("doc_id") != _LOWEST, F.col("doc_id")).alias("__id"), F.col("text_hash").alias("__hash"), F.col("rows").alias("__rows"))
    return keep_rows(docs, chosen, BROADCAST_ROWS // 2)
