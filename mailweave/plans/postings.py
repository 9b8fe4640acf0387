"""A persisted inverted index: posting lists in blocks with bounds, added to by batches, searched without reading the rest.

A batch of texts becomes one segment. Its texts are dealt to cells by their length and a hash, at
most about ``CELL`` texts each; the postings of a term in a cell are one block, which holds the ids,
counts and lengths, and also the largest count and the least length for each count. Blocks lie in folders by a hash of
the term. A manifest names the live segments, so a batch is added, repeated or merged in one step.

A search reads the bounds of its words' blocks only. What a text of a cell can score at most follows
from them, so the best cells are scored first, and of the others only those that can still reach the
last place are read. Scores are those of :func:`listing.full_text`.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave import snapshots
from mailweave.functions.text import searchable_terms
from mailweave.operators.algebra import top
from mailweave.plans.listing import B, K1, NothingToSearch
from mailweave.session import measured

#: Folders by term, texts and words of a cell, cells that a search scores first, words of texts for each file of a folder.
BUCKETS, CELL, CELL_WORDS, FIRST, FILE = 64, 1024, 1_000_000, 16, 4_000_000
#: Scores are rounded to six digits, so a bound has to be lower by more than that to be out of reach.
_ROUNDED = 1e-6


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _dealt(blocks: DataFrame, tokens: int) -> DataFrame:
    """Blocks beside their folder, where they will be written; a frequent term's may go to several files."""
    part = F.pmod(F.xxhash64("cell"), F.lit(max(1, tokens // FILE)))
    return blocks.withColumns({"bucket": _bucket(F.col("term")), "part": part}).repartition("bucket", "part")


def share_of(tf: Column, n: Column, mean: float) -> Column:
    """What a word adds to a score for each unit of its weight; grows with tf and falls with n."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / F.lit(mean)))


def most_of(top_tf: Column, least_ratio: Column, mean: float) -> Column:
    """What :func:`share_of` can be at most in a block, from its largest count and its least length for each count."""
    return (K1 + 1) / (1 + K1 * ((1 - B) / top_tf + B * least_ratio / F.lit(mean)))


@dataclass(frozen=True)
class PostingsIndex:
    """The index in a folder that the driver and the executors share."""

    spark: SparkSession
    path: str

    def segments(self) -> dict[str, dict]:
        """Live segments by name: folder, texts and words of each."""
        return (snapshots.current(self.spark, self.path) or {}).get("segments", {})

    def add(self, texts: DataFrame, segment: str) -> None:
        """Index texts (id, text) as a segment; a segment of that name is replaced, so a batch may come again."""
        rows = texts.select("id", searchable_terms(F.col("text")).alias("t")).select("id", "t", F.size("t").alias("n")).filter("n > 0")
        lengths = rows.select("id", "n").distinct().withColumn("size", F.floor(F.log2("n")).cast("int"))
        lengths, seen = measured(lengths, docs=F.count(F.lit(1)), tokens=F.coalesce(F.sum("n"), F.lit(0)))
        parts = lengths.groupBy("size").agg(F.ceil(F.greatest(F.count("*") / CELL, F.sum("n") / CELL_WORDS)).cast("long").alias("parts"))  # a row for each doubling of the length
        size = F.floor(F.log2("n")).cast("int")
        dealt = rows.withColumn("size", size).join(F.broadcast(parts), "size")
        cell = F.col("size") * F.lit(1 << 40) + F.pmod(F.xxhash64("id"), F.col("parts"))
        # texts are dealt to their cells before they become postings, so only they are moved
        terms = dealt.select("id", "n", cell.alias("cell"), F.array_join("t", " ").alias("t")).repartition("cell").select("id", "n", "cell", F.explode(F.split("t", " ")).alias("term"))
        counted = terms.groupBy("cell", "term", "id", "n").agg(F.count("*").alias("tf"))
        p = F.struct("id", "tf", "n")
        blocks = counted.groupBy("term", "cell").agg(F.collect_list(p).alias("p"), F.max("tf").alias("top_tf"), F.min(F.col("n") / F.col("tf")).alias("least_ratio"), F.count("*").alias("docs"))  # a cell's texts at most
        self._put(_dealt(blocks, seen["tokens"]), segment, {"docs": seen["docs"], "tokens": seen["tokens"]}, [segment])

    def merge(self, name: str, segments: list[str] | None = None) -> None:
        """Make one segment of several (all unless named); the others stay as they are."""
        live = self.segments()
        old = list(live) if segments is None else segments
        sums = {k: sum(live[s][k] for s in old) for k in ("docs", "tokens")}
        p = F.transform(F.arrays_zip("ids", "tfs", "ns"), lambda z: F.struct(z["ids"].alias("id"), z["tfs"].alias("tf"), z["ns"].alias("n")))
        # blocks are moved as they are, and join where they will be written
        dealt = _dealt(self._read([live[s]["folder"] for s in old]).select("term", "cell", p.alias("p"), "top_tf", "least_ratio", "docs"), sums["tokens"])
        joined = dealt.groupBy("bucket", "part", "term", "cell").agg(F.flatten(F.collect_list("p")).alias("p"), F.max("top_tf").alias("top_tf"), F.min("least_ratio").alias("least_ratio"), F.sum("docs").alias("docs"))
        self._put(joined, name, sums, old)

    def _put(self, rows: DataFrame, segment: str, sums: dict[str, int], instead: list[str]) -> None:
        """Write a segment to a folder of its own, then let it live in place of others; readers see one or the other."""
        folder = f"{segment}-{uuid.uuid4().hex[:12]}"
        self._write(rows, folder)
        now = {s: x for s, x in self.segments().items() if s not in instead} | {segment: {"folder": folder} | sums}
        snapshots.publish(self.spark, self.path, {"segments": now})
        # searches that began before may still read what the last two manifests name
        gone = {x["folder"] for old in snapshots.forget(self.spark, self.path) for x in old["segments"].values()}
        kept = {x["folder"] for v in snapshots.versions(self.spark, self.path) for x in snapshots.current(self.spark, self.path, v)["segments"].values()}
        for f in gone - kept:
            snapshots.remove(self.spark, f"{self.path}/segment={f}")

    def _write(self, rows: DataFrame, folder: str) -> None:
        if not re.fullmatch(r"[\w.-]+", folder):
            raise ValueError(f"{folder} can't name a folder")
        blocks = rows.select(
            "term", "cell", F.col("docs").cast("int").alias("docs"), F.col("top_tf").cast("int").alias("top_tf"), "least_ratio",
            F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.n").alias("ns"), "bucket",
        )
        # terms lie in order, so that readers skip by their bounds
        blocks.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/segment={folder}")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/segment={f}" for f in folders])

    def blocks_of(self, words: list[str]) -> DataFrame:
        """Blocks of some terms; other folders aren't listed, other terms' row groups aren't read."""
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[_bucket(F.lit(w)) for w in words]))).collect()]
        return self._read([x["folder"] for x in self.segments().values()]).filter(F.col("bucket").isin(sorted(set(buckets))) & F.col("term").isin(words))

    def search(self, query: str, limit: int | None = 50) -> DataFrame:
        """(id, score): texts that hold every word of the query, best first; the same as the scan of all postings."""
        return self.plan(query, limit)[0]

    def plan(self, query: str, limit: int | None = 50) -> tuple[DataFrame, dict[str, int]]:
        """What :meth:`search` returns, and how many cells hold all words and how many of them it scores."""
        words = sorted({x.lower() for x in re.findall(r"[^\W_]+", query)})
        if not words:
            raise NothingToSearch(query)
        sums = list(self.segments().values())
        docs, tokens = sum(x["docs"] for x in sums), sum(x["tokens"] for x in sums)
        if not docs:
            return self.spark.createDataFrame([], "id long, score double"), {"cells": 0, "scored": 0}
        mean, blocks = tokens / docs, self.blocks_of(words)
        df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("docs").alias("df")).collect()}  # a row per word
        weight = F.element_at(F.create_map(*[x for w, n in df.items() for x in (F.lit(w), F.log(F.lit(1 + (docs - n + 0.5) / (n + 0.5))))]), F.col("term")) if df else F.lit(0.0)
        best = F.sum(weight * most_of(F.col("top_tf"), F.col("least_ratio"), mean)).alias("best")
        cells = blocks.groupBy("segment", "cell").agg(best, F.count("*").alias("terms")).filter(F.col("terms") == len(words)).drop("terms")
        cells, seen = measured(cells, n=F.count(F.lit(1)))

        def scored(some: DataFrame) -> DataFrame:
            own = blocks.join(some.select("segment", "cell"), ["segment", "cell"]).select("term", F.explode(F.arrays_zip("ids", "tfs", "ns")).alias("p"))
            each = own.groupBy(F.col("p.ids").alias("id")).agg(F.sum(weight * share_of(F.col("p.tfs"), F.col("p.ns"), mean)).alias("score"), F.count("*").alias("k"))
            return each.filter(F.col("k") == len(words)).select("id", F.round("score", 6).alias("score"))

        if limit is None or seen["n"] <= FIRST:
            found, read = scored(cells), seen["n"]
        else:
            first = top(cells, F.desc("best"), F.asc("segment"), F.asc("cell"), limit=FIRST)
            page = scored(F.broadcast(first)).orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("last")).first()
            needed = cells.filter(F.col("best") >= page["last"] - _ROUNDED) if page["n"] == limit else cells
            found, read = scored(needed), needed.count()
        return found if limit is None else top(found, F.desc("score"), F.asc("id"), limit=limit), {"cells": seen["n"], "scored": read}
