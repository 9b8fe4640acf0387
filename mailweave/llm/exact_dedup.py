"""Exact deduplication through counting quotient filters.

A fingerprint of 64 bits is split into a quotient (its high bits) and a remainder. Each scan
task builds one filter per shard of the quotient space: ``occupied`` has a bit per quotient
that has a run, ``run_end`` has a bit per slot that ends a run, the slots hold the sorted
remainders, and counters hold how often each was added. Two filters merge losslessly: their
slots are decoded to sorted fingerprints and counts of equal ones are added. Only the filters
are shuffled, never the texts of unique documents. Fingerprints that count more than one are
then verified on the bytes: Spark groups such texts by the normalised text itself.

Defined results: a null text counts as empty; empty texts equal one another; rows with the
same doc_id are the same document, each row is returned; a null doc_id sorts first among ties;
an empty table gives no rows; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import broadcast_if_small, counted, keep_rows, materialize, shuffle_partitions

#: Fingerprints that a task holds before it emits its filters.
FLUSH_ROWS = 1 << 20
#: Fingerprints that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_HEAD = struct.Struct("<BBQQ")
_LOWEST = -(2**63)


def build_filter(fingerprints: np.ndarray, counts: np.ndarray, low_bits: int) -> bytes:
    """Encode sorted distinct fingerprints (the bits below a shard's prefix) and their counts.

    ``low_bits`` is the width of a fingerprint here. The quotient takes about log2(n) of them.
    """
    n = len(fingerprints)
    quotient_bits = min(low_bits, max(1, int(np.ceil(np.log2(max(n, 2))))))
    remainder_bits = low_bits - quotient_bits
    quotient = fingerprints >> np.uint64(remainder_bits) if remainder_bits < 64 else np.zeros(n, np.uint64)
    remainder = fingerprints & np.uint64((1 << remainder_bits) - 1)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient.astype(np.int64)] = True
    run_end = np.ones(n, bool)
    run_end[:-1] = quotient[1:] != quotient[:-1]
    many = np.flatnonzero(counts > 1)
    width = (remainder_bits + 7) // 8
    slots = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width] if n else np.zeros((0, width), np.uint8)
    return b"".join(
        (
            _HEAD.pack(low_bits, quotient_bits, n, len(many)),
            np.packbits(occupied).tobytes(),
            np.packbits(run_end).tobytes(),
            np.ascontiguousarray(slots).tobytes(),
            many.astype("<u4").tobytes(),
            counts[many].astype("<u8").tobytes(),
        )
    )


def read_filter(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints and counts of a filter."""
    low_bits, quotient_bits, n, many = _HEAD.unpack_from(blob)
    at = _HEAD.size
    remainder_bits = low_bits - quotient_bits
    width = (remainder_bits + 7) // 8

    def take(size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, np.uint8, size, at)
        at += size
        return out

    occupied = np.unpackbits(take(((1 << quotient_bits) + 7) // 8), count=1 << quotient_bits).astype(bool)
    run_end = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = take(n * width).reshape(n, width)
    remainder = slots.reshape(-1).view("<u8").astype(np.uint64)
    run = np.zeros(n, np.int64)
    run[1:] = np.cumsum(run_end)[:-1]
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    counts = np.ones(n, np.int64)
    where = take(4 * many).view("<u4")
    counts[where] = take(8 * many).view("<u8").astype(np.int64)
    return (quotient << np.uint64(remainder_bits)) | remainder, counts


def merge_filters(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of all filters with the sums of their counts; nothing is lost."""
    parts = [read_filter(b) for b in blobs]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = np.concatenate([p[0] for p in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], np.concatenate([p[1] for p in parts])[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(first)
    return values[at], np.add.reduceat(counts, at) if len(at) else counts


def _filters(shard_bits: int, of: Callable | None):
    low_bits = 64 - shard_bits

    def emit(values: np.ndarray) -> Iterator[pd.DataFrame]:
        values, counts = np.unique(values, return_counts=True)
        shard = (values >> np.uint64(low_bits)).astype(np.int64) if shard_bits else np.zeros(len(values), np.int64)
        at = np.flatnonzero(np.diff(shard, prepend=-1))
        ends = [*at[1:], len(values)]
        mask = np.uint64((1 << low_bits) - 1)
        yield pd.DataFrame(
            {
                "shard": shard[at].astype(np.int32),
                "filter": [build_filter(values[a:b] & mask, counts[a:b], low_bits) for a, b in zip(at, ends, strict=True)],
            }
        )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches if of is None else of(batches):
            held.append(batch["fp"].to_numpy(np.int64).view(np.uint64))
            size += len(held[-1])
            if size >= FLUSH_ROWS:
                yield from emit(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from emit(np.concatenate(held))

    return scan


def repeated_fingerprints(fingerprints: DataFrame, shards: int | None = None, of: Callable | None = None) -> DataFrame:
    """Fingerprints (column ``fp``, long, not null) that occur more than once, with their counts.

    With ``of``, the tasks make the fingerprints: it turns batches of the rows into batches with ``fp``.
    """
    shards = shards or shuffle_partitions(fingerprints.sparkSession)
    shard_bits = max(0, int(np.ceil(np.log2(shards))))
    low_bits = 64 - shard_bits
    rows = fingerprints.select("fp") if of is None else fingerprints
    filters = rows.mapInPandas(_filters(shard_bits, of), "shard int, filter binary")

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = merge_filters(pdf["filter"].tolist())
        more = counts > 1
        high = np.uint64(int(key[0]) << low_bits) if shard_bits else np.uint64(0)
        return pd.DataFrame({"fp": (values[more] | high).view(np.int64), "n": counts[more]})

    return filters.groupBy("shard").applyInPandas(merge, "fp long, n long")


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _judged(docs: DataFrame) -> DataFrame:
    """Every row with its group: doc_id, text_hash, n_points, sha, keep_id, group_size (nulls of doc_id as the smallest long)."""
    spread = docs.select(
        F.coalesce("doc_id", F.lit(_LOWEST)).alias("doc_id"),
        normalised(F.col("text")).alias("norm"),
        F.coalesce(F.length("text"), F.lit(0)).alias("n_points"),
        F.xxhash64("text").alias("text_hash"),
    )
    keyed = materialize(
        spread.select("doc_id", "text_hash", "n_points", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    )
    repeated, n_repeated = counted(repeated_fingerprints(keyed))
    # Byte verification: only texts whose fingerprint repeats are grouped, by all of their bytes.
    # The partial aggregation collapses a hot text in each task before the shuffle.
    suspects = spread.withColumn("fp", F.xxhash64("norm")).join(
        broadcast_if_small(repeated.select("fp"), n_repeated, BROADCAST_ROWS), "fp", "left_semi"
    )
    verified = (
        suspects.groupBy("fp", "norm", "n_points")
        .agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
        .groupBy("fp", "norm")
        .agg(F.max_by("low", "n_points").alias("keep_id"), F.sum("rows").alias("group_size"))
        .select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    groups, n_groups = counted(verified)
    out = keyed.join(broadcast_if_small(groups, n_groups, BROADCAST_ROWS // 4), ["fp", "sha"], "left")
    return out.select(
        "doc_id", "text_hash", "n_points", "sha", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``.

    Of the texts that are equal without white space, the row with the most code points, then
    the smallest doc_id is kept.
    """
    known = lambda c: F.when(F.col(c) != _LOWEST, F.col(c)).alias(c)
    return _judged(docs).select(
        known("doc_id"), known("keep_id"), "group_size", (F.col("keep_id") == F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_one_of_equals(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, the one that :func:`exact_groups` keeps, with all of its columns.

    Where rows share its doc_id (or have none), the one with the most code points, then the
    largest hash of the text stays, and one of rows that are equal in both.
    """
    rows = _judged(docs.select("doc_id", "text")).filter("keep_id = doc_id")
    texts = rows.groupBy("sha", "doc_id", "text_hash").agg(F.max("n_points").alias("n"), F.count("*").alias("rows"))
    best = texts.groupBy("sha").agg(F.max_by(F.struct("doc_id", "text_hash", "rows"), F.struct("n", "text_hash")).alias("x"))
    chosen = best.select(F.when(F.col("x.doc_id") != _LOWEST, F.col("x.doc_id")).alias("__id"), F.col("x.text_hash").alias("__hash"), F.col("x.rows").alias("__rows"))
    return keep_rows(docs, chosen, BROADCAST_ROWS // 2)
