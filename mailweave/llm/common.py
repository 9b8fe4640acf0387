"""Helpers that the training-data operators share.

Text is handled as UTF-8 bytes in numpy blocks inside tasks; words are maximal runs of
bytes other than the six ASCII white-space characters. Nothing here gathers rows on the driver.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.session import cut, measured

#: The six characters that separate words (fixed by the contract of the operators).
WHITE = " \t\n\x0b\x0c\r"
#: Java regular expression of one word.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Text bytes that one numpy block holds; longer texts make a block of their own.
BLOCK_BYTES = 1 << 18
#: Characters of the rows that a task handles at once; a longer text is handled alone.
PART_CHARS = 1 << 21

_ODD = 0x5851F42D4C957F2D
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def materialize(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Cuts lineage, keeps later scans to the columns that they need, and survives lost executors.
    The folder goes when the driver ends.
    """
    return cut(df)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`materialize`, and the number of rows, counted while they were written."""
    out, seen = measured(df, rows=F.count(F.lit(1)))
    return out, seen["rows"]


def broadcast_if_small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast a table whose row count was measured to be at most ``bound``; else let it shuffle."""
    return F.broadcast(df) if rows <= bound else df


def keep_rows(docs: DataFrame, chosen: DataFrame, bound: int) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` names, with all of their columns.

    chosen: __id, __hash (of the text) and __rows, how many rows have both; 1 lets each of them
    stay, a higher number one of them. Only rows that do repeat are shuffled.
    """
    chosen, seen = measured(chosen, rows=F.count(F.lit(1)), repeated=F.count_if(F.col("__rows") > 1))

    def named(some: DataFrame, rows: int) -> DataFrame:
        match = docs["doc_id"].eqNullSafe(some["__id"]) & (F.xxhash64(docs["text"]) == some["__hash"])
        return docs.join(broadcast_if_small(some, rows, bound), match, "left_semi")

    once = named(chosen.filter("__rows = 1"), seen["rows"])
    if not seen["repeated"]:
        return once
    many = named(chosen.filter("__rows > 1"), seen["repeated"])
    one = many.groupBy("doc_id", F.xxhash64("text")).agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return once.unionByName(one)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- memory of Python workers ---------------------------------------------------------------

_HELD: dict = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give what was freed back to the system: Spark keeps Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def held(key: object, build: Callable[[], object]) -> object:
    """What a worker keeps between the tasks of one operator; the next operator's takes its place."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = build()
    return _HELD[key]


def parts(batches: Iterator[pd.DataFrame], column: str = "text", size: int = PART_CHARS, keeps: object = None) -> Iterator[pd.DataFrame]:
    """Runs of rows with at most about ``size`` characters (or bytes) in ``column``.

    Drops what another operator held in this worker, unless it is ``keeps``, and releases freed
    memory after each batch.
    """
    if _HELD and keeps not in _HELD:
        _HELD.clear()
    for pdf in batches:
        ends = np.cumsum([len(x) if isinstance(x, (str, bytes)) else 0 for x in pdf[column]])
        first = 0
        while first < len(pdf):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield pdf.iloc[first:last]
            first = last
        del pdf
        release()


# --- numpy blocks -------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_ODD, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_ODD_INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` gets the hash of any span."""
    up, _ = POWERS.of(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the hashed data."""
    _, down = POWERS.of(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def blocks(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Successive runs of texts as (first, last, bytes, offsets); a run ends at ``size`` bytes."""
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last]) <= size):
            total += len(texts[last])
            last += 1
        data = np.frombuffer(b"".join(texts[first:last]), np.uint8)
        yield first, last, data, np.cumsum([0, *map(len, texts[first:last])])
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the number of words before each text.

    Words never cross texts.
    """
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_IS_WHITE[data], out=inside[1:-1])
    begin = inside[1:] & ~inside[:-1]
    end = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]  # a word on each side of a boundary between texts
    begin[both] = True
    end[both] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty. Lone surrogates, which UTF-8 lacks, become question marks."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
