"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays.

A window is ``LENGTH`` bytes. The leftmost-deepest choice of winnowing gives each window an
anchor inside it: the position of the smallest hash of ``CORE`` bytes, which depends on the
window's bytes alone, so equal windows have equal anchors. Neighbouring windows with one anchor
make a hull. Four steps decide which windows start in another place too:

1. Counting quotient filters, one per scan task and merged by sorted remainders, give the hashes
   of cores that occur more than once. Everything else is settled: no window of it repeats.
2. Hulls are counted by their bytes, first inside each text, then with map-side aggregation, so
   copies collapse before any shuffle. All windows of a hull that occurs twice repeat.
3. A hull that occurs once, beside other hulls of its core, needs sorting. All distinct hulls are
   dealt to shards by core; a shard writes each hull as its left flank, one symbol for the bytes
   of its core and its right flank, and sorts all suffixes by linear grouping: groups of suffixes
   with one Lyndon prefix are processed in descending order, where previous-smaller pointers
   refine lower groups, and the order inside the groups is emitted in one ascending pass without
   recursive renaming. Neighbours in the suffix array that share a window's symbols repeat.
4. A core with more hulls than a shard holds is dealt to many shards by hull; windows that are
   alone in their shard are then counted by their bytes over the shards of that core.

Hashes choose anchors and deal work; that two strings are equal is decided on their bytes.

Matches never cross documents, and windows are judged on the input, not on what is left.

Defined results: null is empty; texts under ``LENGTH`` bytes lose nothing; of two equal texts
both lose what repeats; rows that repeat doc_id and text count as two places; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import broadcast_if_small, encoded, materialize, parts, prefix_hash, release, span_hash
from mailweave.llm.exact_dedup import repeated_fingerprints

#: Bytes of a window (fixed by the contract of the query) and of an anchor's core.
LENGTH, CORE = 200, 120
WIDTH = LENGTH - CORE + 1
#: Window starts of one numpy piece; a longer text is cut into pieces.
PIECE = 1 << 18
#: Hulls of a shard, and of one suffix sort: short texts sort faster, and cores don't share windows.
SHARD_HULLS, SORT_HULLS = 4000, 256
#: Hulls of a text that are held before they go out, and bytes of hulls.
HULLS_OUT, HULL_BYTES = 1 << 15, 1 << 23
#: Windows that are compared with their neighbours at once.
COMPARED = 1 << 13
#: Texts whose removed spans are broadcast at most; more are joined by a shuffle, as all else is.
BROADCAST_ROWS = 300_000
_PLACE = np.uint64((1 << 20) - 1)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    m, k = a, 1
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (w - k)], m[w - k :]) if k < w else m


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece of a text: core hash, first window, windows and core place of each hull."""
    for a in range(0, len(text) - LENGTH + 1, PIECE):
        data = np.frombuffer(text, np.uint8)[a : a + PIECE + LENGTH - 1]
        prefix = prefix_hash(data)
        at = np.arange(len(data) - CORE + 1)
        h = span_hash(prefix, at, at + CORE)
        best = sliding_min((h & ~_PLACE) | at[::-1].astype(np.uint64), WIDTH)
        first = np.ones(len(best), bool)
        np.not_equal(best[1:], best[:-1], out=first[1:])
        start = np.flatnonzero(first)
        core = len(h) - 1 - (best[start] & _PLACE).astype(np.int64)
        yield h[core], start + a, np.diff(start, append=len(best)), core + a


def _core_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts(batches):
        found = [piece[0] for text in encoded(part["text"]) for piece in anchors(text)]
        if found:
            yield pd.DataFrame({"fp": np.concatenate(found).view(np.int64)})


#: Where a core is in a text: first window, windows and bytes before the core of each of its hulls there.
_PLACED = np.dtype([("first", "<i4"), ("windows", "<i2"), ("left", "<i2")])


def _scan_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each core of a text, with all its places there: a text that repeats itself has few cores."""
    for part in parts(batches):
        cores, row, places = [], [], []
        for k, text in enumerate(encoded(part["text"])):
            found = list(anchors(text))
            if not found:
                continue
            core, start, windows, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(core, kind="stable")
            core = core[order]
            packed = np.empty(len(order), _PLACED)
            packed["first"], packed["windows"], packed["left"] = start[order], windows[order], (place - start)[order]
            cuts = np.flatnonzero(np.r_[True, core[1:] != core[:-1]])
            raw, ends = packed.tobytes(), _PLACED.itemsize * np.r_[cuts, len(order)]
            places += [raw[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            cores.append(core[cuts])
            row.append(np.full(len(cuts), k))
        if cores:
            at = np.concatenate(row)
            yield pd.DataFrame(
                {"doc_id": part["doc_id"].iloc[at].array, "text_hash": part["text_hash"].to_numpy()[at], "core": np.concatenate(cores).view(np.int64), "places": places}
            )


class _Hulls:
    """Columns of hulls, collected over texts until they go out."""

    def __init__(self, part: pd.DataFrame) -> None:
        self.part = part
        self.clear()

    def clear(self) -> None:
        self.bytes: list[bytes] = []
        self.columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        self.rows = self.size = 0

    def add(self, k: int, core: np.ndarray, placed: np.ndarray, n: np.ndarray, data: list[bytes]) -> None:
        for column, values in zip(self.columns, (np.full(len(core), k), core, placed["windows"], placed["left"], n, placed["first"]), strict=True):
            column.append(values)
        self.bytes += data
        self.rows += len(core)
        self.size += int(placed["windows"].sum()) + (LENGTH - 1) * len(core)

    def out(self) -> Iterator[pd.DataFrame]:
        if self.rows:
            row, core, windows, left, n, first = (np.concatenate(c) for c in self.columns)
            yield pd.DataFrame(
                {
                    "doc_id": self.part["doc_id"].iloc[row].array, "text_hash": self.part["text_hash"].to_numpy()[row], "core": core,
                    "windows": windows, "left": left, "bytes": self.bytes, "n": n, "first": first,
                }
            )
        self.clear()


def _cut_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct hulls of each text, how often it has them, and where first. Rows go out before they fill the memory."""
    for part in parts(batches):
        held = _Hulls(part)
        for k, (text, cores, places) in enumerate(zip(encoded(part["text"]), part["cores"], part["places"], strict=True)):
            placed = np.frombuffer(b"".join(places), _PLACED)
            many = np.fromiter(map(len, places), np.int64, len(places)) // _PLACED.itemsize
            core = np.repeat(np.asarray(cores, np.int64), many)
            alone = np.repeat(many == 1, many)  # only places of one core can have equal hulls
            for some in np.array_split(np.flatnonzero(alone), -(-int(alone.sum()) // HULLS_OUT) or 1):
                p = placed[some]
                ends = p["first"] + p["windows"] + (LENGTH - 1)
                held.add(k, core[some], p, np.ones(len(p), np.int64), [text[x:y] for x, y in zip(p["first"].tolist(), ends.tolist(), strict=True)])
                if held.size > HULL_BYTES:
                    yield from held.out()
            seen: dict = {}
            for at, (c, (first, windows, left)) in enumerate(zip(core[~alone].tolist(), placed[~alone].tolist(), strict=True)):
                key = (c, windows, left, text[first : first + windows + LENGTH - 1])
                if key in seen:
                    seen[key][1] += 1
                else:
                    if len(seen) >= HULLS_OUT:
                        _flush(held, k, core[~alone], placed[~alone], seen)
                        yield from held.out()
                        seen = {}
                    seen[key] = [at, 1]
            _flush(held, k, core[~alone], placed[~alone], seen)
            if held.size > HULL_BYTES:
                yield from held.out()
        yield from held.out()


def _flush(held: _Hulls, k: int, core: np.ndarray, placed: np.ndarray, seen: dict) -> None:
    at = np.array([x for x, _ in seen.values()], np.int64)
    held.add(k, core[at], placed[at], np.array([n for _, n in seen.values()], np.int64), [key[3] for key in seen])


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array by linear grouping. The last symbol must be the only smallest one.

    First phase: ``groups`` chains groups of suffixes with one Lyndon prefix from the highest to
    the lowest. Processing a group gives each member its previous smaller suffix; suffixes that
    are pointed to get the processed prefix appended, so they move to a new group right above
    their old one, more pointers higher. Second phase: the suffixes whose Lyndon prefix ends
    where a sorted suffix starts come next in their groups.
    """
    n = len(text)
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        buckets.setdefault(c, []).append(i)
    members: list[list[int]] = []
    group = [0] * n
    for c in sorted(buckets):
        for i in buckets[c]:
            group[i] = len(members)
        members.append(buckets[c])
    lower = list(range(-1, len(members) - 1))
    higher = list(range(1, len(members) + 1))
    higher[-1] = -1
    before = list(range(-1, n - 1))
    done = bytearray(n + 1)  # place -1, the last byte, is never done
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            done[i] = 1
        if len(own) == 1:
            i = own[0]
            p = i - 1
            while done[p]:
                p = before[p]
            before[i] = p
            rounds = [[p]] if p >= 0 else []
        else:
            times: dict[int, int] = {}
            for i in own:
                p = i - 1
                while done[p]:
                    p = before[p]
                before[i] = p
                times[p] = times.get(p, 0) + 1
            times.pop(-1, None)
            most = max(times.values(), default=0)
            if most <= 1:
                rounds = [list(times)] if times else []
            else:
                by: dict[int, list[int]] = {}
                for p, k in times.items():
                    by.setdefault(k, []).append(p)
                rounds = [by[k] for k in sorted(by, reverse=True)]
        for places in rounds:
            moved: dict[int, list[int]] = {}
            for p in places:
                h = group[p]
                if h in moved:
                    moved[h].append(p)
                else:
                    moved[h] = [p]
            for h, some in moved.items():
                new = len(members)
                members.append(some)
                for p in some:
                    group[p] = new
                up = higher[h]
                higher.append(up)
                lower.append(h)
                lower[up] = new
                higher[h] = new
        g = lower[g]
    # first slot of each group, from the lowest
    slot = [0] * len(members)
    g, at = 0, 0
    while lower[g] >= 0:
        g = lower[g]
    while g >= 0:
        slot[g] = at
        at += len(members[g])
        g = higher[g]
    order = [0] * n
    order[0] = n - 1
    for k in range(n):
        p = order[k]
        stop = before[p]
        j = p - 1
        while j > stop:
            h = group[j]
            order[slot[h]] = j
            slot[h] += 1
            j = before[j]
    return order


def repeated_windows(hulls: list[bytes], cores: np.ndarray, lefts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_sorted_windows` of runs of about ``SORT_HULLS`` hulls; all hulls of a core are in one run."""
    order = np.argsort(cores, kind="stable")
    changes = np.flatnonzero(np.diff(cores[order])) + 1
    cuts, last = [0], 0
    for c in [*changes.tolist(), len(order)]:
        if c - last >= SORT_HULLS or c == len(order):
            cuts.append(c)
            last = c
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = order[a:b]
        hull, place, count = _sorted_windows([hulls[i] for i in some], lefts[some], windows[some])
        found.append((some[hull], place, count))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sorted_windows(hulls: list[bytes], lefts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of some distinct hulls are equal to one of another hull.

    ``lefts`` are the bytes before the core of each hull. Returns the hull of each window, its
    place in the hull, and the size of its class of equal windows with the sign changed for all
    but the first of a class.
    """
    names: dict[bytes, int] = {}
    symbols = np.array([names.setdefault(h[x : x + CORE], 258 + len(names)) for h, x in zip(hulls, lefts.tolist(), strict=True)])
    strings = [h[:x] + h[x + CORE :] for h, x in zip(hulls, lefts.tolist(), strict=True)]
    size = np.array([len(s) + 2 for s in strings])
    begin = np.cumsum(size) - size
    total = int(size.sum()) + 1
    text = np.empty(total, np.int64)
    hull_of = np.repeat(np.arange(len(strings)), size)
    within = np.arange(total - 1) - begin[hull_of]
    flank = np.frombuffer(b"".join(strings), np.uint8)
    is_core = within == lefts[hull_of]
    is_end = within == size[hull_of] - 1
    text[:-1][~is_core & ~is_end] = flank.astype(np.int64) + 2
    text[:-1][is_core] = symbols
    text[:-1][is_end] = 1
    text[-1] = 0
    order = np.array(suffix_array(text.tolist()), np.int64)
    starts = np.zeros(total, bool)
    starts[:-1] = within < windows[hull_of]
    order = order[starts[order]]
    same = np.zeros(len(order), bool)
    span = np.arange(LENGTH - CORE + 1)
    short = text.astype(np.int32)
    for a in range(0, len(order), COMPARED):
        b = min(len(order), a + COMPARED)
        cells = short[order[max(0, a - 1) : b, None] + span]
        equal = (cells[1:] == cells[:-1]).all(1)
        same[a + (a == 0) : b] = equal
    klass = np.cumsum(~same) - 1
    count = np.bincount(klass, minlength=1)[klass] if len(klass) else np.zeros(0, np.int64)
    return hull_of[order], within[order], np.where(same, -count, count)


def _runs(hull: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places of each hull: hull, first and last place."""
    order = np.lexsort((place, hull))
    hull, place = hull[order], place[order]
    new = np.ones(len(hull), bool)
    new[1:] = (hull[1:] != hull[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    return hull[at], place[at], place[np.append(at[1:], len(hull)) - 1] if len(at) else place[at]


def _sort_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans of repeated windows (window null), and windows of cores that have other shards."""
    core = pdf["core"].to_numpy()
    # a core without a hull that occurs once, or with one hull in all, has nothing to find
    order, at, many = np.unique(core, return_inverse=True, return_counts=True)
    asks = np.zeros(len(order), bool)
    asks[at[pdf["n"].to_numpy() == 1]] = True
    pdf = pdf[(asks & (many > 1))[at] | (pdf["blocks"].to_numpy() > 1)]
    if pdf.empty:
        return pd.DataFrame({c: pdf[c] for c in ("doc_id", "text_hash", "first")} | {c: [] for c in ("end", "window", "asks")})
    columns = {c: pdf[c].to_numpy() for c in ("core", "left", "windows", "first", "n", "blocks")}
    hulls = pdf["bytes"].tolist()
    hull, place, count = repeated_windows(hulls, columns["core"], columns["left"].astype(np.int64), columns["windows"].astype(np.int64))
    alone = columns["n"] == 1
    hit = (np.abs(count) > 1) & alone[hull]
    h, a, b = _runs(hull[hit], place[hit])
    out = [(h, columns["first"][h] + a, columns["first"][h] + b + LENGTH, np.full(len(h), None, object), np.zeros(len(h), bool))]
    cross = (columns["blocks"][hull] > 1) & (count > 0)
    if cross.any():
        h, p = hull[cross], place[cross]
        window = np.empty(len(h), object)
        window[:] = [hulls[i][j : j + LENGTH] for i, j in zip(h.tolist(), p.tolist(), strict=True)]
        first = columns["first"][h] + p
        out.append((h, first, first + LENGTH, window, alone[h] & (count[cross] == 1)))
    h, s, e, window, asks = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame(
        {
            "doc_id": pdf["doc_id"].iloc[h].array,
            "text_hash": pdf["text_hash"].to_numpy()[h],
            "first": s.astype(np.int32),
            "end": e.astype(np.int32),
            "window": window,
            "asks": asks,
        }
    )


def repeated_bounds(docs: DataFrame, shard_hulls: int = SHARD_HULLS) -> DataFrame:
    """doc_id, text_hash and ``bounds`` (first, end, first, end, …) of what repeats in each text that has repeated windows."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).filter(F.octet_length("text") >= LENGTH)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = keyed.mapInPandas(_scan_anchors, f"doc_id {kind}, text_hash long, core long, places binary")
    cores = repeated_fingerprints(keyed.select("text"), of=_core_hashes).select(F.col("fp").alias("core"))
    # places of cores that occur more than once, by text; eight bytes a place, and a text's places are bounded by its length
    held = materialize(
        found.join(materialize(cores), "core", "left_semi").groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("core", "places")).alias("cores"))
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "cores")
    )
    placed = keyed.join(held, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("doc_id", "text_hash", "text", F.col("cores.core").alias("cores"), F.col("cores.places").alias("places"))
    placed = placed.mapInPandas(_cut_hulls, f"doc_id {kind}, text_hash long, core long, windows short, left short, bytes binary, n long, first int")
    # Columns of first() are used where one place is all that there is.
    row = ["doc_id", "text_hash", "first"]
    hulls = materialize(
        placed.groupBy("core", "windows", "left", "bytes").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in row])
    )
    shards = max(1, -(-hulls.count() // shard_hulls))
    wide = materialize(hulls.groupBy("core").agg(F.count("*").alias("hulls")).filter(F.col("hulls") > shard_hulls))
    blocks = wide.select("core", F.ceil(F.col("hulls") / shard_hulls).cast("int").alias("blocks"))
    dealt = hulls.join(broadcast_if_small(blocks, wide.count(), BROADCAST_ROWS), "core", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("bytes"), F.col("blocks").cast("long"))
    sorted_ = materialize(
        dealt.withColumn("shard", F.pmod(F.xxhash64("core", block), F.lit(shards)))
        .repartition(min(shards, 4000), "shard")
        .groupBy("shard")
        .applyInPandas(_sort_shard, f"doc_id {kind}, text_hash long, first int, end int, window binary, asks boolean")
    )
    # windows alone in their shard whose core has more shards: counted over the shards
    cross = sorted_.filter("window is not null")
    twice = cross.groupBy("window").agg(F.count("*").alias("k")).filter("k > 1").select("window")
    across = cross.filter("asks").join(twice, "window", "left_semi")
    # all places of a text repeat whole but those of hulls that occur once (an end of -1), of which only the spans found do
    marks = (
        hulls.filter("n = 1").select("doc_id", "text_hash", "first", F.lit(-1).alias("end"))
        .unionByName(sorted_.filter("window is null").select("doc_id", "text_hash", "first", "end"))
        .unionByName(across.select("doc_id", "text_hash", "first", "end"))
    )
    marks = marks.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "end")).alias("marks"))
    both = held.join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    marked = both.select(F.col("__id").alias("doc_id"), F.col("__hash").alias("text_hash"), F.col("cores.places").alias("places"), F.col("marks.first").alias("firsts"), F.col("marks.end").alias("ends"))
    return marked.mapInPandas(_bound_rows, f"doc_id {kind}, text_hash long, bounds array<int>").filter(F.size("bounds") > 0)


def _union(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bounds of the union of some spans: first, end, first, end, …"""
    if not len(first):
        return np.zeros(0, np.int32)
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, first[1:] > reach[:-1]])
    return np.stack([first[new], reach[np.r_[new[1:], len(first)] - 1]], 1).reshape(-1).astype(np.int32)


def _bound_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        bounds = []
        for places, firsts, ends in zip(pdf["places"], pdf["firsts"], pdf["ends"], strict=True):
            at = np.frombuffer(b"".join(places), _PLACED)
            first, end = at["first"].astype(np.int64), at["first"].astype(np.int64) + at["windows"] - 1 + LENGTH
            if firsts is not None:
                f, e = np.asarray(firsts, np.int64), np.asarray(ends, np.int64)
                whole = ~np.isin(first, f[e < 0])
                first, end = np.r_[first[whole], f[e >= 0]], np.r_[end[whole], e[e >= 0]]
            bounds.append(_union(first, end))
        yield pdf[["doc_id", "text_hash"]].assign(bounds=bounds)
        release()


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts(batches):
        size, removed, spans, kept = [], [], [], []
        for text, bounds in zip(encoded(pdf["text"]), pdf["bounds"], strict=True):
            b = [] if bounds is None else [int(x) for x in bounds]
            edges = [0, *b, len(text)]
            rest = b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)) if b else text
            size.append(len(text))
            removed.append(len(text) - len(rest))
            spans.append(len(b) // 2)
            kept.append(rest)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "n_bytes": size, "n_removed": removed, "n_spans": spans, "kept": kept})


def remove_repeats(docs: DataFrame, shard_hulls: int = SHARD_HULLS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes ``kept`` of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bounds = materialize(repeated_bounds(docs, shard_hulls)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "bounds")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return (
        keyed.join(
            broadcast_if_small(bounds, bounds.count(), BROADCAST_ROWS),
            F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")),
            "left",
        )
        .select("doc_id", "text", "bounds")
        .mapInPandas(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    )
