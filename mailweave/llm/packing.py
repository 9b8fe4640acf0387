"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

A document is its token ids and a closing id 0; documents longer than a sequence are cut. The
pieces shorter than a sequence are dealt by hash into shards of bounded size. On each shard
several islands evolve populations of packings that start from best fit by decreasing length: crossover
injects whole well-filled bins of one parent into the other, bins of the other that hold a document twice are
dissolved with the emptiest ones, and the displaced documents refill bins: each bin takes what fills
it best among many documents, found by their possible sums, and best fit places the rest. An island
whose best packing needs no more than the lower bound is done. Between epochs the best packing of each island
migrates to the next island of its shard (a join); at the end the best island gives the
shard's packing. The documents of badly filled bins of all shards meet again in a next level of
shards, until they fit one shard or a level leaves as many open as it was given, so cutting the
work into shards costs next to nothing.

Defined results: null and empty texts are one piece that holds id 0; rows that repeat are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailweave.llm.common import blocks, encoded, held, lower_ascii, materialize, parts, prefix_hash, span_hash, word_spans

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces of a shard, islands of a shard, epochs between which elites migrate.
SHARD_ROWS, ISLANDS, EPOCHS = 4096, 2, 2
#: Packings of an island, generations of an epoch at most, and how many may pass without a better packing.
POPULATION, GENERATIONS, PATIENCE = 8, 60, 20
#: Documents that a bin chooses among; a bin filled less by its choice is left to best fit.
CHOICES, FULL = 64, 0.995
#: Bins filled less than this are packed anew in the next level.
WELL_FILLED = 0.985
#: A Python worker remembers the ids of half of 2^CACHE_BITS units; bytes of a block.
CACHE_BITS, TOKEN_BLOCK = 20, 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class IdTable:
    """Token ids of units of text by the units' 64-bit hashes: open addressing in numpy arrays."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)  # 0: free
        self.at = np.zeros(1 << bits, np.int64)
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or the free one where it belongs."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            todo = todo[(held != keys[todo]) & (held != 0)]
        return slot

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """New distinct keys and the ids of each, as bytes of unsigned 32-bit numbers."""
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = len(self.first) + np.arange(len(keys))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), np.uint32)])
        todo = np.arange(len(keys))
        while len(todo):
            slot = self.slots(keys[todo])
            slot, won = np.unique(slot, return_index=True)
            self.keys[slot], self.at[slot] = keys[todo[won]], place[todo[won]]
            todo = np.delete(todo, won)


def _kinds() -> np.ndarray:
    """Bytes of Latin letters (1; of two bytes up to U+017F too), of signs but the apostrophe (2), and others (0)."""
    out = np.zeros(256, np.uint8)
    out[33:127] = 2
    out[[39, *range(48, 58)]] = 0
    out[65:91] = out[97:123] = out[0x80:0xC0] = out[0xC3:0xC6] = 1
    return out


_KIND = _kinds()


class WordTokenizer:
    """Ids of whole texts from remembered ids of their units.

    The tokenizer drops white space, lowers letters and then splits runs of letters from runs of
    signs, so the ids of a text are those of its words in order, and the ids of a Latin word with
    closing signs are those of the lowered letters and of the signs: such a word is two units,
    any other word is one. Units are found in numpy and looked up by hash; unknown runs are
    encoded together, where a run ends at the token that closes a word. Other words are encoded alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.table = IdTable(CACHE_BITS)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _of_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters or of signs, as bytes of unsigned 32-bit numbers."""
        out: list[bytes] = []
        for at in range(0, len(runs), 2000):
            some = runs[at : at + 2000]
            ids = self.encode(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, ends = ids.tobytes(), [0, *(4 * cuts).tolist()]
                out += [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            else:  # a tokenizer without one closing token for each run
                out += [self.encode(run).tobytes() for run in some]
        return out

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text and a closing 0."""
        out: list[np.ndarray] = []
        for _, _, raw, offsets in blocks(texts, TOKEN_BLOCK):
            data = lower_ascii(raw)
            start, end, upto = word_spans(data, offsets)
            kind = _KIND[data]
            # the three two-byte characters below U+0180 that aren't letters or aren't lowered to one
            pair = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0))
            kind[pair] = kind[pair + 1] = 0
            letters, others = (np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)]) for k in (1, 0))
            run = start + letters[end] - letters[start]
            simple = (others[end] == others[start]) & (run > start) & (letters[run] - letters[start] == run - start)
            two = simple & (run < end)
            # units in order: a word, or its letters and its signs
            place = np.arange(len(start)) + np.cumsum(two) - two
            n = len(start) + int(two.sum())
            u_start, u_end, alone = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
            u_start[place], u_end[place], alone[place] = start, np.where(two, run, end), ~simple
            u_start[place[two] + 1], u_end[place[two] + 1] = run[two], end[two]
            keys = np.maximum(span_hash(prefix_hash(data), u_start, u_end), np.uint64(1))
            slot = self.table.slots(keys)
            missing = np.flatnonzero(self.table.keys[slot] != keys)
            if len(missing):
                new, where = np.unique(keys[missing], return_index=True)
                where = missing[where]
                if 2 * (len(self.table.first) + len(new)) > 1 << self.table.bits:
                    new, where = np.unique(keys, return_index=True)
                    self.table = IdTable(max(CACHE_BITS, int(len(new)).bit_length() + 2))
                whole = data.tobytes()
                words = [whole[s:e].decode("utf-8") for s, e in zip(u_start[where].tolist(), u_end[where].tolist(), strict=True)]
                single = alone[where]
                ids = np.empty(len(words), object)
                ids[~single] = _objects(self._of_runs([w.lower() for w, one in zip(words, single.tolist(), strict=True) if not one]))
                ids[single] = _objects([self.encode(w).tobytes() for w, one in zip(words, single.tolist(), strict=True) if one])
                self.table.add(new, ids.tolist())
                slot = self.table.slots(keys)
            at = self.table.at[slot]
            size = self.table.count[at]
            before = np.concatenate([[0], np.cumsum(size)])
            flat = self.table.ids[np.repeat(self.table.first[at] - before[:-1], size) + np.arange(before[-1])]
            cut = before[np.concatenate([place, [n]])[upto]]
            closed = np.insert(flat, cut[1:], 0)
            cut = cut + np.arange(len(cut))
            out += [closed[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out


def _objects(items: list) -> np.ndarray:
    out = np.empty(len(items), object)
    out[:] = items
    return out


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = held(tokenizer, lambda: WordTokenizer(tokenizer))
        for part in parts(batches, keeps=tokenizer):
            ids = coder.batch(encoded(part["text"]))
            total = np.array([len(x) for x in ids], np.int64)
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(len(part)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].iloc[row].array,
                    "piece": number.astype(np.int32),
                    "start": start,
                    "length": np.minimum(total[row] - start, capacity),
                    "ids_crc32": [zlib.crc32(ids[r][s : s + capacity].astype("<u4")) for r, s in zip(row, start, strict=True)],
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        scan, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(length: np.ndarray, order: np.ndarray, assign: np.ndarray, fill: list[int], capacity: int) -> None:
    """Place documents in the given order, each into the fullest bin that has room.

    ``assign`` and ``fill`` (tokens of each bin) are changed in place.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(fill):
        if f < capacity:
            room[capacity - f].append(b)
            mask |= 1 << (capacity - f)
    for i, size in zip(order.tolist(), length[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                mask ^= 1 << space
            fill[b] += size
        else:
            space, b = capacity, len(fill)
            fill.append(size)
        assign[i] = b
        left = space - size
        if left:
            room[left].append(b)
            mask |= 1 << left


def fitness(assign: np.ndarray, length: np.ndarray) -> tuple[int, float]:
    """Bins, then how unevenly they are filled: both smaller is better, so full bins beside an empty one win."""
    fill = np.bincount(assign, length)
    return len(fill), -float((fill**2).sum())


def lower_bound(length: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by all tokens, and by documents that can't share a bin with those above a size."""
    count = np.bincount(length, minlength=capacity + 1)[: capacity + 1]
    total = np.arange(capacity + 1) * count
    upto, tokens = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(total)]
    k = np.arange(capacity // 2 + 1)  # smallest size that counts
    large = upto[-1] - upto[capacity - k + 1]  # alone in a bin, as what counts doesn't fit beside them
    half = upto[capacity - k + 1] - upto[capacity // 2 + 1]  # a bin each, with room beside them
    room = half * capacity - (tokens[capacity - k + 1] - tokens[capacity // 2 + 1])
    small = tokens[capacity // 2 + 1] - tokens[k]
    return int((large + half + np.maximum(0, -(-(small - room) // capacity))).max())


def fullest(sizes: list[int], room: int) -> list[int]:
    """Places in ascending ``sizes`` whose sizes add up to as much of ``room`` as they can; large ones go first."""
    mask = (1 << (room + 1)) - 1
    sums = [1]  # bit k of the n-th: the first n sizes can add up to k
    for size in sizes:
        last = sums[-1]
        sums.append((last | last << size) & mask)
    left, out = sums[-1].bit_length() - 1, []
    for k in range(len(sizes) - 1, -1, -1):
        if left >= sizes[k] and sums[k] >> (left - sizes[k]) & 1:
            out.append(k)
            left -= sizes[k]
    return out


def refill(length: np.ndarray, items: np.ndarray, assign: np.ndarray, fill: list[int], capacity: int) -> None:
    """Place documents into new bins, the largest first with those that fill its bin best, and the rest by best fit.

    ``assign`` and ``fill`` are changed in place. A bin chooses among ``CHOICES`` documents: the
    largest that fit, and others of all sizes below.
    """
    order = items[np.argsort(length[items], kind="stable")].tolist()
    sizes = length[order].tolist()
    rest: list[int] = []
    while order:
        i, size = order.pop(), sizes.pop()
        room = capacity - size
        fit = bisect_right(sizes, room)
        near = max(0, fit - CHOICES // 2)
        step = max(1, -(-near // (CHOICES // 2)))
        among = [*range(0, near, step), *range(near, fit)]
        taken = sorted((among[k] for k in fullest([sizes[x] for x in among], room)), reverse=True)
        held = size + sum(sizes[k] for k in taken)
        if held < FULL * capacity:
            rest.append(i)
            continue
        for x in [i, *(order[k] for k in taken)]:
            assign[x] = len(fill)
        for k in taken:
            del order[k], sizes[k]
        fill.append(held)
    best_fit(length, np.array(rest, np.int64), assign, fill, capacity)


def crossover(a: np.ndarray, b: np.ndarray, length: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled bins of ``b`` into ``a``, dissolve what they double, and refill with the displaced documents."""
    fill_a, fill_b = np.bincount(a, length), np.bincount(b, length)
    good = fill_b >= np.quantile(fill_b, 0.5)
    take = good & (rng.random(len(fill_b)) < rng.uniform(0.1, 0.6))
    injected = take[b]
    gone = np.zeros(len(fill_a), bool)
    gone[a[injected]] = True
    # mutation: the emptiest bins are dissolved too, and a few others, so that there is something to choose from
    gone |= (fill_a <= np.quantile(fill_a, rng.uniform(0.02, 0.2))) | (rng.random(len(fill_a)) < 0.03)
    kept = ~injected & ~gone[a]
    child = np.full(len(a), -1, np.int64)
    child[injected] = (np.cumsum(take) - 1)[b[injected]]
    child[kept] = (np.cumsum(~gone) - 1)[a[kept]] + int(take.sum())
    # bins of a that only held injected documents were dissolved, so ids are dense
    placed = injected | kept
    fill = np.bincount(child[placed], length[placed], minlength=int(take.sum() + (~gone).sum())).astype(int).tolist()
    refill(length, np.flatnonzero(~placed), child, fill, capacity)
    return np.unique(child, return_inverse=True)[1]


def by_decreasing_length(length: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit, longest first: what the search starts from."""
    assign = np.full(len(length), -1, np.int64)
    best_fit(length, np.argsort(-length, kind="stable"), assign, [], capacity)
    return assign


def evolve(length: np.ndarray, elites: list[np.ndarray], capacity: int, seed: list[int]) -> np.ndarray:
    """One epoch of an island, from the elites that it holds or received; at first from best fit by decreasing length.

    The other packings of the population are best fit in orders that are near to decreasing, and
    refills. It ends at the lower bound, and sooner where generations bring nothing.
    """
    rng = np.random.default_rng(seed)
    least = lower_bound(length, capacity)
    people = [e for e in elites if e is not None] or [by_decreasing_length(length, capacity)]
    if min(fitness(p, length)[0] for p in people) <= least:
        return min(people, key=lambda p: fitness(p, length))
    while len(people) < POPULATION:
        assign = np.full(len(length), -1, np.int64)
        if len(people) % 2:
            refill(length, rng.permutation(len(length)), assign, [], capacity)
        else:
            best_fit(length, np.argsort(-length * rng.uniform(0.8, 1.2, len(length))), assign, [], capacity)
        people.append(assign)
    scored = sorted(((fitness(p, length), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    last = 0
    for g in range(GENERATIONS):
        if scored[0][0][0] <= least or g - last > PATIENCE:
            break
        one, two = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[one][2], scored[two][2], length, capacity, rng)
        best = scored[0][0]
        scored = sorted([*scored, (fitness(child, length), len(people) + g, child)], key=lambda x: x[:2])[:POPULATION]
        last = g if scored[0][0] < best else last
    return scored[0][2]


def _epoch(capacity: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = []
            for row in pdf.itertuples(index=False):
                length = np.asarray(row.lengths, np.int64)
                elites = [np.asarray(x, np.int64) for x in (row.bins, row.migrant) if x is not None and len(x)]
                best.append(evolve(length, elites, capacity, [epoch, int(row.shard), int(row.island)]))
            yield pd.DataFrame(
                {
                    "shard": pdf["shard"],
                    "island": pdf["island"],
                    "bins": [b.astype(np.int32).tolist() for b in best],
                    "n_bins": [int(b.max()) + 1 for b in best],
                }
            )

    return run


def pack_shards(pieces: DataFrame, level: int, capacity: int) -> DataFrame:
    """The pieces (row, length, …) with their bin: columns shard, bin and fill are added."""
    n = pieces.count()
    shards = max(1, -(-n // SHARD_ROWS))
    columns = pieces.columns
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.col("row"), F.lit(level)), F.lit(shards)).cast("long"))
    held = materialize(
        dealt.groupBy("shard")
        .agg(F.sort_array(F.collect_list(F.struct("row", *[c for c in columns if c != "row"]))).alias("items"))
        .repartition(min(shards, 2000), "shard")
    )
    lengths = held.select("shard", F.col("items.length").alias("lengths"))
    islands = lengths.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    none = F.lit(None).cast("array<int>")
    state = islands.withColumns({"bins": none, "migrant": none})
    for epoch in range(EPOCHS):
        out = materialize(
            state.repartition(min(shards * ISLANDS, 4000), "shard", "island").mapInPandas(
                _epoch(capacity, level * EPOCHS + epoch), "shard long, island int, bins array<int>, n_bins int"
            )
        )
        moved = out.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("bins").alias("migrant"))
        state = islands.join(out.drop("n_bins"), ["shard", "island"]).join(moved, ["shard", "island"])
    best = out.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "island")).alias("bins"))
    placed = held.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    flat = placed.select("shard", "x.items.*", F.col("x.bins").alias("bin"))
    filled = flat.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    return flat.join(filled, ["shard", "bin"])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = document_pieces(docs, tokenizer or default_tokenizer(), capacity)
    rows = materialize(pieces.withColumn("row", F.monotonically_increasing_id()))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = rows.filter(F.col("length") == capacity).select(
        *columns, F.col("row").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    parts, open_rows, level = [full], rows.filter(F.col("length") < capacity), 0
    while True:
        packed = materialize(pack_shards(open_rows, level, capacity))
        size = packed.agg(F.count("*").alias("n"), F.max("shard").alias("shards"), F.count_if(F.col("fill") < WELL_FILLED * capacity).alias("open")).first()
        last = not size["n"] or size["shards"] == 0 or size["open"] == size["n"]
        done = packed if last else packed.filter(F.col("fill") >= WELL_FILLED * capacity)
        where = F.lit(level << 56) + F.shiftleft(F.col("shard"), 24) + F.col("bin")
        offset = F.sum("length").over(W.partitionBy("shard", "bin").orderBy("row")) - F.col("length")
        parts.append(done.select(*columns, where.alias("sequence_id"), offset.alias("offset")))
        if last:
            break
        open_rows = packed.filter(F.col("fill") < WELL_FILLED * capacity).select("row", *columns)
        level += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
