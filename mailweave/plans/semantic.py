"""Exact vector search, similar pairs, coverage and the embedding job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailweave.operators.algebra import merge, top
from mailweave.plans.listing import full_text
from mailweave.session import cut, handed

SIMILAR, NEIGHBOURS, BATCH = 0.82, 5, 32
#: Rows of a small block of the search, and of a cell's block; rows of a block of a large model; small blocks of a model at most.
BLOCK, WIDE, SPREAD = 2048, 32_768, 4
#: Queries and candidates of a tile that is compared at once; candidates of a first bound; pairs compared in double at once.
TILE, FIRST, PAIRS = (1024, 4096), 512, 1 << 17
#: Bytes of a part of the candidates' files, where blocks of queries read through them; such blocks for each wide one.
GROUP, PER = 1 << 22, 4
#: Vectors that centres are fitted on at most, of a model and in all; centres at most; queries that tune the probes; share that has to be found.
SAMPLE_VECTORS, SAMPLE_TOTAL, CELLS, QUERIES, RECALL = 20_000, 200_000, 1024, 200, 0.95


class SemanticError(RuntimeError):
    """Search can't answer: no embedder, nothing embedded, or vectors of another size."""


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity_of(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def neighbours(vectors: DataFrame, query: list[float], model: str, limit: int = 10) -> DataFrame:
    """(id, distance): nearest vectors of a model by cosine distance, exact; the filter comes first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(F.col("model") == model).filter(F.size("vector") == len(query))
    d = 1 - dot(F.col("vector"), q) / F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(q, q))
    return top(rows.select("id", F.round(d, 4).alias("distance")), F.asc("distance"), F.asc("id"), limit=limit)


def nearest_of_all(vectors: DataFrame, k: int = NEIGHBOURS, blocks: int | None = None, queries: DataFrame | None = None, own: bool = False) -> DataFrame:
    """(left, right, distance): the ``k`` nearest of every vector (or of ``queries``) within its model, exact.

    With ``own`` a vector is among its own nearest. Vectors without a model are in none.

    Queries and candidates of a model are dealt into blocks, each kind by its own number of rows; a task
    compares one block of queries with one of candidates and keeps ``k`` of each query. So a candidate
    is shuffled once for each block of queries of its model, and rows grow with queries times blocks, not with pairs.
    Where that is more than ``SPREAD`` times, candidates aren't shuffled: their files are handed to the executors.
    """
    rows = vectors.filter(F.col("vector").isNotNull())
    asked = rows if queries is None else queries.filter(F.col("vector").isNotNull())
    held = rows.groupBy("model").agg(_blocks(F.count("*"), blocks).alias("cs"))
    # as many query blocks as candidates have where they are the same, else by their own number; a row per model
    each = held.withColumn("qs", F.col("cs")) if queries is None else held.join(asked.groupBy("model").agg(_blocks(F.count("*"), blocks).alias("qs")), "model")
    sizes = cut(each)
    if blocks is None and (large := {r["model"]: r["qs"] * PER for r in sizes.filter(F.col("qs") > SPREAD).collect()}):  # a row per model
        few, many = ~F.col("model").isin(list(large)), F.col("model").isin(list(large))
        rest = nearest_of_all(rows.filter(few), k, None, None if queries is None else asked.filter(few), own)
        return _read_through(asked.filter(many), rows.filter(many), large, k, own).unionByName(rest)
    columns = ["model", "q", "c", "side", "id", "vector"]

    def deal(df: DataFrame, mine: str, count: str, other: str, others: str, side: int) -> DataFrame:
        placed = df.select("id", "model", "vector").join(sizes, "model").withColumn(mine, F.pmod(F.xxhash64("id"), F.col(count)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).withColumn("side", F.lit(side)).select(*columns)

    sides = deal(asked, "q", "qs", "c", "cs", 0).unionByName(deal(rows, "c", "cs", "q", "qs", 1))
    return _best(sides, ["model", "q", "c"], k, vectors.schema["id"].dataType.simpleString(), own)


def _read_through(asked: DataFrame, rows: DataFrame, blocks: dict[str, int], k: int, own: bool) -> DataFrame:
    """(left, right, distance): the ``k`` nearest of each query; a block of queries reads all candidates of its model, a part of a file at a time."""
    names, kind = handed(rows.select("id", "model", "vector").sortWithinPartitions("model"), GROUP), rows.schema["id"].dataType.simpleString()

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, unit = pdf["id"].to_numpy(), _unit(pdf["vector"])
        best, bound = (np.empty(0, np.int64), np.empty(0, ids.dtype), np.empty(0)), np.full(len(ids), np.inf)
        for name in names:
            file = pq.ParquetFile(SparkFiles.get(name), pre_buffer=False)
            for g in range(file.num_row_groups):
                part = file.read_row_group(g, columns=["model"], use_threads=False)
                here = pc.equal(part["model"], key[0])
                if not pc.any(here).as_py():
                    continue
                part = file.read_row_group(g, columns=["id", "vector"], use_threads=False).filter(here).sort_by("id").combine_chunks()
                others = part["id"].to_numpy()
                at, to, d = _nearest(unit, _unit(part["vector"].to_numpy()), ids, others, k, own, bound)
                # sorted by query, distance and id; the first ``k`` stay
                at, to, d = np.r_[best[0], at], np.r_[best[1], others[to]], np.r_[best[2], d]
                order = np.lexsort((to, d, at))
                at, to, d = at[order], to[order], d[order]
                place = np.arange(len(at)) - np.searchsorted(at, at, "left")
                last = place == k - 1
                bound[at[last]] = d[last]
                best = at[place < k], to[place < k], d[place < k]
        return pd.DataFrame({"left": ids[best[0]], "right": best[1], "distance": best[2]})

    count = F.element_at(F.create_map(*[F.lit(x) for m in blocks.items() for x in m]), F.col("model"))
    placed = asked.select("model", F.pmod(F.xxhash64("id"), count).cast("int").alias("q"), "id", "vector")
    best = placed.repartitionByRange(sum(blocks.values()), "model", "q").groupBy("model", "q").applyInPandas(compare, f"left {kind}, right {kind}, distance double")
    place = F.row_number().over(W.partitionBy("left").orderBy("distance", "right"))
    return best.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def _blocks(n: Column, fixed: int | None) -> Column:
    """Blocks of so many rows: of ``WIDE`` rows, or up to ``SPREAD`` smaller ones, so that small models make tasks too."""
    if fixed is not None:
        return F.lit(fixed)
    return F.greatest(F.ceil(n / WIDE), F.least(F.ceil(n / BLOCK), F.lit(SPREAD))).cast("int")


def _best(sides: DataFrame, block: list[str], k: int, kind: str, own: bool) -> DataFrame:
    """(left, right, distance): the ``k`` nearest candidates (side 1) of each query (side 0) over all blocks."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0].sort_values("id"), pdf[pdf["side"] == 1].sort_values("id")
        if left.empty or right.empty:
            return pd.DataFrame({"left": [], "right": [], "distance": []})
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        at, to, d = _nearest(_unit(left["vector"]), _unit(right["vector"]), ids, others, k, own)
        return pd.DataFrame({"left": ids[at], "right": others[to], "distance": d})

    best = sides.groupBy(*block).applyInPandas(compare, f"left {kind}, right {kind}, distance double")
    place = F.row_number().over(W.partitionBy("left").orderBy("distance", "right"))
    return best.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def _nearest(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int, own: bool, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and candidates and their distances: the ``k`` nearest by distance to nine digits, then by place.

    ``others`` are sorted. A tile of queries and candidates is in memory at a time, compared in single precision; what
    may be as near as the k-th found so far, by the largest error of such a product, is compared in double. ``known``
    are distances of the k-th of each query among other candidates: what is farther needn't come out.
    """
    error = (queries.shape[1] + 4) * 2.0**-22 + 2e-9
    narrow = candidates.astype(np.float32)
    found = []
    for a in range(0, len(queries), TILE[0]):
        part, own_ids = queries[a : a + TILE[0]], ids[a : a + TILE[0]]
        small = part.astype(np.float32)
        bound = np.full(len(part), np.inf) if known is None else known[a : a + TILE[0]].copy()
        rows, columns, near = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for b in range(0, len(candidates), TILE[1]):
            if b == 0 and not np.isfinite(bound).all():
                # the k-th of the first candidates bounds what is looked at in their tile; others than the query's own
                first = 1 - small @ narrow[: min(TILE[1], FIRST)].T
                if not own:
                    first[own_ids[:, None] == others[None, : first.shape[1]]] = np.inf
                if first.shape[1] > k:
                    bound = np.fmin(bound, np.partition(first, k - 1, axis=1)[:, k - 1] + error)
            r, c = np.nonzero(small @ narrow[b : b + TILE[1]].T >= (1 - bound - error)[:, None].astype(np.float32) - np.float32(1e-7))
            c = c + b
            if not own:
                kept = own_ids[r] != others[c]
                r, c = r[kept], c[kept]
            if not len(r):
                continue
            x = np.concatenate([1 - np.einsum("ij,ij->i", part[r[i : i + PAIRS]], candidates[c[i : i + PAIRS]]) for i in range(0, len(r), PAIRS)])
            rows, columns, near = np.r_[rows, r], np.r_[columns, c], np.r_[near, np.round(x, 9)]
            order = np.lexsort((columns, near, rows))
            rows, columns, near = rows[order], columns[order], near[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
            kept = place < k
            rows, columns, near, place = rows[kept], columns[kept], near[kept], place[kept]
            full = place == k - 1
            bound[rows[full]] = np.fmin(bound[rows[full]], near[full])
        found.append((rows + a, columns, near))
    return tuple(np.concatenate(x) for x in zip(*found))


def _unit(vectors) -> np.ndarray:
    m = np.stack(list(vectors)).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


@dataclass(frozen=True)
class CellIndex:
    """Vectors by the nearest of their model's centres: the search for models too large for all pairs.

    Every vector is indexed; only the centres are fitted on a sample. ``probes`` is how many cells of
    each model a query looks into, tuned for ``k`` neighbours at most.
    """

    rows: DataFrame  # id, model, vector, cell
    centres: dict[str, np.ndarray]
    probes: dict[str, int]
    k: int

    def search(self, queries: DataFrame, k: int = NEIGHBOURS, own: bool = False, probes: dict[str, int] | None = None) -> DataFrame:
        """(left, right, distance): about the ``k`` nearest of each query (id, model, vector) within its model."""
        if k > self.k:
            raise ValueError(f"the probes are tuned for {self.k} neighbours, not for {k}")
        asked = _dealt(queries, self.centres, probes or self.probes)
        # a cell of any size is compared in blocks, and its queries go to each
        sizes = self.rows.groupBy("model", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        candidates = self.rows.join(sizes, ["model", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        columns = ["model", "cell", "block", "side", "id", "vector"]
        each = asked.join(sizes, ["model", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sides = each.withColumn("side", F.lit(0)).select(*columns).unionByName(candidates.withColumn("side", F.lit(1)).select(*columns))
        return _best(sides, ["model", "cell", "block"], k, self.rows.schema["id"].dataType.simpleString(), own)


def _dealt(rows: DataFrame, centres: dict[str, np.ndarray], counts: dict[str, int]) -> DataFrame:
    """Each vector with as many nearest cells as ``counts`` has for its model (else one), a row for each."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # at most CELLS centres of each model
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                near = shared.value.get(model)
                if near is None:
                    continue
                close, wanted = -_unit(part["vector"]) @ near.T, counts.get(model, 1)
                cells = close.argmin(1)[:, None] if wanted == 1 else np.argsort(close, axis=1, kind="stable")[:, :wanted]
                at = np.repeat(np.arange(len(part)), cells.shape[1])
                yield pd.DataFrame({"id": part["id"].to_numpy()[at], "model": model, "vector": part["vector"].to_numpy()[at], "cell": cells.reshape(-1).astype(np.int32)})

    return rows.filter(F.col("vector").isNotNull()).select("id", "model", "vector").mapInPandas(scan, f"id {kind}, model string, vector array<float>, cell int")


def model_sizes(vectors: DataFrame) -> dict[str, int]:
    return {r["model"]: r["n"] for r in vectors.groupBy("model").agg(F.count("*").alias("n")).collect()}  # a row per model


def sampled(vectors: DataFrame, sizes: dict[str, int], count: int, salt: int) -> DataFrame:
    """About ``count`` vectors of each model, or all of a smaller one, chosen by their ids."""
    if not sizes:
        return vectors.limit(0)
    share = F.element_at(F.create_map(*[F.lit(x) for m, n in sizes.items() for x in (m, min(1.0, count / n))]), F.col("model"))
    return vectors.filter(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) / 1_000_000 < share)


def fitted_centres(vectors: DataFrame, sizes: dict[str, int], sample: int, most: int = SAMPLE_TOTAL, small: int = 0) -> dict[str, np.ndarray]:
    """Centres of each model, from about ``sample`` of its vectors and ``most`` of all models together at most.

    A model of at most ``small`` vectors gets one centre.
    """
    each = max(1, min(sample, most // max(1, len(sizes))))
    picked = sampled(vectors, sizes, each, 3).select("id", "model", "vector").toPandas()  # bounded by ``most``
    count = {m: 1 if n <= small else min(CELLS, max(1, round(n**0.5))) for m, n in sizes.items()}
    return {m: _centres(_unit(part.sort_values("id")["vector"]), count[m]) for m, part in picked.groupby("model")}


def recall_by_model(truth: DataFrame, found: DataFrame, queries: DataFrame) -> dict[str, float]:
    """Share of ``truth`` (left, right, distance) that ``found`` holds, by the model of the query (id, model)."""
    hit = truth.join(found.select("left", "right", F.lit(1).alias("hit")), ["left", "right"], "left")
    rows = hit.join(queries.select(F.col("id").alias("left"), "model"), "left").groupBy("model").agg((F.count("hit") / F.count("*")).alias("share"))
    return {r["model"]: r["share"] for r in rows.collect()}


def cell_index(vectors: DataFrame, k: int = NEIGHBOURS, least: float = RECALL, sample: int = SAMPLE_VECTORS, small: int = BLOCK) -> CellIndex:
    """Fit centres on at most about ``sample`` vectors of each model, index every vector, and tune the probes.

    The probes of a model are the fewest (doubling) at which a bounded sample of queries finds at
    least ``least`` of what brute force finds for ``k`` neighbours, in a second sample too that the
    tuning didn't use. A model of at most ``small`` vectors is one cell, so its search is exact.
    """
    vectors = vectors.filter(F.col("vector").isNotNull())
    sizes = model_sizes(vectors)
    centres = fitted_centres(vectors, sizes, sample, small=small)
    index = CellIndex(cut(_dealt(vectors, centres, {})), centres, {m: 1 for m in centres}, k)
    tuned = {m: n for m, n in sizes.items() if m in centres and len(centres[m]) > 1}
    for salt in (5, 7):
        if not tuned:
            break
        asked = cut(sampled(vectors.filter(F.col("model").isin(list(tuned))), tuned, QUERIES, salt))
        truth = cut(nearest_of_all(vectors.filter(F.col("model").isin(list(tuned))), k, queries=asked))
        open_ = set(tuned)
        while open_:
            found = recall_by_model(truth, index.search(asked, k), asked)
            open_ = {m for m in open_ if found.get(m, 1.0) < least and index.probes[m] < len(centres[m])}
            index = replace(index, probes={m: min(len(centres[m]), 2 * p) if m in open_ else p for m, p in index.probes.items()})
    return index


def _centres(unit: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; a cell that loses its vectors keeps its centre."""
    rng = np.random.default_rng(5)
    centres = unit[np.sort(rng.choice(len(unit), min(count, len(unit)), replace=False))]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        held = np.bincount(nearest, minlength=len(centres)) > 0
        centres[held] = sums[held] / np.maximum(np.linalg.norm(sums[held], axis=1, keepdims=True), 1e-300)
    return centres


def coverage(messages: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Messages, those with a vector of the model, with one of another, and with nothing to embed."""
    best = vectors.groupBy("id").agg(F.max((F.col("model") == model).cast("int")).alias("own"))
    rows = messages.join(best, "id", "left")
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("own") == 1).alias("embedded"), F.count_if(F.col("own") == 0).alias("other_model"),
        F.count_if(F.col("own").isNull() & empty).alias("unembeddable"),
    )


def needing(messages: DataFrame, vectors: DataFrame, model: str, chars: int | None = None) -> DataFrame:
    """(id, text) of messages without a vector of the model that have a body: whole, or as much as an embedder takes."""
    have = vectors.filter(F.col("model") == model).select("id")
    text = F.concat_ws("\n\n", F.col("subject"), F.col("text"))
    text = text if chars is None else F.left(text, F.lit(chars))
    return messages.filter(F.trim("text") != "").join(have, "id", "left_anti").select("id", text.alias("text"))


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, dimension: int) -> DataFrame:
    """(id, model, vector) of texts; vectors of a wrong size come back null, to be counted and left out."""
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                vectors = embedder(part["text"].tolist())
                if len(vectors) != len(part):
                    raise SemanticError("the embedder answered another number of texts")
                yield pd.DataFrame({"id": part["id"].array, "model": model, "vector": [v if len(v) == dimension else None for v in vectors]})

    return rows.mapInPandas(scan, f"id {kind}, model string, vector array<float>")


def hashing_embedder(dimension: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests: hashed words, unit length."""
    import zlib

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1 if h >> 16 & 1 else -1
            out.append((v / max(1e-12, np.linalg.norm(v))).tolist())
        return out

    return run


def write_embeddings(vectors: DataFrame, rows: DataFrame, messages: DataFrame, model: str) -> DataFrame:
    """Attach vectors (id, vector) to messages that exist; a message has one vector, the newest."""
    fresh = rows.filter("vector is not null").join(messages.select("id"), "id", "left_semi").dropDuplicates(["id"])
    return merge(vectors, fresh.select("id", F.lit(model).alias("model"), "vector"), ["id"])


def clear_embeddings(vectors: DataFrame, model: str | None = None) -> DataFrame:
    """Without the vectors of a model, or without any."""
    return vectors.limit(0) if model is None else vectors.filter(F.col("model") != model)


def search(kind: str, text: str, index: DataFrame, vectors: DataFrame, model: str = "", embedder: Callable | None = None, limit: int = 10) -> DataFrame:
    """(id, score): by words over postings, or by meaning over vectors; a similarity is a score."""
    if kind == "fulltext":
        return full_text(index, text, limit)
    if kind != "semantic":
        raise ValueError(f"{kind} isn't a kind of search")
    near = search_checked(vectors, None if embedder is None else embedder([text])[0], model, limit)
    return near.select("id", similarity_of(F.col("distance")).alias("score")).orderBy(F.desc("score"), "id")


def search_checked(vectors: DataFrame, query: list[float] | None, model: str, limit: int = 10) -> DataFrame:
    """Search that says why it can't answer instead of answering nothing."""
    if query is None:
        raise SemanticError("no embedder is set up")
    own = vectors.filter(F.col("model") == model)
    first = own.select(F.size("vector").alias("n")).first()
    if first is None:
        raise SemanticError(f"nothing is embedded by {model}")
    if first["n"] != len(query):
        raise SemanticError(f"vectors of {model} have {first['n']} numbers, the query {len(query)}")
    return neighbours(vectors, query, model, limit)
