"""Language identification by averaged hashed subword embeddings and a linear softmax.

The subwords of a text are its byte n-grams within words (a blank stands for each word border,
letters are lower case, everything that is not a letter is a border), hashed into buckets. A
text is the average of its buckets' embeddings; a linear softmax turns it into language
probabilities. Both layers are trained by stochastic gradient descent in numpy on a bounded,
documented sample of labelled rows: ``SAMPLE_ROWS`` of each language, less where all languages
together would pass ``SAMPLE_TOTAL``. Tasks count the subwords of the sampled rows; only the
counts, of at most ``BUCKETS`` subwords a row, reach the driver. For few languages the product of
both layers is a table (bucket, language); for more the tasks take both layers, so the model
stays small with any number of languages. Prediction reads whole texts.

Rejection goes by the mean confidence of a text's windows of ``WINDOW`` subwords, or by that of the
whole text if it is higher: a text of several known languages is sure in each of its parts, and one
with odd passages as a whole. Calibration takes rows that training did not
see: a temperature that maximises their likelihood, and a bound for each of the lengths ``LEVELS``
(texts are thinned to that many subwords). Languages are left out in turn, ``TURNS`` groups at most,
and a model of the others judges them. The bound is at most a tenth of the way to chance below what
only ``REJECT_SHARE`` of the thinned texts of known languages stay under; where ``LEFT_OUT_SHARE`` of
the texts of left-out languages stay under less than that, it is half-way between both. Shorter texts are not rejected for their confidence; nor is
any where there are fewer than three languages, as then none can be left out. Texts without letters
are rejected always.

Defined results: null, empty and letterless texts get ``und`` with score 0 and are rejected;
null lang is never learned from; repeated rows are predicted each; without any labelled row
every text gets ``und`` and only letterless ones are rejected; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import PART_CHARS, blocks, broadcast_if_small, counted, encoded, parts, release

#: Labelled rows that training uses at most for each language, and in all.
SAMPLE_ROWS, SAMPLE_TOTAL = 1200, 12_000
BUCKETS, WIDTH, ORDERS = 1 << 15, 16, (2, 3, 4)
EPOCHS, RATE, BATCH = 12, 4.0, 32
#: Subwords of a window, and the lengths (in subwords) that have a bound of their own.
WINDOW, LEVELS = 256, (16, 64, 256, 1024)
#: Share of unseen thinned rows of known languages that may stay under the bound before its margin is taken off.
REJECT_SHARE, MARGIN = 0.005, 0.1
#: Share of the texts of left-out languages that should be turned away.
LEFT_OUT_SHARE = 0.95
#: Groups of languages that are left out in turn, rows of a language and passes that training takes for it.
TURNS, TURN_ROWS, TURN_EPOCHS = 4, 200, 6
UNKNOWN = "und"
#: Languages whose counts are broadcast at most.
BROADCAST_LANGUAGES = 100_000


def is_letter_table() -> np.ndarray:
    """Bytes that count as letters: ASCII letters and all bytes of longer UTF-8 sequences."""
    out = np.zeros(256, bool)
    out[65:91] = out[97:123] = True
    out[128:] = True
    return out


_LETTER = is_letter_table()
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)
_FOLD[65:91] += 32


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of a block of texts, and the number of subwords before each text."""
    # a border before and after each text
    at = np.arange(len(data)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * 2 + 1
    folded = np.full(len(data) + 2 * (len(offsets) - 1), 32, np.uint8)
    folded[at] = _FOLD[data]
    begins = offsets[:-1] + 2 * np.arange(len(offsets) - 1)
    border = folded == 32
    code = folded.astype(np.uint32)
    found, places = [], []
    for n in ORDERS:
        m = len(folded) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        ok = np.ones(m, bool)
        for k in range(n):
            h = (h ^ code[k : k + m]) * np.uint32(0x01000193)
            if 0 < k < n - 1:
                ok &= ~border[k : k + m]
        if n == 2:
            ok &= ~(border[:m] & border[1:])
        where = np.flatnonzero(ok)
        h = h[where]
        h ^= h >> np.uint32(15)
        found.append((h % np.uint32(BUCKETS)).astype(np.int32))
        places.append(where)
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(place[order], [*begins, len(folded)])


@dataclass
class LanguageModel:
    languages: list[str]
    inner: np.ndarray  # (BUCKETS, WIDTH) embeddings, or (BUCKETS, languages) with the output layer multiplied in
    outer: np.ndarray | None  # (WIDTH, languages) output layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: tuple[float, ...] = (0.0,) * len(LEVELS)  # by length

    def folded(self) -> LanguageModel:
        """The same model with one table, where that is narrower than the embeddings."""
        if self.outer is None or len(self.languages) > WIDTH:
            return self
        return replace(self, inner=self.inner @ self.outer, outer=None)

    def hidden(self, counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        bucket, n = counts
        return (n @ self.inner[bucket]) / n.sum()

    def probabilities(self, hidden: np.ndarray) -> np.ndarray:
        return softmax(((hidden if self.outer is None else hidden @ self.outer) + self.bias) / self.temperature)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the best language of each text (-1 without subwords), its probability, and whether the text is rejected."""
        best, score, rejected = np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), bool)
        bounds = np.array([0.0, *self.reject_below])
        for first, _, data, offsets in blocks(texts):
            bucket, upto = buckets_of(data, offsets)
            size = np.diff(upto)
            held = np.flatnonzero(size)
            if not len(held):
                continue
            if not self.languages:  # nothing was learned: no text is named, none with subwords is rejected
                best[first + held], rejected[first + held] = 0, False
                continue
            n = size[held]
            windows = np.maximum(1, n // WINDOW)  # the last one takes the rest
            at = np.cumsum(windows) - windows
            start = np.repeat(upto[:-1][held] - at * WINDOW, windows) + np.arange(windows.sum()) * WINDOW
            sums = np.add.reduceat(self.inner[bucket], start, axis=0)
            sure = self.probabilities(sums / np.diff(start, append=len(bucket))[:, None]).max(1)
            p = self.probabilities(np.add.reduceat(sums, at, axis=0) / n[:, None])
            best[first + held], score[first + held] = p.argmax(1), p.max(1)
            sure = np.maximum(np.add.reduceat(sure, at) / windows, p.max(1))
            rejected[first + held] = sure < bounds[np.searchsorted(LEVELS, n, side="right")]
        return best, score, rejected


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True)) if x.shape[1] else x
    return e / e.sum(1, keepdims=True)


def subword_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text in order, and how often each occurs."""
    bucket, n = np.unique(buckets_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0], return_counts=True)
    return bucket.astype(np.uint16), n.astype(np.float32)


def packed_counts(counts: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The counts of a text in a byte or two for each bucket: gaps between buckets, and numbers, deflated."""
    bucket, n = counts
    return zlib.compress(np.diff(bucket, prepend=np.uint16(0)).astype("<u2").tobytes() + n.astype("<u4").tobytes())


def unpacked_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    size = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, "<u2", size), dtype=np.uint16), np.frombuffer(raw, "<u4", size, 2 * size).astype(np.float32)


def descend(rows: list, y: np.ndarray, use: list[int], count: int, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both layers and the bias for ``count`` languages, from the rows named in ``use``."""
    inner = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    outer, bias = np.zeros((WIDTH, count), np.float32), np.zeros(count, np.float32)
    use = list(use)
    steps, done = max(1, epochs * len(use) // BATCH), 0
    for _ in range(epochs):
        for at in range(0, len(use), BATCH):
            if at == 0:
                rng.shuffle(use)
            some = use[at : at + BATCH]
            hidden = np.stack([(rows[i][1] @ inner[rows[i][0]]) / rows[i][1].sum() for i in some]).astype(np.float32)
            error = softmax(hidden @ outer + bias)
            error[np.arange(len(some)), y[some]] -= 1
            rate = RATE * max(0.02, 1 - done / steps)
            back = error @ outer.T
            outer -= rate / len(some) * hidden.T @ error
            bias -= 0.1 * rate / len(some) * error.sum(0)
            for i, g in zip(some, back, strict=True):
                bucket, n = rows[i]
                inner[bucket] -= (rate / len(some) * BATCH / 4) * (n / n.sum())[:, None].astype(np.float32) * g
            done += 1
    return inner, outer, bias


def tempered(model: LanguageModel, rows: list, y: np.ndarray) -> LanguageModel:
    """The model with the temperature that maximises the likelihood of unseen rows."""
    if not len(rows):
        return model
    model = replace(model, temperature=1.0)
    hidden = np.stack([model.hidden(r) for r in rows])
    logits = hidden @ model.outer + model.bias
    # smoothed targets: rows that are all right don't prove certainty
    target = np.full(logits.shape, 1 / (len(rows) + 2) / max(1, len(model.languages) - 1))
    target[np.arange(len(rows)), y] = 1 - 1 / (len(rows) + 2)
    grid = np.geomspace(0.05, 5, 41)
    loss = [-(target * np.log(softmax(logits / t) + 1e-12)).sum(1).mean() for t in grid]
    return replace(model, temperature=float(grid[int(np.argmin(loss))]))


def thinned_confidence(model: LanguageModel, rows: list, level: int, rng: np.random.Generator) -> np.ndarray:
    """Mean confidence of the windows of rows that have ``level`` subwords, thinned to as many."""
    windows, out = max(1, level // WINDOW), []
    for bucket, n in rows:
        if n.sum() < level:
            continue
        drawn = rng.multinomial(level // windows, n / n.sum(dtype=np.float64), size=windows)
        hidden = drawn.astype(np.float32) @ model.inner[bucket] / (level // windows)
        out.append(model.probabilities(hidden).max(1).mean())
    return np.array(out)


def left_out_confidence(rows: list, y: np.ndarray, count: int, rng: np.random.Generator) -> dict[int, np.ndarray]:
    """By length, the confidence of texts of languages that the model judging them doesn't know."""
    few = np.concatenate([np.flatnonzero(y == k)[:TURN_ROWS] for k in range(count)]) if count else np.zeros(0, int)
    found: dict[int, list] = {level: [] for level in LEVELS}
    turns = min(TURNS, count)
    for turn in range(turns):
        known = [k for k in range(count) if k % turns != turn]
        if len(known) < 2:
            return {}
        place = np.full(count, -1)
        place[known] = np.arange(len(known))
        own = [i for i in few if place[y[i]] >= 0]
        use, check = [i for k, i in enumerate(own) if k % 5 != 4], [i for k, i in enumerate(own) if k % 5 == 4]
        model = LanguageModel([str(k) for k in known], *descend(rows, place[y], use, len(known), TURN_EPOCHS, rng))
        model = tempered(model, [rows[i] for i in check], place[y[check]])
        foreign = [rows[i] for i in few if place[y[i]] < 0]
        for level in LEVELS:
            found[level].append(thinned_confidence(model, foreign, level, rng))
    return {level: np.concatenate(x) for level, x in found.items() if x}


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> LanguageModel:
    """Fit both layers on four fifths of the rows (:func:`subword_counts` of texts), calibrate on the rest."""
    languages = sorted(set(labels))
    place = {x: i for i, x in enumerate(languages)}
    y = np.array([place[x] for x in labels], np.int64)
    full = np.array([len(r[0]) > 0 for r in rows], bool)
    held = np.arange(len(rows)) % 5 == 4
    rng = np.random.default_rng(seed)
    model = LanguageModel(languages, *descend(rows, y, np.flatnonzero(~held & full).tolist(), len(languages), EPOCHS, rng))
    check = np.flatnonzero(held & full)
    unseen = [rows[i] for i in check]
    model = tempered(model, unseen, y[check])
    with_words = np.flatnonzero(full)
    foreign = left_out_confidence([rows[i] for i in with_words], y[with_words], len(languages), rng)
    chance, bounds = 1 / max(1, len(languages)), []
    for level in LEVELS:
        known = thinned_confidence(model, unseen, level, rng)
        if not len(known) or not len(foreign.get(level, ())):
            bounds.append(0.0)  # nothing to calibrate on
            continue
        low = np.quantile(known, REJECT_SHARE)
        most = low - MARGIN * (low - chance)
        bounds.append(float((min(np.quantile(foreign[level], LEFT_OUT_SHARE), most) + most) / 2))
    return replace(model, reject_below=tuple(bounds)).folded()


def in_training(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the decimal doc_id is not a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL) -> DataFrame:
    """About ``rows`` labelled rows of each language at most, and ``total`` in all, chosen by the hash of doc_id.

    The share of each language follows from counts over all rows, so no language is sorted or
    gathered, and no language is left out while there is one row in ``total`` for it.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(in_training(F.col("doc_id")), F.lit(False)))
    counts, languages = counted(labelled.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__n")))
    each = max(1, min(rows, total // max(1, languages)))
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000))
    base = labelled.select("doc_id", "lang", "text")
    picked = base.join(broadcast_if_small(counts, languages, BROADCAST_LANGUAGES), base["lang"] == counts["__lang"])
    return picked.filter(place * F.col("__n") < F.lit(each * 1_000_000)).select("doc_id", "lang", "text")


def _count_subwords(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts(batches):
        yield pd.DataFrame({"lang": part["lang"].array, "counts": [packed_counts(subword_counts(t)) for t in encoded(part["text"])]})


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL) -> LanguageModel:
    """Train on the bounded sample of :func:`training_sample`."""
    sample = training_sample(docs, rows, total).mapInPandas(_count_subwords, "lang string, counts binary").toPandas()
    # an order that doesn't depend on how the rows were dealt
    sample = sample.sort_values(["lang", "counts"]).iloc[np.random.default_rng(3).permutation(len(sample))]
    return train([unpacked_counts(x) for x in sample["counts"]], sample["lang"].tolist())


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of ``docs``."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH, and a column for each language

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for part in parts(batches):
            texts = [t if isinstance(t, str) else "" for t in part["text"]]
            best, score, rejected = model.predict(encoded(texts))
            letters = np.array([any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) for t in texts], bool)
            best, score = np.where(letters, best, -1), np.where(letters, score, 0.0)
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].array,
                    "held_out": part["held_out"].array,
                    "lang_pred": names[best],
                    "score": score.astype(float),
                    "rejected": (best < 0) | rejected,
                }
            )

    held_out = F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out, "text").mapInPandas(
        scan, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged and with all of their columns."""
    model = model or fit(docs.select("doc_id", "lang", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH, and a column for each language
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            step = max(1, int(whole.num_rows * PART_CHARS / max(1, whole.nbytes)))
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                best, _, rejected = model.predict(encoded(texts))
                letters = np.array([any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) for t in texts], bool)
                yield batch.filter(pa.array((best >= 0) & ~rejected & letters))
            del whole, batch
            release()

    return docs.mapInArrow(scan, docs.schema)
