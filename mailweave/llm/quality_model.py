"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted text: documents labelled good and not toxic. Characters are
folded (lower case, digits alike, any white space a blank) and an n-gram of up to ``ORDER`` of them is one
long. Counts, continuation counts, discounts and back-off weights are DataFrame aggregations and joins
sharded by n-gram; so are the probabilities of the n-gram types that the corpus holds, level by
level from unigrams up. A document's perplexity is the sum over the join of its n-gram counts
with the types' log-probabilities; the types are broadcast up to ``TYPES_ROWS`` (counted), and the
same join shuffles beyond.

A document is kept if its smoothed log-perplexity is within the threshold of its language:
a high quantile of trusted documents and a margin above it. Thresholds come from the fifth of the
trusted documents that the model doesn't learn from, so they hold for unseen text. Short texts
are drawn to their language's median, since few characters say little.

Defined results: null, empty and blank texts have no perplexity and are not kept; null lang, and
languages with fewer than ``MIN_DOCS`` held-out trusted documents, use median and threshold of all
of them (of all trusted documents where none is held out); without trusted text nothing
has a perplexity and everything with text is kept; repeated rows are scored each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import broadcast_if_small, counted, materialize, parts
from mailweave.session import measured

#: Characters of an n-gram; bits of a character.
ORDER, BITS = 4, 12
#: N-grams that a task gathers before it emits their counts.
FLUSH = 1 << 21
#: Characters of text that a task handles at once.
PART_TEXT = 1 << 20
#: N-gram types that are broadcast at most (a long and a double each); more are joined by a shuffle.
TYPES_ROWS = 2_000_000
BROADCAST_ROWS = 1_200_000
#: One of so many trusted documents (by crc32 of doc_id) is held out for the thresholds.
FOLDS = 5
#: Characters that a language's median weighs in a document's score.
PRIOR = 40
#: Quantile of trusted documents, share of its distance from the median that is added, fewest trusted documents.
QUANTILE, REACH, MIN_DOCS = 0.995, 0.75, 50
_MASK = (1 << BITS) - 1
_START, _DIGIT, _BLANK = 1, 2, 3


def _fold_table() -> np.ndarray:
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            out[i] = _BLANK
        elif c.isdigit():
            out[i] = _DIGIT
        else:
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    wide = out >= 1 << (BITS - 1)
    out[wide] = (1 << (BITS - 1)) | ((out[wide] * np.uint32(0x9E3779B1)) >> np.uint32(33 - BITS))
    return out.astype(np.uint16)


_FOLD: list[np.ndarray] = []


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, and the number of characters before each text."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _FOLD[0][np.where(points < 1 << 16, points, points >> np.uint32(4) & np.uint32(0xFFFF))].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(size)])
    spread = np.full(len(codes) + (ORDER - 1) * len(texts), _START, np.int64)
    at = np.arange(len(codes)) + np.repeat((np.arange(len(texts)) + 1) * (ORDER - 1), size)
    spread[at] = codes
    gram = codes.copy()
    for k in range(1, ORDER):
        gram |= spread[at - k] << (BITS * k)
    return gram, upto


def _texts(part: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in part["text"]]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def merged() -> pd.DataFrame:
        return pd.concat(held).groupby("gram", as_index=False, sort=False)["n"].sum()

    for part in parts(batches, size=PART_TEXT):
        values, n = np.unique(ngrams(_texts(part))[0], return_counts=True)
        held.append(pd.DataFrame({"gram": values, "n": n}))
        if sum(map(len, held)) > FLUSH:
            held = [merged()]
            if len(held[0]) > FLUSH // 2:
                yield held.pop()
    if held:
        yield merged()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) of all texts: counted in the tasks, then summed by n-gram."""
    return docs.select("text").mapInPandas(_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, BITS)


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))


class KneserNey:
    """Counts, discounts and back-off sums of all orders; every table is sharded by n-gram."""

    def __init__(self, trusted: DataFrame):
        self.counts: dict[int, DataFrame] = {ORDER: materialize(gram_counts(trusted))}
        for k in range(ORDER - 1, 0, -1):
            longer = self.counts[k + 1]
            self.counts[k] = materialize(
                longer.groupBy(_suffix(F.col("gram"), k + 1).alias("gram")).agg(F.count("*").alias("n"))
            )
        self.discounts = {k: self._discounts(c) for k, c in self.counts.items()}
        self.contexts = {k: self._contexts(k) for k in self.counts}

    @staticmethod
    def _discounts(counts: DataFrame) -> tuple[float, float, float]:
        """Discounts of n-grams counted once, twice and more often, from the counts of counts."""
        row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = row
        if not n1 or not n2:
            return 0.5, 0.5, 0.5
        y = n1 / (n1 + 2 * n2)
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
        return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(found, (1, 2, 3), strict=True))

    def _discount(self, k: int) -> Column:
        one, two, more = self.discounts[k]
        return F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)

    def _contexts(self, k: int) -> DataFrame:
        return materialize(
            self.counts[k].groupBy(_context(F.col("gram")).alias("context"))
            .agg(F.sum("n").alias("total"), (F.sum(self._discount(k)) / F.sum("n")).alias("back_off"))
        )

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """(gram, p) of distinct n-grams of the full order."""
        p: DataFrame | None = None
        for k in range(1, ORDER + 1):
            types = grams.select(F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("gram")).distinct()
            found = (
                types.join(self.counts[k], "gram", "left")
                .withColumn("context", _context(F.col("gram")))
                .join(self.contexts[k], "context", "left")
            )
            if p is None:
                lower = F.lit(1.0 / (1 << BITS))
            else:
                found = found.withColumn("suffix", _suffix(F.col("gram"), k)).join(
                    p.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix", "left"
                )
                lower = F.col("lower")
            own = F.coalesce(F.greatest(F.col("n") - self._discount(k), F.lit(0.0)) / F.col("total"), F.lit(0.0))
            p = materialize(found.select("gram", (own + F.coalesce("back_off", F.lit(1.0)) * lower).alias("p")))
        return p


def _document_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document with the distinct n-grams of its text and how often each occurs."""
    for part in parts(batches, size=PART_TEXT):
        grams, upto = ngrams(_texts(part))
        # one sort of (document, n-gram) for the whole part
        doc = np.repeat(np.arange(len(part)), np.diff(upto))
        order = np.lexsort((grams, doc))
        g, d = grams[order], doc[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(g)))
        cut = np.searchsorted(d[at], np.arange(len(part) + 1))
        g = g[at]
        yield part.drop(columns="text").assign(
            n_points=np.diff(upto),
            grams=[g[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)],
            times=[times[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)],
        )


def document_costs(docs: DataFrame, types: DataFrame, n_types: int, types_rows: int = TYPES_ROWS) -> DataFrame:
    """doc_id, lang, trusted, held, n_points and cost (minus log-probability of the text) of every row of ``docs``.

    types: gram, p of every n-gram of the texts. The sums are taken in the tasks before the shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = docs.select("doc_id", "lang", "trusted", "held", "text").mapInPandas(
        _document_grams, f"doc_id {kind}, lang string, trusted boolean, held boolean, n_points long, grams array<long>, times array<long>"
    )
    row = ["row", "doc_id", "lang", "trusted", "held", "n_points"]
    flat = each.withColumn("row", F.monotonically_increasing_id()).select(*row, F.explode_outer(F.arrays_zip("grams", "times")).alias("g"))
    flat = flat.select(*row, F.col("g.grams").alias("gram"), F.col("g.times").alias("n"))
    logs = broadcast_if_small(types.select("gram", F.log("p").alias("lp")), n_types, types_rows)
    cost = F.coalesce(-F.sum(F.col("n") * F.col("lp")), F.lit(0.0)).alias("cost")
    return flat.join(logs, "gram", "left").groupBy(*row).agg(cost).drop("row")


def trusted_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, lang, text, trusted and held of every row, and how many trusted ids there are.

    Trusted: labelled, never bad and never toxic. Held: the trusted ones kept for the thresholds.
    """
    good, n_good = counted(
        labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0").select("__id", F.lit(True).alias("__good"))
    )
    base = docs.select("doc_id", "lang", "text")
    marked = base.join(broadcast_if_small(good, n_good, BROADCAST_ROWS), base["doc_id"] == good["__id"], "left")
    trusted = F.coalesce("__good", F.lit(False))
    held = trusted & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0)
    return marked.select("doc_id", "lang", "text", trusted.alias("trusted"), F.coalesce(held, F.lit(False)).alias("held")), n_good


def score_quality(docs: DataFrame, labels: DataFrame, types_rows: int = TYPES_ROWS) -> DataFrame:
    """doc_id, n_points, perplexity, threshold (of the smoothed perplexity) and kept of every row."""
    marked, n_good = trusted_rows(docs, labels)
    model = KneserNey(marked.filter("trusted and not held"))
    types, n_types = counted(model.probabilities(materialize(gram_counts(docs))))
    scored, seen = measured(
        document_costs(marked, types, n_types, types_rows), held=F.count_if(F.col("held") & (F.col("n_points") > 0))
    )
    each = F.col("cost") / F.col("n_points")
    judge = F.col("held" if seen["held"] else "trusted") & (F.col("n_points") > 0)
    known = scored.filter(judge)
    median = F.percentile_approx(each, 0.5, 1000).alias("mid")
    middle, n_langs = counted(
        known.filter("lang is not null").groupBy(F.col("lang").alias("__lang")).agg(median, F.count("*").alias("rows")).filter(F.col("rows") >= MIN_DOCS).drop("rows")
    )
    everything = known.agg(median).first()["mid"]
    smooth = (F.col("cost") + PRIOR * F.col("mid")) / (F.col("n_points") + PRIOR)
    drawn = scored.join(broadcast_if_small(middle, n_langs, 100_000), F.col("lang") == F.col("__lang"), "left")
    drawn = drawn.withColumn("mid", F.coalesce("mid", F.lit(everything).cast("double"))).withColumn("score", smooth)
    top, half = F.percentile_approx("score", QUANTILE, 10000), F.percentile_approx("score", 0.5, 10000)
    limit = (top + REACH * (top - half)).alias("own")
    per = materialize(drawn.filter(judge & F.col("__lang").isNotNull()).groupBy(F.col("__lang").alias("__of")).agg(limit))
    common = drawn.filter(judge).agg(limit).first()["own"]
    out = drawn.join(broadcast_if_small(per, n_langs, 100_000), F.col("__lang") == F.col("__of"), "left")
    threshold = F.coalesce("own", F.lit(common).cast("double"))
    blank = F.col("n_points") == 0
    return out.select(
        "doc_id",
        "n_points",
        F.when(~blank & F.lit(n_good > 0), F.exp(each)).alias("perplexity"),
        F.exp(threshold).alias("threshold"),
        F.when(blank, False).otherwise(F.coalesce(F.col("score") <= threshold, F.lit(True))).alias("kept"),
    )
