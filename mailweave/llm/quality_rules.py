"""Quality rules whose thresholds adapt to each language and source. DataFrame functions only.

Per document the counts of the base rules are computed inside the row (no explode, no shuffle):
repeated three-word windows come from one sort of the document's windows. Four ratios are
scaled to whole numbers. The quantile sketch of a ratio is its histogram on that fixed grid:
two sketches merge by adding counts, the quantile error is one grid step, and the result does
not depend on the order of merging. Sketches are kept per (lang, source), merged to lang and to
all rows; a group under ``MIN_ROWS`` rows takes its thresholds from the next wider group. A
value fails beyond ``median + REACH * (upper quartile - median) + slack`` (word length also
below the mirrored bound), so junk of up to a quarter of a group does not move its fence.

Defined results: null and empty texts have no words and fail the base rule; null lang or
source is a group of its own; repeated rows are counted and returned each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailweave.llm.common import broadcast_if_small, materialize

#: Rows below which a group's own sketch is not used.
MIN_ROWS = 200
#: Multiples of the distance from the median to the upper quartile.
REACH = 6
#: Ratio: (grid steps of slack, whether low values fail too). Mean word length in hundredths
#: of a character, the others in thousandths.
RATIOS = {"word_length": (150, True), "symbols": (50, False), "dup_lines": (250, False), "repeats": (250, False)}
#: Groups whose thresholds are broadcast at most.
BROADCAST_GROUPS = 100_000


def text_counts(docs: DataFrame) -> DataFrame:
    """The input columns doc_id, lang, source with the counts of the base rules."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        "doc_id",
        "lang",
        "source",
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    w = F.col("words")
    windows = split.select(
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= 3,
            F.slice(
                F.transform("words", lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2))),
                F.lit(1),
                F.size("words") - 2,
            ),
        ).alias("windows"),
    )
    # Only documents with a repeated window are sorted.
    ordered = windows.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("k"), i.alias("i")))),
        ),
    ).drop("windows")
    s = F.col("ordered")
    found = ordered.withColumn(
        "places",
        F.array_sort(
            F.array_compact(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        (x["k"] == F.get(s, i - 1)["k"]) | (x["k"] == F.get(s, i + 1)["k"]), x["i"]
                    ),
                )
            )
        ),
    ).drop("ordered")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")


def _ratio(part: Column, whole: Column, scale: int) -> Column:
    return F.floor(F.when(whole > 0, part * scale / whole).otherwise(0)).cast("long")


def ratios(counts: DataFrame) -> DataFrame:
    """The four ratios on their grids, beside the counts."""
    return counts.withColumns(
        {
            "word_length": _ratio(F.col("word_chars"), F.col("n_words"), 100),
            "symbols": _ratio(F.col("n_symbols"), F.col("word_chars"), 1000),
            "dup_lines": _ratio(F.col("n_dup_lines"), F.col("n_lines"), 1000),
            "repeats": _ratio(F.col("n_repeat_words"), F.col("n_words"), 1000),
        }
    )


def sketches(rated: DataFrame) -> DataFrame:
    """Histograms (lang, source, ratio, step, n); partially aggregated before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("step")) for r in RATIOS]))
    return (
        rated.filter("n_words > 0")
        .select("lang", "source", pairs.alias("p"))
        .groupBy("lang", "source", "p.ratio", "p.step")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``keys``: its rows and, for each ratio, the lowest and highest value that passes."""
    merged = sketch.groupBy(*keys, "ratio", "step").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "ratio")
    ranked = merged.select(
        *keys,
        "ratio",
        "step",
        F.sum("n").over(group.orderBy("step")).alias("upto"),
        F.sum("n").over(group).alias("rows"),
    )

    def quantile(hundredths: int) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("rows") * hundredths, F.col("step")))

    by_ratio = ranked.groupBy(*keys, "ratio").agg(
        F.max("rows").alias("rows"), quantile(50).alias("mid"), quantile(75).alias("upper"), quantile(25).alias("lower")
    )
    slack = F.element_at(F.create_map(*[F.lit(x) for r, (s, _) in RATIOS.items() for x in (r, s)]), F.col("ratio"))
    low_too = F.col("ratio").isin([r for r, (_, low) in RATIOS.items() if low])
    bounds = by_ratio.select(
        *keys,
        "ratio",
        "rows",
        (F.col("mid") + REACH * (F.col("upper") - F.col("mid")) + slack).alias("high"),
        F.when(low_too, F.col("mid") - REACH * (F.col("mid") - F.col("lower")) - slack).otherwise(-1).alias("low"),
    )
    wide = [F.max("rows").alias("rows")]
    for r in RATIOS:
        wide += [F.max(F.when(F.col("ratio") == r, F.col(b))).alias(f"{r}_{b}") for b in ("low", "high")]
    return bounds.groupBy(*keys).agg(*wide)


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, the name of the first adaptive rule that failed, and kept."""
    rated = materialize(ratios(text_counts(docs)))
    sketch = materialize(sketches(rated))
    names = [f"{r}_{b}" for r in RATIOS for b in ("low", "high")]

    def level(keys: list[str], mark: str) -> DataFrame:
        f = fences(sketch, keys)
        return f.select(
            *[F.col(k).alias(f"{mark}_{k}") for k in keys],
            F.struct("rows", *names).alias(mark),
        )

    both, lang, everything = level(["lang", "source"], "s"), level(["lang"], "l"), level([], "a")
    small = sketch.select("lang", "source").distinct().count()
    joined = rated.join(
        broadcast_if_small(both, small, BROADCAST_GROUPS),
        F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")),
        "left",
    ).join(broadcast_if_small(lang, small, BROADCAST_GROUPS), F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    # one row of thresholds for all documents
    joined = joined.join(F.broadcast(everything), F.lit(True), "left")
    fence = F.when(F.col("s.rows") >= MIN_ROWS, F.col("s")).when(F.col("l.rows") >= MIN_ROWS, F.col("l")).otherwise(F.col("a"))
    judged = joined.withColumn("fence", fence)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = [
        F.when((F.col(r) > F.col(f"fence.{r}_high")) | (F.col(r) < F.col(f"fence.{r}_low")), F.lit(r)) for r in RATIOS
    ]
    failed = reduce(lambda a, b: F.coalesce(a, b), broken)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & failed.isNull()).alias("kept"),
        failed.alias("rule_failed"),
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all of their columns; rows are matched by doc_id."""
    kept = apply_rules(docs.select("doc_id", "text", "lang", "source")).filter("kept").select(F.col("doc_id").alias("__keep"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__keep"]), "left_semi")
