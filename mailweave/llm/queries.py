"""Queries opN_<name> over the document table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import documents
from mailweave.llm.exact_dedup import exact_groups
from mailweave.llm.hard_negatives import mine_negatives
from mailweave.llm.language_id import identify
from mailweave.llm.license_scan import scan_licenses
from mailweave.llm.merkle_manifest import build_manifest, folded, proof_digest
from mailweave.llm.mixing import mix_sources
from mailweave.llm.near_dedup import near_components
from mailweave.llm.packing import pack
from mailweave.llm.quality_model import score_quality
from mailweave.llm.quality_rules import MIN_ROWS, RATIOS, REACH, apply_rules
from mailweave.llm.secret_scan import scan_secrets
from mailweave.llm.sharding import NEAR, ROW_BYTES, SHARDS, shard_by_bytes
from mailweave.llm.substring_dedup import remove_repeats


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    best = F.array_max(F.transform("found", lambda x: F.struct(x["coverage"], x["end"] - x["start"], x["template"].alias("t"))))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_licenses"),
        best["t"].alias("license"),
        F.round(best["coverage"], 4).alias("coverage"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["template"], x["start"], x["end"])), ",").alias("spans"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    base = F.filter("found", lambda x: x["kind"] != "crf")
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    line = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), words=3, percent=85)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


def op12_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(documents(spark, sf_dir), carry=["doc_id"])
    return placed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    cut = F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = build_manifest(documents(spark, sf_dir), {"text": cut})
    made = made.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded(F.col("leaf_now"), F.col("path"))})
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Regular expression of one word, for DuckDB.
_WORD = "[^\\x20\\x09-\\x0D]+"

_OP6 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
           FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""


def _op7() -> str:
    """The rules over brute-force counts; thresholds by exact quantiles of the same grids."""
    values = ", ".join(f"({i}, '{r}', {slack}, {str(low).lower()})" for i, (r, (slack, low)) in enumerate(RATIOS.items()))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, lang, source, t,
         list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls
  FROM d),
tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, k) >= 2),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, lang, source, len(ws) AS n_words,
         length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.rid = w.rid),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length,
         CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats
  FROM c),
u AS (UNPIVOT (SELECT rid, lang, source, n_words, word_length::BIGINT AS word_length, symbols::BIGINT AS symbols,
                      dup_lines::BIGINT AS dup_lines, repeats::BIGINT AS repeats FROM r)
      ON word_length, symbols, dup_lines, repeats INTO NAME ratio VALUE step),
g AS (
  SELECT 0 AS wide, lang, source, ratio, step FROM u WHERE n_words > 0
  UNION ALL SELECT 1, lang, NULL, ratio, step FROM u WHERE n_words > 0
  UNION ALL SELECT 2, NULL, NULL, ratio, step FROM u WHERE n_words > 0),
q AS (
  SELECT wide, lang, source, ratio, count(*) AS n, quantile_disc(step, 0.5) AS mid,
         quantile_disc(step, 0.75) AS upper, quantile_disc(step, 0.25) AS lower
  FROM g GROUP BY ALL),
f AS (
  SELECT wide, lang, source, q.ratio, n, place, mid + {REACH} * (upper - mid) + slack AS high,
         CASE WHEN low_too THEN mid - {REACH} * (mid - lower) - slack ELSE -1 END AS low
  FROM q JOIN (VALUES {values}) AS x(place, ratio, slack, low_too) ON x.ratio = q.ratio),
v AS (
  SELECT u.rid, min(CASE WHEN step > h.high OR step < h.low THEN h.place END) AS broken
  FROM u LEFT JOIN LATERAL (
    SELECT place, high, low FROM f
    WHERE f.ratio = u.ratio AND (wide = 2 OR n >= {MIN_ROWS})
      AND (wide > 0 OR f.source IS NOT DISTINCT FROM u.source) AND (wide = 2 OR f.lang IS NOT DISTINCT FROM u.lang)
    ORDER BY wide LIMIT 1) h ON true
  GROUP BY u.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND broken IS NULL AS kept,
       CASE broken {" ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RATIOS))} END AS rule_failed
FROM r JOIN v USING (rid)
"""


#: CRC-32 of the bytes ``bs`` (a list of numbers) by its table, which DuckDB builds from the polynomial.
_CRC_TABLE = "[list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR n IN range(256)]"


def _crc(bs: str, table: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bs}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


_OP11 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.other)::INTEGER AS rank,
       s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""

#: Numbers of a text's UTF-8 bytes, from its hexadecimal form.
_UTF8 = "[instr('0123456789ABCDEF', h[1]) * 16 + instr('0123456789ABCDEF', h[2]) - 17 FOR h IN regexp_extract_all(hex(encode(t)), '..')]"

_OP12 = rf"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + {ROW_BYTES} AS size,
         ('0x' || left(md5(coalesce(text, '')), 15))::BIGINT AS k1, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS k2 FROM documents),
c AS MATERIALIZED (SELECT *, (sum(size) OVER (ORDER BY k1, k2, rid ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM d),
a AS MATERIALIZED (SELECT max(upto) AS total, max(size) AS largest FROM c),
b AS (SELECT 0 AS pos, true AS whole UNION ALL SELECT upto, lead(k1) OVER (ORDER BY upto) IS DISTINCT FROM k1 FROM c),
n AS (
  SELECT i, total, largest, arg_min(pos, (abs(pos * {SHARDS} - i * total), pos)) AS row_at,
         arg_min(pos, (abs(pos * {SHARDS} - i * total), pos)) FILTER (whole) AS group_at
  FROM b, a, range(1, {SHARDS}) AS x(i) GROUP BY ALL),
s AS (
  SELECT i, max(CASE WHEN {2 * NEAR} * abs(group_at * {SHARDS} - i * total) <= greatest({NEAR * SHARDS} * largest, total) THEN group_at ELSE row_at END)
              OVER (ORDER BY i) AS pos FROM n),
p AS (SELECT c.*, (SELECT count(*) FROM s WHERE s.pos <= c.upto - c.size)::INTEGER AS shard FROM c)
SELECT doc_id, size, {_crc(_UTF8.replace("(t)", "(p.t)"), "crc.t")} AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY k1, k2, rid) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM p, crc
"""

_OP13 = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source,
         [CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END FOR v IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR]].array_to_string('') AS head,
         text, {_crc("[ord(x) FOR x IN string_split(doc_id::VARCHAR, '')]", "crc.t")} % 2 = 0 AS chosen
  FROM documents, crc),
l AS MATERIALIZED (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN chosen THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other
  FROM d),
r AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
up(level, source, i, n, h) AS (
  SELECT 0, source, i, n, leaf FROM r
  UNION ALL SELECT level + 1, source, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY level, source, i // 3),
s AS MATERIALIZED (SELECT source, level, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
over_all(level, i, n, h) AS (
  SELECT 0, i, n, h FROM s
  UNION ALL SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM over_all WHERE n > 1 GROUP BY level, i // 3),
steps AS MATERIALIZED (
  SELECT r.rid, u.level AS step, string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < r.i // pow(3, u.level)::BIGINT) AS lefts,
         string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > r.i // pow(3, u.level)::BIGINT) AS rights
  FROM r JOIN up u ON u.source IS NOT DISTINCT FROM r.source AND u.n > 1 AND u.i // 3 = r.i // pow(3, u.level + 1)::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT r.rid, s.level + o.level, string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < s.i // pow(3, o.level)::BIGINT),
         string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > s.i // pow(3, o.level)::BIGINT)
  FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source JOIN over_all o ON o.n > 1 AND o.i // 3 = s.i // pow(3, o.level + 1)::BIGINT
  GROUP BY ALL),
folds(rid, step, h) AS (
  SELECT rid, 0, coalesce(other, leaf) FROM r
  UNION ALL SELECT f.rid, f.step + 1, sha256(coalesce(lefts, '') || f.h || coalesce(rights, '')) FROM folds f JOIN steps USING (rid, step)),
ends AS (SELECT rid, arg_max(h, step) AS h FROM folds GROUP BY rid),
proofs AS (SELECT rid, string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' ORDER BY step) AS p FROM steps GROUP BY rid)
SELECT r.doc_id, leaf, s.h AS subroot, o.h AS root, sha256(coalesce(p, '')) AS proof_sha256, e.h AS folded_root, e.h = o.h AS verified
FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source JOIN over_all o ON o.n = 1 JOIN ends e ON e.rid = r.rid LEFT JOIN proofs p ON p.rid = r.rid
"""


def queries() -> dict:
    return {
        "op1_quality_model": op1_quality_model,
        "op2_language_id": op2_language_id,
        "op3_license_scan": op3_license_scan,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_secret_scan": op5_secret_scan,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_source_mix": op9_source_mix,
        "op10_near_dedup": op10_near_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_histogram_sort": op12_histogram_sort,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict:
    return {"op6_exact_dedup": _OP6, "op7_quality_rules": _op7(), "op11_hard_negatives": _OP11, "op12_histogram_sort": _OP12, "op13_merkle_manifest": _OP13}
