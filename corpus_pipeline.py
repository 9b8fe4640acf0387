"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the columns of the document table, the last
one the packed pieces. ``run`` writes what a stage returns as Parquet and reads it again as the
next stage's documents.

Defined results, for every stage: other columns pass through whatever their names; an empty table
gives no rows. Rows are told apart by doc_id and text, so missing and repeated ids do no harm.

- language: null, empty and letterless texts go, and texts that the identifier rejects; without
  labelled rows every text with letters stays.
- exact: one row stays of the texts that are equal without white space, repeated rows too; null is
  equal to empty.
- near: one row stays of each component by 5-word shingles and 0.8; texts without words all stay.
- mix: a row is repeated as often as the mix takes it, never more than twice; repeated rows share.
- pack: null and empty texts are one piece; each row, repeated ones too, is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailweave.llm.common import documents, materialize
from mailweave.llm.exact_dedup import keep_one_of_equals
from mailweave.llm.language_id import keep_identified
from mailweave.llm.mixing import mixed_documents
from mailweave.llm.near_dedup import keep_one_of_near
from mailweave.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language the identifier rejects."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return keep_one_of_equals(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near-duplicates."""
    return keep_one_of_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their targets."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences."""
    return pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", packed)]

#: SQL can't express the trained, sampled and searched stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
