"""Incremental ingest by Structured Streaming: new .eml files, parsed and merged by canonical id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.sources.mail import blobs, ground_truth, parsed_messages

RAW = "path string, modificationTime timestamp, length long, content binary"


def eml_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw messages as they arrive; the checkpoint holds what was seen, the bound is the back-pressure."""
    return (
        spark.readStream.format("binaryFile").schema(RAW).option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "content")
    )


def archive_batch(out: str, known: bool = False):
    """Sink of a micro-batch, which returns its messages. Each table has one folder per batch, which a replay overwrites.

    Messages whose id an earlier batch holds are left out, so at-least-once delivery archives once;
    with ``known`` the stream has seen to that.
    """

    def write(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        parsed = parsed_messages(batch).persist()
        put = lambda name, df: df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        try:
            good = parsed.filter("error is null").dropDuplicates(["id"])
            # kept by id, so that no table of these messages is deduplicated or joined anew
            fresh = (good if known else _unseen(spark, out, number, good)).persist()
            try:
                tables = ground_truth(fresh)
                put("dead_letters", parsed.filter("error is not null").select("path", "error"))
                for name in ("recipients", "message_threads", "message_attachments"):
                    put(name, tables[name])
                # replies hold the raw parent; they are resolved on reading, so order of arrival doesn't matter
                answers = parsed.filter("error is null and in_reply_to is not null").select(F.col("id").alias("child"), "in_reply_to").distinct()
                put("reply_links", answers.join(fresh.select(F.col("id").alias("child")), "child", "left_semi"))
                put("addresses", ground_truth(good)["addresses"])
                put("blobs", blobs(batch))
                put("messages", tables["messages"])
            finally:
                fresh.unpersist()
        finally:
            parsed.unpersist()
        return spark.read.parquet(f"{out}/messages/batch={number}")

    return write


def _unseen(spark: SparkSession, out: str, number: int, messages: DataFrame) -> DataFrame:
    """The messages whose id no other batch holds; only the id column is read."""
    try:
        known = spark.read.parquet(f"{out}/messages").filter(F.col("batch") != number).select("id")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return messages  # nothing is archived yet
    return messages.join(known, "id", "left_anti")


def archived_addresses(spark: SparkSession, out: str) -> DataFrame:
    """(id, display_names) over all batches."""
    rows = spark.read.parquet(f"{out}/addresses").select("id", F.explode_outer("display_names").alias("name"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("display_names"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Take everything that arrived since the last call, then stop."""
    query = (
        eml_stream(spark, folder, files_per_batch).writeStream.foreachBatch(archive_batch(out))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def copies_per_window(copies: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Copies and bytes of each window of a stream (or table) with archived_at and size_bytes."""
    return (
        copies.withWatermark("archived_at", late).groupBy(F.window("archived_at", window).alias("w"))
        .agg(F.count("*").alias("copies"), F.sum("size_bytes").alias("bytes"))
        .select(F.col("w.start").alias("start"), "copies", "bytes")
    )
