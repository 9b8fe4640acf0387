"""Each message once: what was seen is state of the stream, so a batch's work doesn't grow with the archive.

Mail is keyed by its canonical id; the first of an id goes on, later ones end here. State is
kept for ``days`` after the first arrival, or for ever; with an expiry, mail that comes again after it
is archived again, and :func:`archived_messages` reads it once. A batch that is repeated starts from
the state before it, so the same mail goes on and the same folders are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailweave.sources.mail import keyed_mail
from mailweave.streaming.ingest import archive_batch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstArrival(StatefulProcessor):
    """Lets the row with the least path of the first batch of a key through."""

    def __init__(self, days: int | None) -> None:
        self.ttl = None if days is None else days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "path string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: r["path"], default=None)
        if first is not None:
            self.seen.update((first["path"],))
            yield first

    def close(self) -> None:
        pass


def first_arrivals(raw: DataFrame, days: int | None = None) -> DataFrame:
    """(path, content) of the first of each message of a stream; what has no id goes through by its path."""
    keyed = keyed_mail(raw)
    kept = keyed.groupBy("key").transformWithState(FirstArrival(days), keyed.schema, "Append", "None" if days is None else "ProcessingTime")
    return kept.select("path", "content")


def archive_once(spark: SparkSession, raw: DataFrame, out: str, checkpoint: str, days: int | None = None, after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Archive everything that a stream (path, content) has now, each message once; then stop.

    ``after`` is called with the messages of every batch that archived some, once they are written.
    """
    write = archive_batch(out, known=True)

    def batch(rows: DataFrame, number: int) -> None:
        fresh = write(rows, number)
        if after is not None and fresh.limit(1).count():
            after(fresh, number)

    first = first_arrivals(raw, days)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # state variables need it; the stream takes the setting when it starts
    try:
        query = first.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()


def archived_messages(spark: SparkSession, out: str) -> DataFrame:
    """Messages of all batches, each once, the one of the earliest batch."""
    rows = spark.read.parquet(f"{out}/messages")
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*columns), "batch").alias("m")).select("m.*")
