"""Archive listing: structured filters, full-text search by postings, facets, conversations and grouping."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailweave.functions.files import SHRUG_TYPES, file_family
from mailweave.functions.text import searchable_terms
from mailweave.operators.algebra import top
from mailweave.session import measured
from mailweave.tables import Archive

# BM25 parameters; messages of a thread shown.
K1, B = 1.2, 0.75
THREAD_CAP = 200


class NothingToSearch(ValueError):
    """The text of a search holds no word."""


@dataclass(frozen=True)
class Filters:
    text: str = ""
    senders: list = field(default_factory=list)
    recipients: list = field(default_factory=list)
    recipients_all: bool = False
    account: object = None
    sent_from: str | None = None
    sent_until: str | None = None
    has_attachments: bool | None = None
    content_types: list = field(default_factory=list)
    filenames: list = field(default_factory=list)
    families: list = field(default_factory=list)

    @property
    def structured(self) -> bool:
        return any((
            self.senders, self.recipients, self.account is not None, self.sent_from, self.sent_until, self.has_attachments is not None,
            self.content_types, self.filenames, self.families,
        ))


def apply_filters(a: Archive, rows: DataFrame, f: Filters) -> DataFrame:
    """All filters at once, as semi-joins, so no row multiplies. ``rows`` has id and sent_at."""
    ids = lambda df: df.select(F.col("message_id").alias("id")).distinct()
    if f.senders:
        rows = rows.join(ids(a.recipients.filter((F.col("role") == "FROM") & F.col("address_id").isin(f.senders))), "id", "left_semi")
    if f.recipients:
        hit = a.recipients.filter(F.col("role").isin("TO", "CC") & F.col("address_id").isin(f.recipients))
        if f.recipients_all:
            hit = hit.groupBy("message_id").agg(F.count_distinct("address_id").alias("n")).filter(F.col("n") == len(set(f.recipients)))
        rows = rows.join(ids(hit), "id", "left_semi")
    if f.account is not None:
        rows = rows.join(ids(a.copies.filter(F.col("account") == f.account)), "id", "left_semi")
    wall = F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss")  # compared as text, as the archive holds it
    if f.sent_from:
        rows = rows.filter(wall >= f.sent_from)
    if f.sent_until:
        rows = rows.filter(wall <= (f.sent_until if "T" in f.sent_until else f.sent_until + "T23:59:59"))
    carried = a.message_attachments.filter("filename is not null or content_id is null")
    if f.has_attachments is not None:
        rows = rows.join(ids(carried), "id", "left_semi" if f.has_attachments else "left_anti")
    if f.content_types or f.filenames or f.families:
        # a type with % is a pattern
        plain, patterns = [t for t in f.content_types if "%" not in t], [t for t in f.content_types if "%" in t]
        hit = [F.col("content_type").isin(plain), F.col("filename").isin(f.filenames), *[F.col("content_type").like(p) for p in patterns]]
        if f.families:
            hit.append(file_family(F.col("content_type"), F.col("filename")).isin(f.families))
        rows = rows.join(ids(carried.filter(reduce(lambda x, y: x | y, hit))), "id", "left_semi")
    return rows


def newest(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return top(rows, F.desc_nulls_last("sent_at"), F.asc("id"), limit=limit, offset=offset)


def find_filtered(a: Archive, f: Filters, limit: int = 50, offset: int = 0) -> DataFrame:
    return newest(apply_filters(a, a.messages.select("id", "sent_at", "subject_norm"), f), limit, offset)


def count_filtered(a: Archive, f: Filters) -> DataFrame:
    return apply_filters(a, a.messages.select("id", "sent_at"), f).agg(F.count("*").alias("total"))


def find_recent(a: Archive, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest messages with their sender; a message without one is listed too."""
    page = newest(a.messages.select("id", "sent_at", "subject_norm"), limit, offset)
    sender = a.recipients.filter("role = 'FROM'").select(F.col("message_id").alias("id"), F.col("address_id").alias("sender"))
    return page.join(sender, "id", "left").groupBy("id", "sent_at", "subject_norm").agg(F.min("sender").alias("sender"))


def postings(texts: DataFrame) -> DataFrame:
    """Inverted index (term, id, tf, n) of texts (id, text); n is the text's length in terms."""
    # texts are dealt by id, so that a text's postings are counted where it lies; postings are several times its size
    terms = texts.select("id", "text").repartition("id").select("id", searchable_terms(F.col("text")).alias("t"))
    terms = terms.select("id", F.size("t").alias("n"), F.explode("t").alias("term"))
    return terms.groupBy("term", "id", "n").agg(F.count("*").alias("tf"))


def full_text(index: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """(id, score): BM25 of texts that hold every word of the query, best first."""
    words = sorted({x.lower() for x in re.findall(r"[^\W_]+", query)})
    if not words:
        raise NothingToSearch(query)
    # a text's shares tf / n add up to one, so the pass that takes the words' postings counts texts and their mean length too
    hit, seen = measured(
        index, F.col("term").isin(words), docs=F.coalesce(F.round(F.sum(F.col("tf") / F.col("n"))), F.lit(0.0)), tokens=F.coalesce(F.sum("tf"), F.lit(0))
    )
    docs, mean = F.lit(seen["docs"]), F.lit(seen["tokens"] / max(seen["docs"], 1))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # a row per query word
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean))
    rows = hit.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(idf * tf).alias("score"), F.count("*").alias("k"))
    rows = rows.filter(F.col("k") == len(words)).select("id", F.round("score", 6).alias("score"))
    return rows if limit is None else top(rows, F.desc("score"), F.asc("id"), limit=limit)


def scaled(page: DataFrame) -> DataFrame:
    """Scores as shares of the best of the page."""
    best = page.agg(F.max("score").alias("best"))
    return page.join(F.broadcast(best)).select("id", F.when(F.col("best") > 0, F.round(F.col("score") / F.col("best"), 6)).otherwise(0.0).alias("score"))  # one row


def search(a: Archive, f: Filters, index: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Nothing asked: newest. Words: by relevance, filters after the hit. Else: filtered, newest first."""
    if f.text.strip():
        hits = full_text(index, f.text, None)
        rows = apply_filters(a, a.messages.select("id", "sent_at").join(hits, "id"), f)
        return top(rows, F.desc("score"), F.asc("id"), limit=limit, offset=offset)
    return find_filtered(a, f, limit, offset) if f.structured else find_recent(a, limit, offset)


def facet_addresses(a: Archive, roles: tuple[str, ...], limit: int = 50) -> DataFrame:
    rows = a.recipients.filter(F.col("role").isin(*roles)).groupBy("address_id").agg(F.count_distinct("message_id").alias("messages"))
    return top(rows, F.desc("messages"), F.asc("address_id"), limit=limit)


def facet_content_types(a: Archive, limit: int = 50) -> DataFrame:
    rows = a.message_attachments.filter(~F.col("content_type").isin(*SHRUG_TYPES)).groupBy("content_type").agg(F.count_distinct("message_id").alias("messages"))
    return top(rows, F.desc("messages"), F.asc("content_type"), limit=limit)


def facet_untyped_names(a: Archive, limit: int = 50) -> DataFrame:
    rows = a.message_attachments.filter(F.col("content_type").isNull() | F.col("content_type").isin(*SHRUG_TYPES)).groupBy("filename").agg(F.count_distinct("message_id").alias("messages"))
    return top(rows, F.desc("messages"), F.asc("filename"), limit=limit)


def facet_families(a: Archive) -> DataFrame:
    """Messages by family of what they carry, commonest first."""
    family = file_family(F.col("content_type"), F.col("filename")).alias("family")
    return a.message_attachments.groupBy(family).agg(F.count_distinct("message_id").alias("messages")).orderBy(F.desc("messages"), "family")


def recipients_of(a: Archive, ids: DataFrame) -> DataFrame:
    """(id, address_id): who each message of a page is to; copies don't count."""
    rows = a.recipients.filter("role = 'TO'").join(ids.select(F.col("id").alias("message_id")).distinct(), "message_id", "left_semi")
    return rows.select(F.col("message_id").alias("id"), "address_id").distinct()


def labels_of(a: Archive, ids: DataFrame) -> DataFrame:
    """(id, labels): user labels before folders before system ones, then by name."""
    rank = F.when(F.col("kind") == "user", 0).when(F.col("kind") == "folder", 1).otherwise(2) if "kind" in a.message_labels.columns else F.lit(2)
    rows = a.message_labels.join(ids.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    return rows.groupBy(F.col("message_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct(rank.alias("r"), F.lower("name").alias("l"), "name"))).alias("x")).select("id", F.col("x.name").alias("labels"))


def conversations_of(a: Archive, ids: DataFrame) -> DataFrame:
    """(id, thread_id, size) of some messages: smallest thread of each, and how many messages it holds."""
    mine = a.message_threads.join(ids.select(F.col("id").alias("message_id")), "message_id", "left_semi").groupBy(F.col("message_id").alias("id")).agg(F.min("thread_id").alias("thread_id"))
    size = a.message_threads.join(mine.select("thread_id").distinct(), "thread_id", "left_semi").groupBy("thread_id").agg(F.count_distinct("message_id").alias("size"))
    return mine.join(size, "thread_id").select("id", "thread_id", "size")


def conversation_members(a: Archive, threads: DataFrame, cap: int = THREAD_CAP) -> DataFrame:
    """(thread_id, id, place): newest first, undated last, at most ``cap`` of each thread."""
    rows = a.message_threads.join(threads, "thread_id", "left_semi").select("thread_id", F.col("message_id").alias("id")).distinct().join(a.messages.select("id", "sent_at"), "id")
    place = F.row_number().over(W.partitionBy("thread_id").orderBy(F.desc_nulls_last("sent_at"), "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= cap).select("thread_id", "id", "place")


def thread_reading(a: Archive, thread, limit: int = THREAD_CAP) -> DataFrame:
    """A thread oldest first with its place, and in ``truncated`` whether it goes on; one job."""
    rows = a.message_threads.filter(F.col("thread_id") == thread).select(F.col("message_id").alias("id")).distinct().join(a.messages, "id")
    page = top(rows, F.asc_nulls_last("sent_at"), F.asc("id"), limit=limit + 1)
    placed = page.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_last("sent_at"), "id")))  # a page
    return placed.withColumn("truncated", F.count("*").over(W.partitionBy()) > limit).filter(F.col("place") <= limit)


def memberships(a: Archive, page: DataFrame, mode: str, **found: DataFrame) -> DataFrame:
    """(id, group) of the rows of a page under one of the groupings; a row that no group holds is absent.

    ``topic`` reads topic_members (topic_id, id), ``recurring`` group_members (participant_key, id).
    Of several groups the smallest is taken.
    """
    ids = page.select("id").distinct()
    of = lambda df, key, group: df.select(F.col(key).alias("id"), F.col(group).cast("string").alias("group"))
    rows = {
        "none": lambda: of(ids, "id", "id"),
        "conversation": lambda: of(a.message_threads, "message_id", "thread_id"),
        "topic": lambda: of(found["topic_members"], "id", "topic_id"),
        "tag": lambda: of(a.message_tags, "message_id", "tag_id"),
        "recurring": lambda: of(found["group_members"], "id", "participant_key"),
        "subject": lambda: of(a.messages, "id", "subject_norm"),
        "sender": lambda: of(a.recipients.filter("role = 'FROM'"), "message_id", "address_id"),
        "receiver": lambda: of(recipients_of(a, ids), "id", "address_id"),
    }[mode]()
    return rows.join(ids, "id", "left_semi").groupBy("id").agg(F.min("group").alias("group"))


def grouped_page(a: Archive, page: DataFrame, mode: str, **found: DataFrame) -> DataFrame:
    """A page (id, position, …) under one of the eight groupings; rows without a group share the empty one."""
    filed = memberships(a, page, mode, **found).withColumnRenamed("group", "filed")
    return grouped(page.join(filed, "id", "left"), F.col("filed")).drop("filed")


def grouped(page: DataFrame, group: Column) -> DataFrame:
    """Page rows (position, …) under groups; a group stands where its first member stood."""
    g = F.coalesce(group, F.lit("")).alias("group")
    rows = page.withColumn("group", g)
    w = W.partitionBy("group")
    return rows.withColumn("group_position", F.min("position").over(w)).withColumn("group_size", F.count("*").over(w)).orderBy("group_position", "position")
