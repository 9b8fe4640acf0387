"""Catalogue of report queries over ground truth and the derived layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.operators.algebra import collect_distinct, top, total
from mailweave.tables import Archive, has_id

#: Bounds and default of a listing; a message with more addressed is counted as wide.
MOST_ROWS, DEFAULT_ROWS, WIDEST = 5000, 50, 25


def clamp(limit: int | None) -> int:
    return min(max(DEFAULT_ROWS if limit is None else limit, 1), MOST_ROWS)


def addressed(a: Archive) -> DataFrame:
    """message_id and the sorted distinct To and Cc addresses."""
    return a.recipients.filter(F.col("role").isin("TO", "CC")).groupBy("message_id").agg(collect_distinct(F.col("address_id")).alias("people"))


def co_recipients(a: Archive, limit: int = DEFAULT_ROWS) -> DataFrame:
    """Pairs addressed together, by number of messages; one per message however often it names them."""
    # a join, not arrays of pairs: a message may be addressed to any number of people
    on = a.recipients.filter(F.col("role").isin("TO", "CC")).select("message_id", F.col("address_id").alias("left")).distinct()
    pairs = on.join(on.withColumnRenamed("left", "right"), "message_id").filter("left < right").groupBy("left", "right")
    return top(pairs.agg(F.count("*").alias("messages")), F.desc("messages"), F.asc("left"), F.asc("right"), limit=clamp(limit))


def addressed_pairs(a: Archive, widest: int | None = None) -> DataFrame:
    """The derived pairs of all messages, or of those with at most ``widest`` addressed.

    A message's pairs come out one by one, beside one address after the other, so that no array of them is made.
    """
    people = addressed(a)
    narrow = people if widest is None else people.filter(F.size("people") <= widest)
    each = narrow.join(a.messages.select("id", "sent_at"), F.col("message_id") == F.col("id")).select("sent_at", "people", F.posexplode("people").alias("at", "left"))
    after = F.slice("people", F.col("at") + 2, F.greatest(F.size("people"), F.lit(1)))
    return (
        each.filter(F.col("at") + 1 < F.size("people")).select("sent_at", "left", F.explode(after).alias("right")).groupBy("left", "right")
        .agg(F.count("*").alias("count"), F.min("sent_at").alias("first_seen"), F.max("sent_at").alias("last_seen"))
    )


def wide_messages(a: Archive, widest: int = WIDEST) -> DataFrame:
    return addressed(a).agg(F.count_if(F.size("people") > widest).alias("wide"))


def top_pairs(pairs: DataFrame, limit: int = DEFAULT_ROWS) -> DataFrame:
    return top(pairs, F.desc("count"), F.asc("left"), F.asc("right"), limit=clamp(limit))


def agreement(definition: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """How the heaviest defined and stored pairs compare, counted by verdict.

    Each side shows its ``limit`` heaviest pairs; a pair that only one side shows is judged only
    if it is heavier than everything the other side cut off.
    """
    d = top(definition, F.desc("count"), F.asc("left"), F.asc("right"), limit=limit).select("left", "right", F.col("count").alias("defined"))
    s = top(stored, F.desc("count"), F.asc("left"), F.asc("right"), limit=limit).select("left", "right", F.col("count").alias("held"))
    floor = lambda x, c: x.agg(F.when(F.count("*") >= limit, F.min(c)).alias(f"{c}_floor"))
    # the floors are one row each
    both = d.join(s, ["left", "right"], "full").join(F.broadcast(floor(d, "defined"))).join(F.broadcast(floor(s, "held")))
    verdict = (
        F.when(F.col("defined") == F.col("held"), "matched")
        .when(F.col("defined").isNotNull() & F.col("held").isNotNull(), "count_mismatch")
        .when(F.col("held").isNull() & (F.col("held_floor").isNull() | (F.col("defined") > F.col("held_floor"))), "truth_only")
        .when(F.col("defined").isNull() & (F.col("defined_floor").isNull() | (F.col("held") > F.col("defined_floor"))), "edge_only")
        .otherwise("unjudged")
    )
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("pairs"))


def participants(a: Archive) -> DataFrame:
    """message_id, people (all roles) and their key."""
    from mailweave.functions.text import participant_key

    people = a.recipients.groupBy("message_id").agg(collect_distinct(F.col("address_id")).alias("people"))
    return people.withColumn("participant_key", participant_key(F.col("people")))


def recurring_groups(a: Archive, min_size: int = 3, min_messages: int = 2) -> DataFrame:
    """Groups of participants that meet again: size, messages, first and last date."""
    sent = participants(a).join(a.messages.select("id", "sent_at"), F.col("message_id") == F.col("id"))
    groups = sent.groupBy("participant_key").agg(
        F.max(F.size("people")).cast("long").alias("size"), F.count("*").alias("message_count"),
        F.min("sent_at").alias("first_seen"), F.max("sent_at").alias("last_seen"),
    )
    return groups.filter((F.col("participant_key") != "") & (F.col("size") >= min_size) & (F.col("message_count") >= min_messages))


def archived_per_day(a: Archive, limit: int = MOST_ROWS) -> DataFrame:
    """Copies (not messages) and bytes of each UTC day, newest first."""
    days = a.copies.filter("archived_at is not null").groupBy(F.to_date("archived_at").alias("day"))
    return top(days.agg(F.count("*").alias("copies"), total(F.col("size_bytes")).alias("bytes")), F.desc("day"), limit=clamp(limit))


def archived_calendar(a: Archive, today: str, days: int = 14) -> DataFrame:
    """Exactly ``days`` days up to ``today``; days without a copy count 0."""
    spark = a.copies.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date"))).alias("day"))
    found = archived_per_day(a)
    return calendar.join(found, "day", "left").select("day", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def totals(**tables: DataFrame) -> DataFrame:
    """One row per table: name and rows."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def message_relations(a: Archive) -> DataFrame:
    """Per message: senders, addressed, blind_copied, threads and attachments, each sorted.

    One pass over recipients; each branch is aggregated before it is joined.
    """
    of = lambda *roles: collect_distinct(F.when(F.col("role").isin(*roles), F.col("address_id")))
    people = a.recipients.groupBy(F.col("message_id").alias("id")).agg(
        of("FROM").alias("senders"), of("TO", "CC").alias("addressed"), of("BCC").alias("blind_copied")
    )
    threads = a.message_threads.groupBy(F.col("message_id").alias("id")).agg(collect_distinct(F.col("thread_id")).alias("threads"))
    files = a.message_attachments.groupBy(F.col("message_id").alias("id")).agg(collect_distinct(F.col("sha")).alias("attachments"))
    rows = a.messages.select("id").join(people, "id", "left").join(threads, "id", "left").join(files, "id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "id", *[F.coalesce(c, none).alias(c) for c in ("senders", "addressed", "blind_copied", "threads")],
        F.coalesce(F.col("attachments").cast("array<string>"), none).alias("attachments"),
    )


def message_signals(a: Archive) -> DataFrame:
    """Per message: To line, number and authors of replies, labels, attachments."""
    to = a.recipients.filter("role = 'TO'").groupBy(F.col("message_id").alias("id")).agg(collect_distinct(F.col("address_id")).alias("sent_to"))
    authors = a.recipients.filter("role = 'FROM'").select(F.col("message_id").alias("child"), "address_id")
    answers = (
        a.replies.join(authors, "child", "left").groupBy(F.col("parent").alias("id"))
        .agg(F.count_distinct("child").alias("reply_count"), collect_distinct(F.col("address_id")).alias("replied_by"))
    )
    labels = a.message_labels.groupBy(F.col("message_id").alias("id")).agg(collect_distinct(F.col("name")).alias("label_names"))
    files = a.message_attachments.select(F.col("message_id").alias("id")).distinct().withColumn("has_attachments", F.lit(True))
    none = F.array().cast("array<string>")
    return (
        a.messages.select("id").join(to, "id", "left").join(answers, "id", "left").join(labels, "id", "left").join(files, "id", "left")
        .select(
            "id", F.coalesce("sent_to", none).alias("sent_to"), F.coalesce("reply_count", F.lit(0)).alias("reply_count"),
            F.coalesce("replied_by", none).alias("replied_by"), F.coalesce("label_names", none).alias("label_names"),
            F.coalesce("has_attachments", F.lit(False)).alias("has_attachments"),
        )
    )


def message_bodies(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, body_clean) of some messages."""
    return messages.join(ids.select("id").distinct(), "id", "left_semi").select("id", "body_clean")


def message_texts(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of some messages, whole: subject and body as analyses read them."""
    return messages.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.concat_ws("\n\n", F.col("subject_norm"), F.col("body_clean")).alias("text"))


def unidentified(a: Archive) -> DataFrame:
    return a.messages.agg(F.count_if(~has_id(F.col("id"))).alias("unidentified"), F.count("*").alias("messages"))


def parents(a: Archive) -> DataFrame:
    """One parent of each reply: the smallest."""
    return a.replies.groupBy("child").agg(F.min("parent").alias("parent"))


def facts(a: Archive) -> DataFrame:
    """The working record of the analyses: one row per identified message."""
    own = a.accounts.select(F.lower(F.trim("address")).alias("sender")).distinct().withColumn("outbound", F.lit(True))
    rel = message_relations(a.identified())
    keyed = participants(a).select(F.col("message_id").alias("id"), F.col("people").alias("participants"), "participant_key")
    messages = a.identified().messages
    refs = F.coalesce("refs", F.array().cast("array<string>")) if "refs" in messages.columns else F.array().cast("array<string>")
    base = messages.select("id", "sent_at", "subject_norm", refs.alias("refs"))
    return (
        base.join(rel, "id").join(keyed, "id", "left")
        .withColumn("sender", F.array_min("senders")).withColumn("thread_id", F.array_min("threads"))
        .join(own, "sender", "left")
        .select(
            "id", "sent_at", "subject_norm", "refs", "sender", "addressed", "blind_copied", "attachments", "thread_id",
            F.coalesce("participants", F.array().cast("array<string>")).alias("participants"),
            F.coalesce("participant_key", F.lit("")).alias("participant_key"), F.coalesce("outbound", F.lit(False)).alias("outbound"),
        )
    )


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)
