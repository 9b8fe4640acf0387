"""Annotation layer: tags and memberships that a rebuild never touches, purge and erase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions.text import tag_id
from mailweave.operators.algebra import append_new, delete, set_existing, top
from mailweave.tables import Archive

#: Tables that the rebuild may overwrite; nothing else may be deleted by it.
DERIVED = frozenset(
    "groups group_members co_addressed topics topic_members templates template_members communities community_members community_messages tag_suggestions message_importance address_rank".split()
)
ACCEPT_SCORE = 0.6


def writable(table: str) -> str:
    """The name, if it is one of the derived layer."""
    if table not in DERIVED:
        raise ValueError(f"{table} isn't a derived table")
    return table


def list_tags(tags: DataFrame, memberships: DataFrame) -> DataFrame:
    """(tag_id, messages) of every tag, unused ones too."""
    n = memberships.groupBy("tag_id").agg(F.count_distinct("message_id").alias("messages"))
    return tags.select("tag_id").distinct().join(n, "tag_id", "left").select("tag_id", F.coalesce("messages", F.lit(0)).alias("messages"))


def tags_of(memberships: DataFrame, ids: DataFrame) -> DataFrame:
    return memberships.join(ids.select(F.col("id").alias("message_id")), "message_id", "left_semi").select("message_id", "tag_id").distinct()


def tag_messages(memberships: DataFrame, tag: str, ids: DataFrame, source: str = "manual") -> DataFrame:
    """Add members; memberships that exist keep their source."""
    rows = ids.select(F.col("id").alias("message_id"), F.lit(tag).alias("tag_id"), F.lit(source).alias("source"))
    return append_new(memberships, rows, ["message_id", "tag_id"])


def untag(memberships: DataFrame, tag: str, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("id").alias("message_id"), F.lit(tag).alias("tag_id"))
    return memberships.join(gone, ["message_id", "tag_id"], "left_anti")


def create_tag(tags: DataFrame, name: str, color: str | None = None, origin: str = "manual") -> DataFrame:
    """Add a tag under the id of its name; one that exists keeps its properties."""
    if not name.strip():
        raise ValueError("a tag needs a name")
    row = tags.sparkSession.range(1).select(F.lit(name.strip()).alias("name"), F.lit(color).cast("string").alias("color"), F.lit(origin).alias("origin"))
    return append_new(tags, row.withColumn("tag_id", tag_id("name")), ["tag_id"])


def promote(tags: DataFrame, memberships: DataFrame, name: str, members: DataFrame, origin: str = "topic") -> tuple[DataFrame, DataFrame]:
    """A cluster (members: id) becomes a tag: the tag with its origin, and its members as accepted ones."""
    tag = tags.sparkSession.range(1).select(F.lit(name.strip()).alias("name")).select(tag_id("name")).first()[0]
    return create_tag(tags, name, origin=origin), tag_messages(memberships, tag, members.select("id").distinct(), "accepted")


def is_remote_trusted(addresses: DataFrame, address: str) -> bool:
    """Whether remote content of a sender may load; an unknown sender isn't trusted."""
    mine = addresses.filter(F.col("id") == address.strip().lower())
    if "remote_trusted" not in addresses.columns:
        return False
    return bool(mine.filter("remote_trusted").limit(1).count())


def trust_remote(addresses: DataFrame, address: str) -> DataFrame:
    """Record the decision on an address that exists; others stay as they are."""
    known = addresses if "remote_trusted" in addresses.columns else addresses.withColumn("remote_trusted", F.lit(False))
    value = known.sparkSession.range(1).select(F.lit(address.strip().lower()).alias("id"), F.lit(True).alias("remote_trusted"))
    return set_existing(known, value, "id")


def rename_tag(tags: DataFrame, tag: str, name: str) -> DataFrame:
    return tags.withColumn("name", F.when(F.col("tag_id") == tag, name).otherwise(F.col("name")))


def recolor_tag(tags: DataFrame, tag: str, color: str | None) -> DataFrame:
    return tags.withColumn("color", F.when(F.col("tag_id") == tag, F.lit(color).cast("string")).otherwise(F.col("color")))


def delete_tag(tags: DataFrame, memberships: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    return tags.filter(F.col("tag_id") != tag), memberships.filter(F.col("tag_id") != tag)


def accept_suggestions(memberships: DataFrame, suggestions: DataFrame, least: float = ACCEPT_SCORE) -> DataFrame:
    """Opt-in: strong suggestions become memberships of source ``auto``."""
    rows = suggestions.filter(F.col("score") >= least).select(F.col("id").alias("message_id"), "tag_id", F.lit("auto").alias("source"))
    return append_new(memberships, rows, ["message_id", "tag_id"])


def suggestion_counts(tags: DataFrame, suggestions: DataFrame) -> DataFrame:
    n = suggestions.groupBy("tag_id").agg(F.count_distinct("id").alias("suggested"))
    return tags.select("tag_id").distinct().join(n, "tag_id", "left").select("tag_id", F.coalesce("suggested", F.lit(0)).alias("suggested"))


def suggestions_for(suggestions: DataFrame, tag: str, limit: int = 50) -> DataFrame:
    return top(suggestions.filter(F.col("tag_id") == tag), F.desc("score"), F.asc("id"), limit=limit)


def purge_account(a: Archive, account) -> tuple[DataFrame, DataFrame]:
    """(messages that only this account holds, copies that remain)."""
    held = a.copies.groupBy("message_id").agg(F.count_if(F.col("account") != account).alias("elsewhere"), F.count_if(F.col("account") == account).alias("here"))
    gone = held.filter("here > 0 and elsewhere = 0").select(F.col("message_id").alias("id"))
    return gone, a.copies.filter(F.col("account") != account)


def erase_account(a: Archive, account, ledger: DataFrame, running: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Purge, and forget the account's ledger; refused while one of its jobs runs."""
    if running.filter((F.col("account") == account) & (F.col("state") == "running")).limit(1).count():
        raise RuntimeError(f"account {account} is busy")
    gone, copies = purge_account(a, account)
    return delete(a.messages, gone, "id"), copies, ledger.filter(F.col("account") != account)
