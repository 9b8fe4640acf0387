"""The archive's ground truth as DataFrames, and the adapter from the driver's star schema.

Ground truth is one table per node kind and per edge kind. All three recipient edges and the
sender edge are one ``recipients`` table with a ``role``, so an alternation of edges is a filter.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROLES = ("FROM", "TO", "CC", "BCC")
#: Edge names by role, as the explorer shows them.
EDGE_OF_ROLE = {"FROM": "SENT_FROM", "TO": "SENT_TO", "CC": "COPIED_TO", "BCC": "BLIND_COPIED_TO"}


@dataclass(frozen=True)
class Archive:
    """Named tables; ids may be of any orderable type, the same one throughout."""

    messages: DataFrame  # id, subject_norm, sent_at, size_bytes, body_text
    recipients: DataFrame  # message_id, address_id, role
    addresses: DataFrame  # id, domain, name
    accounts: DataFrame  # address
    message_threads: DataFrame  # message_id, thread_id
    replies: DataFrame  # child, parent
    message_labels: DataFrame  # message_id, name
    message_attachments: DataFrame  # message_id, sha, filename, content_type, content_id
    copies: DataFrame  # message_id, account, archived_at, size_bytes
    message_tags: DataFrame  # message_id, tag_id, source
    vectors: DataFrame  # id, model, vector

    def identified(self) -> Archive:
        """Messages without an id (null or empty) are left out everywhere."""
        return replace(self, messages=self.messages.filter(has_id(F.col("id"))))


def has_id(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def driver_archive(spark: SparkSession, sf_dir: str) -> Archive:
    """Orders as messages, customers as senders, suppliers as recipients, parts as attachments."""

    def t(name: str) -> DataFrame:
        return load(spark, sf_dir, name)

    orders, lines = t("orders"), t("lineitem")
    nation = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("domain"))
    sender = F.concat(F.lit("c"), "o_custkey")
    role = F.when(F.col("l_returnflag") == "N", "TO").when(F.col("l_returnflag") == "R", "CC").otherwise("BCC")
    to = lines.select(
        F.col("l_orderkey").alias("message_id"), F.concat(F.lit("s"), "l_suppkey").alias("address_id"), role.alias("role")
    ).distinct()
    people = [
        t(table).join(F.broadcast(nation), F.col(f"{p}_nationkey") == F.col("k")).select(  # 25 nations
            F.concat(F.lit(mark), f"{p}_{key}").alias("id"), "domain", F.col(f"{p}_name").alias("name")
        )
        for table, p, mark, key in (("customer", "c", "c", "custkey"), ("supplier", "s", "s", "suppkey"))
    ]
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    parts = t("part").select("p_partkey", "p_name", "p_type")
    labels = t("labels")
    tag = lambda column, name: labels.filter(F.col(column) == 1).select(
        F.col("doc_id").alias("message_id"), F.lit(name).alias("tag_id"), F.lit("manual").alias("source")
    )
    return Archive(
        messages=orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderpriority").alias("subject_norm"),
            F.col("o_orderdate").alias("sent_at"),
            F.floor("o_totalprice").cast("long").alias("size_bytes"),
        ),
        recipients=orders.select(
            F.col("o_orderkey").alias("message_id"), sender.alias("address_id"), F.lit("FROM").alias("role")
        ).unionByName(to),
        addresses=people[0].unionByName(people[1]),
        accounts=t("customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("address")),
        message_threads=orders.select(F.col("o_orderkey").alias("message_id"), F.concat(F.lit("t"), "o_custkey").alias("thread_id")),
        replies=orders.select(F.col("o_orderkey").alias("child"), before.alias("parent")).filter("parent is not null and child % 2 = 0"),
        message_labels=orders.select(F.col("o_orderkey").alias("message_id"), F.col("o_orderstatus").alias("name")),
        message_attachments=lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
            F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("sha"), F.col("p_name").alias("filename"),
            F.col("p_type").alias("content_type"), F.lit(None).cast("string").alias("content_id"),
        ).distinct(),
        copies=t("events").select(
            F.col("event_id").alias("message_id"), F.col("user_id").alias("account"), F.col("ts").alias("archived_at"),
            F.floor("value").cast("long").alias("size_bytes"),
        ),
        message_tags=tag("quality", "tag:good").unionByName(tag("toxic", "tag:toxic")),
        vectors=t("embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("m"), "label").alias("model"), F.col("embedding").alias("vector")),
    )
