"""Subgraph queries: nodes (id, kind, label) and edges (source, target, kind, weight) around a thing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailweave.operators import graph
from mailweave.operators.algebra import top
from mailweave.tables import EDGE_OF_ROLE, Archive


def edge_name():
    return F.element_at(F.create_map(*[F.lit(x) for p in EDGE_OF_ROLE.items() for x in p]), F.col("role"))


def message_addresses(a: Archive, message) -> DataFrame:
    """People on one message with the edge that ties them; blind copies are not shown."""
    return a.recipients.filter((F.col("message_id") == message) & (F.col("role") != "BCC")).select("address_id", edge_name().alias("edge")).distinct()


def thread_siblings(a: Archive, message, limit: int = 200) -> DataFrame:
    """Messages that share a thread with the seed, which is one of them."""
    seed = a.message_threads.filter(F.col("message_id") == message).select("thread_id").distinct()
    rows = a.message_threads.join(seed, "thread_id", "left_semi").select("thread_id", "message_id").distinct()
    return top(rows, F.asc("thread_id"), F.asc("message_id"), limit=limit)


def reply_chain(a: Archive, message, longest: int = 3) -> DataFrame:
    """Undirected reply paths from a message."""
    return graph.paths(a.replies.select(F.col("child").alias("src"), F.col("parent").alias("dst")), message, longest)


def address_neighbours(pairs: DataFrame, address: str, limit: int = 50) -> DataFrame:
    """Who an address is written to together with, heaviest first."""
    both = pairs.select("left", "right", "count").union(pairs.select("right", "left", "count"))
    rows = both.filter(F.col("left") == address).select(F.col("right").alias("neighbour"), "count")
    return top(rows, F.desc("count"), F.asc("neighbour"), limit=limit)


def address_messages(a: Archive, address: str, limit: int = 50) -> DataFrame:
    """Mail of an address with the line that it stands on, newest first."""
    on = a.recipients.filter((F.col("address_id") == address) & (F.col("role") != "BCC"))
    rows = on.join(a.messages.select("id", "sent_at"), F.col("message_id") == F.col("id")).select("id", "sent_at", edge_name().alias("edge"))
    return top(rows, F.desc_nulls_last("sent_at"), F.asc("id"), F.asc("edge"), limit=limit)


def tag_members(a: Archive, tag: str, limit: int = 50) -> DataFrame:
    rows = a.message_tags.filter(F.col("tag_id") == tag).join(a.messages.select("id", "sent_at"), F.col("message_id") == F.col("id"))
    return top(rows.select("id", "sent_at", "source"), F.desc_nulls_last("sent_at"), F.asc("id"), limit=limit)


def topic_participants(a: Archive, members: DataFrame, topic, limit: int = 50) -> DataFrame:
    """People of a topic's messages by number of messages."""
    mine = members.filter(F.col("topic_id") == topic).select(F.col("id").alias("message_id")).distinct()
    rows = a.recipients.filter("role != 'BCC'").join(mine, "message_id", "left_semi")
    return top(rows.groupBy("address_id").agg(F.count_distinct("message_id").alias("messages")), F.desc("messages"), F.asc("address_id"), limit=limit)


def overlap(left: DataFrame, right: DataFrame, limit: int = 50) -> DataFrame:
    """Messages that two kinds of collections share: (left, right, messages) of tables (collection, id)."""
    both = left.select(F.col("collection").alias("left"), "id").distinct().join(right.select(F.col("collection").alias("right"), "id").distinct(), "id")
    return top(both.groupBy("left", "right").agg(F.count("*").alias("messages")), F.desc("messages"), F.asc("left"), F.asc("right"), limit=limit)


@dataclass(frozen=True)
class Subgraph:
    nodes: DataFrame
    edges: DataFrame

    def assembled(self) -> Subgraph:
        """One row per node (first non-empty label), the heavier of equal edges, no dangling edge."""
        nodes = self.nodes.groupBy("id", "kind").agg(F.min(F.when(F.col("label") != "", F.col("label"))).alias("label"))
        edges = self.edges.groupBy("source", "target", "kind").agg(F.max("weight").alias("weight"))
        ids = nodes.select("id").distinct()
        edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        return Subgraph(nodes, edges.select("source", "target", "kind", "weight"))

    def merged_with(self, other: Subgraph) -> Subgraph:
        return Subgraph(self.nodes.unionByName(other.nodes), self.edges.unionByName(other.edges)).assembled()

    def degrees(self) -> DataFrame:
        ends = self.edges.select(F.col("source").alias("id")).union(self.edges.select("target"))
        return self.nodes.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def normalised(self) -> DataFrame:
        """Edges with weights as shares of the heaviest of the picture."""
        most = self.edges.agg(F.max("weight").alias("most"))
        return self.edges.join(F.broadcast(most)).withColumn("weight", F.when(F.col("most") > 0, F.col("weight") / F.col("most")).otherwise(0.0)).drop("most")  # one row

    def within(self, start, depth: int) -> Subgraph:
        """What is at most ``depth`` undirected hops away."""
        both = graph.undirected(self.edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))
        near = graph.breadth_first(both, start, depth).select("id")
        return Subgraph(self.nodes.join(near, "id", "left_semi"), self.edges).assembled()


def message_subgraph(a: Archive, message, limit: int = 200) -> Subgraph:
    """A message, its people, its thread and its replies."""
    text = lambda c: F.col(c).cast("string")
    me = F.lit(str(message))
    people = message_addresses(a, message)
    thread = thread_siblings(a, message, limit)
    chain = reply_chain(a, message).select(F.explode("nodes").alias("id"), "nodes")
    hops = reply_chain(a, message).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.element_at("nodes", i).alias("s"), F.element_at("nodes", i + 1).alias("t")))).alias("h"))
    nodes = (
        people.select(F.col("address_id").alias("id"), F.lit("address").alias("kind"), F.col("address_id").alias("label"))
        .unionByName(thread.select(text("message_id").alias("id"), F.lit("message").alias("kind"), F.lit("").alias("label")))
        .unionByName(chain.select(text("id").alias("id"), F.lit("message").alias("kind"), F.lit("").alias("label")))
        .unionByName(a.messages.filter(F.col("id") == message).select(text("id").alias("id"), F.lit("message").alias("kind"), F.col("subject_norm").alias("label")))
    )
    one = F.lit(1.0)
    edges = (
        people.select(me.alias("source"), F.col("address_id").alias("target"), F.col("edge").alias("kind"), one.alias("weight"))
        .unionByName(thread.filter(F.col("message_id") != message).select(me.alias("source"), text("message_id").alias("target"), F.lit("IN_THREAD").alias("kind"), one.alias("weight")))
        .unionByName(hops.select(F.least(text("h.s"), text("h.t")).alias("source"), F.greatest(text("h.s"), text("h.t")).alias("target"), F.lit("REPLIES_TO").alias("kind"), one.alias("weight")))
    )
    return Subgraph(nodes, edges).assembled()


def truncated(rows: DataFrame, limit: int) -> bool:
    return rows.limit(limit).count() >= limit


def heaviest_per(df: DataFrame, key: str, weight: str, count: int, *tie: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(weight), *tie))
    return df.withColumn("place", place).filter(F.col("place") <= count)
