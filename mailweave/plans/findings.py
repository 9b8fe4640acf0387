"""Reads over the derived layer: listings of findings, and the explorer's views of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions.text import preview
from mailweave.operators import graph
from mailweave.operators.algebra import branch, top, traverse
from mailweave.plans.explorer import Subgraph, address_messages, address_neighbours, heaviest_per, message_subgraph, overlap, reply_chain, tag_members, topic_participants
from mailweave.plans.reports import DEFAULT_ROWS, clamp
from mailweave.session import cut
from mailweave.tables import Archive

#: Rows that each read of a view returns; hops between two people; routes that are shown.
VIEW_ROWS, PATH_HOPS, ROUTES = 100, 4, 3


@dataclass(frozen=True)
class Findings:
    """The derived tables that listings and views read."""

    topics: DataFrame  # id, label, message_count, keywords (array, null where not computed)
    topic_members: DataFrame  # topic_id, id, method, score; a message may be there by several methods
    communities: DataFrame  # id, label, size, method
    community_members: DataFrame  # community_id, id, rank
    community_messages: DataFrame  # community_id, id, score
    templates: DataFrame  # id, direction, occurrences, automation_score, sample_text, first_seen, last_seen
    importance: DataFrame  # id, importance, reasons
    tags: DataFrame  # tag_id, name, color


# --- listings ------------------------------------------------------------------------------


def top_templates(f: Findings, direction: str, limit: int = DEFAULT_ROWS) -> DataFrame:
    """What is worth automating in one direction, best first."""
    rows = f.templates.filter(F.col("direction") == direction)
    columns = ["id", "occurrences", "automation_score", "sample_text", "first_seen", "last_seen"]
    return top(rows.select(*columns), F.desc_nulls_last("automation_score"), F.asc("id"), limit=clamp(limit))


def topic_breakdown(f: Findings, limit: int = DEFAULT_ROWS) -> DataFrame:
    """Messages of each topic by the signal that drew them in."""
    named = traverse(f.topics.select("id", "label"), "id", f.topic_members.select("topic_id", "method"), "topic_id")
    rows = named.groupBy("id", "label", "method").agg(F.count("*").alias("messages"))
    return top(rows, F.desc("messages"), F.asc("id"), F.asc("method"), limit=clamp(limit))


def with_circulation(a: Archive, f: Findings) -> DataFrame:
    """Communities with how many messages circulate in them, and when."""
    sent = f.community_messages.join(a.messages.select("id", "sent_at"), "id")
    mail = sent.groupBy(F.col("community_id").alias("id")).agg(F.count("*").alias("message_count"), F.min("sent_at").alias("first_seen"), F.max("sent_at").alias("last_seen"))
    return branch(f.communities, "id", mail).withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def top_communities(a: Archive, f: Findings, limit: int = DEFAULT_ROWS) -> DataFrame:
    """The busiest circles."""
    rows = with_circulation(a, f).select("id", "label", "size", "message_count", "method", "first_seen", "last_seen")
    return top(rows, F.desc("message_count"), F.asc("id"), limit=clamp(limit))


def top_important(a: Archive, f: Findings, limit: int = DEFAULT_ROWS) -> DataFrame:
    """What probably matters, with its reasons; a message without a sender stays."""
    sender = a.recipients.filter("role = 'FROM'").groupBy("message_id").agg(F.min("address_id").alias("sender"))
    best = top(f.importance.filter("importance is not null"), F.desc("importance"), F.asc("id"), limit=clamp(limit))
    rows = traverse(best.join(a.messages.select("id", "subject_norm", "sent_at"), "id"), "id", sender, "message_id", optional=True)
    return rows.select("id", "subject_norm", "sent_at", "sender", "importance", "reasons").orderBy(F.desc("importance"), "id")


def keyword_listing(f: Findings, limit: int = DEFAULT_ROWS) -> DataFrame:
    """Topics that have keywords, the largest first."""
    return top(f.topics.filter("keywords is not null").select("id", "label", "keywords", "message_count"), F.desc_nulls_last("message_count"), F.asc("id"), limit=clamp(limit))


def topics_of_messages(f: Findings, ids: DataFrame) -> DataFrame:
    """The topics of a page of messages (ids: id); a message in none is absent."""
    mine = f.topic_members.join(ids.select("id").distinct(), "id", "left_semi").select("id", "topic_id").distinct()
    return mine.join(f.topics.select(F.col("id").alias("topic_id"), "label", "keywords"), "topic_id").select(F.col("id").alias("message_id"), "topic_id", "label", "keywords")


def groups_of_messages(group_members: DataFrame, groups: DataFrame, ids: DataFrame) -> DataFrame:
    """The recurring group (participant_key) of a page of messages."""
    mine = group_members.join(ids.select("id").distinct(), "id", "left_semi")
    return mine.join(groups.select("participant_key", "size", "message_count"), "participant_key").select(F.col("id").alias("message_id"), F.col("participant_key").alias("group_id"), "size", "message_count")


def finding_counts(f: Findings, **tables: DataFrame) -> DataFrame:
    """(name, total) of every kind of finding, in one pass over each table."""
    from mailweave.plans.reports import totals

    return totals(topics=f.topics, templates=f.templates, communities=f.communities, **tables).withColumnRenamed("n", "total")


# --- explorer reads ------------------------------------------------------------------------


def message_topics(f: Findings, message) -> DataFrame:
    mine = f.topic_members.filter(F.col("id") == message).select(F.col("topic_id"), "method")
    return traverse(mine, "topic_id", f.topics.select("id", "label", "message_count"), "id").select("id", "label", "message_count", "method")


def message_tags(a: Archive, f: Findings, message) -> DataFrame:
    mine = a.message_tags.filter(F.col("message_id") == message).select("tag_id").distinct()
    return mine.join(f.tags, "tag_id").select(F.col("tag_id").alias("id"), "name", "color")


def message_circle(a: Archive, f: Findings, message) -> DataFrame:
    mine = f.community_messages.filter(F.col("id") == message).select(F.col("community_id").alias("id"), "score")
    return mine.join(with_circulation(a, f), "id").select("id", "label", "size", "message_count", "score")


def topic_members(a: Archive, f: Findings, topic, limit: int = DEFAULT_ROWS) -> DataFrame:
    """The mail of a topic, the most important first."""
    mine = f.topic_members.filter(F.col("topic_id") == topic).select("id", "method")
    rows = branch(mine.join(a.messages.select("id", "subject_norm", "sent_at"), "id"), "id", f.importance.select("id", "importance"))
    return top(rows.select("id", "subject_norm", "sent_at", "importance", "method"), F.desc_nulls_last("importance"), F.asc("id"), F.asc("method"), limit=clamp(limit))


def community_members(a: Archive, f: Findings, community, limit: int = DEFAULT_ROWS) -> DataFrame:
    """The people of a circle, the most central first."""
    mine = f.community_members.filter(F.col("community_id") == community).join(a.addresses.select("id", "domain"), "id", "left")
    return top(mine.select("id", "domain", "rank"), F.desc_nulls_last("rank"), F.asc("id"), limit=clamp(limit))


def community_messages(a: Archive, f: Findings, community, limit: int = DEFAULT_ROWS) -> DataFrame:
    """The mail that is most a circle's own."""
    mine = f.community_messages.filter(F.col("community_id") == community).select("id", "score")
    rows = branch(mine.join(a.messages.select("id", "subject_norm", "sent_at"), "id"), "id", f.importance.select("id", "importance"))
    return top(rows.select("id", "subject_norm", "sent_at", "importance", "score"), F.desc("score"), F.asc("id"), limit=clamp(limit))


def overview_topics(f: Findings, limit: int = DEFAULT_ROWS) -> DataFrame:
    return top(f.topics.filter("message_count is not null").select("id", "label", "message_count"), F.desc("message_count"), F.asc("id"), limit=clamp(limit))


def overview_communities(a: Archive, f: Findings, limit: int = DEFAULT_ROWS) -> DataFrame:
    return top(with_circulation(a, f).select("id", "label", "size", "message_count"), F.desc("message_count"), F.asc("id"), limit=clamp(limit))


def overview_tags(a: Archive, f: Findings, limit: int = DEFAULT_ROWS) -> DataFrame:
    """Every tag and how much it holds; an unused one holds 0."""
    n = a.message_tags.groupBy("tag_id").agg(F.count_distinct("message_id").alias("messages"))
    rows = branch(f.tags.select("tag_id", "name"), "tag_id", n).select(F.col("tag_id").alias("id"), "name", F.coalesce("messages", F.lit(0)).alias("messages"))
    return top(rows, F.desc("messages"), F.asc("id"), limit=clamp(limit))


def _members(df: DataFrame, key: str, message: str = "id") -> DataFrame:
    return df.select(F.col(key).alias("collection"), F.col(message).alias("id"))


def overview_topic_circle(f: Findings, limit: int = DEFAULT_ROWS) -> DataFrame:
    return overlap(_members(f.topic_members, "topic_id"), _members(f.community_messages, "community_id"), clamp(limit)).withColumnsRenamed({"left": "topic_id", "right": "community_id"})


def overview_tag_topic(a: Archive, f: Findings, limit: int = DEFAULT_ROWS) -> DataFrame:
    return overlap(_members(a.message_tags, "tag_id", "message_id"), _members(f.topic_members, "topic_id"), clamp(limit)).withColumnsRenamed({"left": "tag_id", "right": "topic_id"})


def topic_reading(a: Archive, f: Findings, topic, limit: int = DEFAULT_ROWS) -> DataFrame:
    """Members of a topic as rows to read: each once, best first, with sender, preview and whether more exist."""
    best = f.topic_members.filter(F.col("topic_id") == topic).select("topic_id", "id").distinct().join(f.importance.select("id", "importance"), "id", "left")
    page = top(best, F.desc_nulls_last("importance"), F.asc("id"), limit=clamp(limit))
    sender = a.recipients.filter("role = 'FROM'").groupBy(F.col("message_id").alias("id")).agg(F.min("address_id").alias("sender"))
    body = preview(F.col("body_text")) if "body_text" in a.messages.columns else F.lit("")
    held = page.groupBy("topic_id").agg(F.count("*").alias("shown"))
    whole = f.topics.select(F.col("id").alias("topic_id"), "label", "message_count").join(held, "topic_id").select("topic_id", "label", (F.col("message_count") > F.col("shown")).alias("truncated"))
    rows = branch(page.join(a.messages, "id"), "id", sender).join(whole, "topic_id")
    return rows.select("topic_id", "label", "id", "subject_norm", "sender", "sent_at", body.alias("preview"), F.coalesce("importance", F.lit(0.0)).alias("importance"), "truncated").orderBy(F.desc("importance"), "id")


# --- views ---------------------------------------------------------------------------------


def _node(df: DataFrame, key: str, kind: str, label: str | None = None) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), F.lit(kind).alias("kind"), (F.lit("") if label is None else F.coalesce(F.col(label).cast("string"), F.lit(""))).alias("label"))


def _edge(df: DataFrame, source, target, kind, weight=None) -> DataFrame:
    text = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    return df.select(text(source).alias("source"), text(target).alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weight"))


def message_view(a: Archive, f: Findings, message, depth: int = 1, limit: int = VIEW_ROWS) -> Subgraph:
    """A message, its people, thread and replies within ``depth``, and the findings that it belongs to."""
    me = F.lit(str(message))
    base = message_subgraph(a, message, limit)
    near = reply_chain(a, message, depth).select(F.explode(F.transform("nodes", lambda x: x.cast("string"))).alias("id")).distinct()
    replies = base.edges.filter("kind = 'REPLIES_TO'").join(near.withColumnRenamed("id", "source"), "source", "left_semi").join(near.withColumnRenamed("id", "target"), "target", "left_semi")
    kept = base.edges.filter("kind != 'REPLIES_TO'").unionByName(replies)
    held = kept.select(F.col("source").alias("id")).union(kept.select("target")).union(a.messages.filter(F.col("id") == message).select(F.col("id").cast("string"))).distinct()
    topics, tags, circles = message_topics(f, message), message_tags(a, f, message), message_circle(a, f, message)
    nodes = base.nodes.join(held, "id", "left_semi").unionByName(_node(topics, "id", "topic", "label")).unionByName(_node(tags, "id", "tag", "name")).unionByName(_node(circles, "id", "community", "label"))
    edges = kept.unionByName(_edge(topics, me, "id", "ABOUT")).unionByName(_edge(tags, me, "id", "TAGGED")).unionByName(_edge(circles, me, "id", "IN_CIRCLE", "score"))
    return Subgraph(nodes, edges).assembled()


def topic_view(a: Archive, f: Findings, topic, limit: int = VIEW_ROWS) -> Subgraph:
    mail, people = topic_members(a, f, topic, limit), topic_participants(a, f.topic_members, topic, limit)
    hub = F.lit(str(topic))
    nodes = _node(f.topics.filter(F.col("id") == topic), "id", "topic", "label").unionByName(_node(mail, "id", "message", "subject_norm")).unionByName(_node(people, "address_id", "address", "address_id"))
    edges = _edge(mail, "id", hub, "ABOUT").unionByName(_edge(people, "address_id", hub, "PARTICIPATES", "messages"))
    return Subgraph(nodes, edges).assembled()


def address_view(a: Archive, pairs: DataFrame, address: str, limit: int = VIEW_ROWS) -> Subgraph:
    mail, near = address_messages(a, address, limit), address_neighbours(pairs, address, limit)
    hub = F.lit(address)
    nodes = _node(a.addresses.filter(F.col("id") == address), "id", "address", "id").unionByName(_node(mail, "id", "message")).unionByName(_node(near, "neighbour", "address", "neighbour"))
    edges = _edge(mail, "id", hub, F.col("edge")).unionByName(_edge(near, hub, "neighbour", "CO_ADDRESSED", "count"))
    return Subgraph(nodes, edges).assembled()


def tag_view(a: Archive, f: Findings, tag: str, limit: int = VIEW_ROWS) -> Subgraph:
    mail = tag_members(a, tag, limit)
    nodes = _node(f.tags.filter(F.col("tag_id") == tag), "tag_id", "tag", "name").unionByName(_node(mail, "id", "message"))
    return Subgraph(nodes, _edge(mail, "id", F.lit(tag), "TAGGED")).assembled()


def community_view(a: Archive, f: Findings, community: str, limit: int = VIEW_ROWS) -> Subgraph:
    people, mail = cut(community_members(a, f, community, limit)), cut(community_messages(a, f, community, limit))  # a page each, for nodes and edges
    hub = F.lit(community)
    nodes = _node(f.communities.filter(F.col("id") == community), "id", "community", "label").unionByName(_node(people, "id", "address", "id")).unionByName(_node(mail, "id", "message", "subject_norm"))
    return Subgraph(nodes, _edge(people, "id", hub, "MEMBER_OF", "rank").unionByName(_edge(mail, "id", hub, "IN_CIRCLE", "score"))).assembled()


def overview(a: Archive, f: Findings, limit: int = VIEW_ROWS) -> Subgraph:
    """The collections and where they overlap; an overlap with a collection that isn't listed is left out."""
    nodes = _node(overview_topics(f, limit), "id", "topic", "label").unionByName(_node(overview_communities(a, f, limit), "id", "community", "label")).unionByName(_node(overview_tags(a, f, limit), "id", "tag", "name"))
    shared, filed = overview_topic_circle(f, limit), overview_tag_topic(a, f, limit)
    return Subgraph(nodes, _edge(shared, "topic_id", "community_id", "OVERLAPS", "messages").unionByName(_edge(filed, "tag_id", "topic_id", "OVERLAPS", "messages"))).assembled()


def path_view(pairs: DataFrame, left: str, right: str, hops: int = PATH_HOPS) -> Subgraph:
    """How two people are connected: the shortest few routes over who is written to together."""
    found = graph.shortest_paths(pairs.select(F.col("left").alias("src"), F.col("right").alias("dst")), left, right, min(max(1, hops), 8), ROUTES)
    steps = found.select(F.explode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("s"), F.slice("nodes", 2, F.size("nodes")).alias("t"))).alias("x")).select(F.least("x.s", "x.t").alias("s"), F.greatest("x.s", "x.t").alias("t"))
    stops = found.select(F.explode("nodes").alias("id"))
    return Subgraph(_node(stops, "id", "address", "id"), _edge(steps, "s", "t", "CO_ADDRESSED")).assembled()


def expand(a: Archive, f: Findings, pairs: DataFrame, node, kind: str, limit: int = VIEW_ROWS) -> Subgraph:
    """One hop out of a node, to lay over what is drawn; a thread has no view of its own."""
    views = {
        "message": lambda: message_view(a, f, node, 1, limit), "topic": lambda: topic_view(a, f, node, limit), "address": lambda: address_view(a, pairs, node, limit),
        "tag": lambda: tag_view(a, f, node, limit), "community": lambda: community_view(a, f, node, limit),
    }
    if kind not in views:
        empty = _node(a.messages.limit(0), "id", "thread")
        return Subgraph(empty, _edge(a.replies.limit(0), "child", "parent", "REPLIES_TO"))
    return views[kind]()


def heaviest_neighbours(pairs: DataFrame, count: int) -> DataFrame:
    """The ``count`` people that each person is most often written to together with."""
    both = pairs.select("left", "right", "count").union(pairs.select("right", "left", "count"))
    return heaviest_per(both, "left", "count", count, "right")
