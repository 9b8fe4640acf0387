"""Rebuild: the derived layer from ground truth, in stages that say what they read.

A whole rebuild runs every stage. ``refresh`` runs only stages whose input changed since the last
published layer, by fingerprints of the ground truth and of the stages before, and publishes all
tables of the new layer with one manifest: readers see the old layer or the new one, whole.
"""

from __future__ import annotations

import hashlib
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave import snapshots
from mailweave.operators import graph
from mailweave.plans import derived, reports
from mailweave.plans.semantic import SemanticError
from mailweave.plans.tags import DERIVED, writable
from mailweave.session import cut
from mailweave.tables import Archive

logger = logging.getLogger(__name__)

#: Part of every fingerprint: a change of what stages compute makes all of them run.
RULES = 2


@dataclass
class Derived:
    """Tables of the derived layer by name, what each stage read, found and left out, and how long it took."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    ran: list[str] = field(default_factory=list)

    def write(self, spark: SparkSession, path: str) -> None:
        """Publish the derived tables as one layer; ground truth and annotations are other folders."""
        folders = {name: _save(df, path, name) for name, df in self.tables.items()}
        _publish(spark, path, {"tables": folders, "stages": {}})


@dataclass
class Work:
    """What stages work on: ground truth, the bodies of messages (id, text, body_clean, simhash), and the tables made so far."""

    a: Archive
    bodies: DataFrame | None
    similar: Callable[[], DataFrame] | None
    made: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def edges(self) -> DataFrame:
        return self.made["co_addressed"].select(F.col("left").alias("src"), F.col("right").alias("dst"), F.col("count").alias("weight"))


@dataclass(frozen=True)
class Stage:
    name: str
    reads: tuple[str, ...]  # ground-truth tables, "bodies", "similar", or tables of stages before
    makes: tuple[str, ...]
    run: Callable[[Work], tuple[DataFrame, ...]]


def _facts(w: Work) -> tuple[DataFrame, ...]:
    w.counts["unidentified"] = reports.unidentified(w.a).first()["unidentified"]
    w.counts["wide"] = reports.wide_messages(w.a).first()["wide"]
    return (reports.facts(w.a),)


def _groups(w: Work) -> tuple[DataFrame, ...]:
    groups = cut(reports.recurring_groups(w.a))
    return groups, w.made["facts"].join(groups.select("participant_key"), "participant_key").select("participant_key", "id")


def _reply_rank(w: Work) -> tuple[DataFrame, ...]:
    return (graph.directed_pagerank(reports.parents(w.a).select(F.col("child").alias("src"), F.col("parent").alias("dst"))),)


def _communities(w: Work) -> tuple[DataFrame, ...]:
    return derived.communities(graph.label_propagation(w.edges()), w.made["address_rank"], w.a.addresses)


def _topics(w: Work) -> tuple[DataFrame, ...]:
    extra = derived.conversation_edges(w.made["facts"], w.a.replies)
    if w.similar is not None:
        try:
            extra = extra.unionByName(cut(w.similar()))
            w.counts["similar_skipped"] = 0
        except SemanticError as e:  # nothing to search by: topics do without these edges
            logger.warning("similar messages are left out: %s", e)
            w.counts["similar_skipped"] = 1
    return derived.topics(w.made["facts"], extra, counts=w.counts)


def _named_topics(w: Work) -> tuple[DataFrame, ...]:
    topics = w.made["bare_topics"]
    if w.bodies is None:
        return (topics,)
    words = cut(derived.keywords(w.made["topic_members"], w.bodies.select("id", "text")))
    w.counts["keywords"] = words.count()
    listed = words.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("k"))  # KEYWORDS of each
    return (topics.join(listed.select(F.col("topic_id").alias("id"), F.col("k.term").alias("keywords")), "id", "left"),)


def _templates(w: Work) -> tuple[DataFrame, ...]:
    facts = w.made["facts"]
    if w.bodies is None:
        return (facts.select("id", F.lit(0.0).alias("score")).limit(0),)
    lines = facts.select("id", "sent_at", "outbound").join(w.bodies.select("id", "simhash", "body_clean"), "id")
    found, instances = (cut(x) for x in derived.templates(lines))
    automation = cut(derived.automation(found, instances))
    w.counts["templates"] = found.count()
    w.counts["automated"] = automation.filter("score > 0").count()
    return automation, found, instances


def _importance(w: Work) -> tuple[DataFrame, ...]:
    return (derived.importance(w.made["facts"], reports.message_signals(w.a), w.a.accounts, w.made["address_rank"], w.made["reply_rank"], w.made["automation"]),)


def _suggestions(w: Work) -> tuple[DataFrame, ...]:
    as_group = lambda kind, df, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("group_id"), "id")
    kinds = as_group("thread", w.made["facts"].filter("thread_id is not null"), "thread_id")
    kinds = kinds.unionByName(as_group("topic", w.made["topic_members"], "topic_id")).unionByName(as_group("community", w.made["community_messages"], "community_id"))
    return (derived.suggestions(kinds, w.a.message_tags),)


_MAIL = ("messages", "recipients")
#: In order: each reads ground truth and what was made before it.
STAGES = (
    Stage("facts", (*_MAIL, "accounts", "message_threads", "message_attachments"), ("facts",), _facts),
    Stage("pairs", _MAIL, ("co_addressed",), lambda w: (reports.addressed_pairs(w.a),)),
    Stage("groups", (*_MAIL, "facts"), ("groups", "group_members"), _groups),
    Stage("address_rank", ("co_addressed",), ("address_rank",), lambda w: (graph.weighted_pagerank(w.edges()),)),
    Stage("reply_rank", ("replies",), ("reply_rank",), _reply_rank),
    Stage("communities", ("co_addressed", "address_rank", "addresses"), ("communities", "community_members"), _communities),
    Stage("circles", ("facts", "community_members"), ("community_messages",), lambda w: (derived.circles(w.made["facts"], w.made["community_members"]),)),
    Stage("topics", ("facts", "replies", "similar"), ("bare_topics", "topic_members"), _topics),
    Stage("keywords", ("bare_topics", "topic_members", "bodies"), ("topics",), _named_topics),
    Stage("templates", ("facts", "bodies"), ("automation", "templates", "template_members"), _templates),
    Stage("importance", ("facts", *_MAIL, "replies", "message_labels", "message_attachments", "accounts", "address_rank", "reply_rank", "automation"), ("message_importance",), _importance),
    Stage("suggestions", ("facts", "topic_members", "community_messages", "message_tags"), ("tag_suggestions",), _suggestions),
)
#: Tables whose rows are counted.
COUNTED = {"facts": "messages"} | {t: t for t in ("topics", "communities", "tag_suggestions", "message_importance", "address_rank", "co_addressed")}


def _limited(a: Archive, counts: dict[str, int], most: int) -> Archive:
    if not most:
        return a
    counts["beyond_ceiling"] = max(0, a.messages.count() - most)
    return replace(a, messages=a.messages.orderBy("id").limit(most))


def rebuild(a: Archive, bodies: DataFrame | None = None, similar: Callable[[], DataFrame] | None = None, max_messages: int = 0) -> Derived:
    """Correspondents, centrality, communities, topics, keywords, templates, importance, suggestions: every stage.

    ``bodies``: id, text, body_clean, simhash of messages, if there are any. ``similar`` feeds edges
    between similar messages; if it fails, the run goes on without and counts it.
    """
    out = Derived()
    w = Work(_limited(a, out.counts, max_messages), bodies, similar)
    for stage in STAGES:
        began = time.time()
        w.made |= dict(zip(stage.makes, (cut(df) for df in stage.run(w)), strict=False))
        out.seconds[stage.name] = round(time.time() - began, 2)
        out.ran.append(stage.name)
    out.counts |= w.counts | {name: w.made[t].count() for t, name in COUNTED.items()}
    out.tables = {writable(t): df for t, df in w.made.items() if t in DERIVED}
    return out


def fingerprint(df: DataFrame) -> str:
    """Tells tables with other rows apart, whatever their order: the schema, the number of rows and sums of two hashes."""
    columns = sorted(df.columns)
    part = lambda k: F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)"))
    seen = df.agg(F.count("*"), part(1), part(2)).first()
    return hashlib.sha256(repr([sorted(df.dtypes), *seen]).encode()).hexdigest()


def refresh(
    spark: SparkSession, path: str, a: Archive, bodies: DataFrame | None = None, similar: Callable[[], DataFrame] | None = None, similar_from: DataFrame | None = None
) -> Derived:
    """Bring the layer below ``path`` up to date: run what reads something that changed, keep the rest, publish once.

    ``similar_from`` is what ``similar`` reads (the vectors of the archive unless given).
    """
    base = snapshots.versions(spark, path)
    old = snapshots.current(spark, path) or {"tables": {}, "stages": {}}
    truth = {t: df for t, df in vars(a).items()} | {"bodies": bodies, "similar": None if similar is None else a.vectors if similar_from is None else similar_from}
    prints: dict[str, str] = {}
    out, w = Derived(), Work(a, bodies, similar)
    folders: dict[str, str] = {}
    stages: dict[str, dict] = {}
    for stage in STAGES:
        began = time.time()
        for t in stage.reads:
            if t not in prints:
                prints[t] = "none" if truth[t] is None else fingerprint(truth[t])
        now = hashlib.sha256(repr([RULES, stage.name, [prints[t] for t in stage.reads]]).encode()).hexdigest()
        before = old["stages"].get(stage.name)
        if before is not None and before["print"] == now:
            stages[stage.name] = before
            folders |= {t: old["tables"][t] for t in stage.makes if t in old["tables"]}
        else:
            w.counts = {}
            made = dict(zip(stage.makes, stage.run(w), strict=False))
            folders |= {t: _save(df, path, t) for t, df in made.items()}
            counts = w.counts | {COUNTED[t]: spark.read.parquet(f"{path}/{folders[t]}").count() for t in made if t in COUNTED}
            stages[stage.name] = {"print": now, "counts": counts}
            out.ran.append(stage.name)
        w.made |= {t: spark.read.parquet(f"{path}/{folders[t]}") for t in stage.makes if t in folders}
        prints |= {t: now + t for t in stage.makes}
        out.counts |= stages[stage.name]["counts"]
        out.seconds[stage.name] = round(time.time() - began, 2)
    if out.ran:
        _publish(spark, path, {"tables": folders, "stages": stages}, base[-1] if base else 0)
    out.tables = {t: df for t, df in w.made.items() if t in DERIVED}
    return out


def read_derived(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of the layer that was published last; none before the first."""
    tables = (snapshots.current(spark, path) or {"tables": {}})["tables"]
    return {t: spark.read.parquet(f"{path}/{f}") for t, f in tables.items() if t in DERIVED}


def _save(df: DataFrame, path: str, name: str) -> str:
    folder = f"{name}/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder


def _publish(spark: SparkSession, path: str, content: dict, after: int | None = None) -> None:
    """One manifest for all tables, then the folders go that only manifests before the last two named."""
    snapshots.publish(spark, path, content, after)
    gone = {f for old in snapshots.forget(spark, path) for f in old["tables"].values()}
    kept = {f for v in snapshots.versions(spark, path) for f in snapshots.current(spark, path, v)["tables"].values()}
    for f in gone - kept:
        snapshots.remove(spark, f"{path}/{f}")
