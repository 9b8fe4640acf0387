"""The derived layer: topics, keywords, templates, communities, importance and tag suggestions."""

from __future__ import annotations

from itertools import combinations as combinations_of

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailweave.functions.text import hamming
from mailweave.operators import graph
from mailweave.session import cut, measured

# What a shared value is worth, where joining starts, and from where on a value is boilerplate.
SIGNALS = {"ref": 1.0, "conversation": 0.9, "thread": 0.8, "subject": 0.5, "attachment": 0.4, "participants": 0.2}
TOPIC_SCORE, BUCKET_CAP = 0.5, 200
DISTANCE, BAND_BITS, OCCURRENCES = 5, 16, 3
COMMUNITY_SIZE, CIRCLE_SHARE = 3, 0.5
KEYWORDS = 8
TAGGED, TAG_SHARE = 2, 0.3
GROUPING = {"thread": 0.9, "topic": 0.7, "community": 0.5}
IMPORTANCE = {
    "replied by you": 0.30,
    "flagged by the provider": 0.25,
    "replies": 0.20,
    "sent by a central correspondent": 0.15,
    "addressed directly": 0.15,
    "few recipients": 0.10,
    "has attachments": 0.10,
    "looks automated": -0.40,
}
FLAGS = ("IMPORTANT", "STARRED")


def digest_id(kind: str, member: Column) -> Column:
    """Id of a finding, an aggregate over its members: a digest of what their hashes add up to.

    Sums and extremes merge, so no member list is gathered in a row, and the order doesn't matter.
    """
    text = member.cast("string")
    sums = [F.sum(F.xxhash64(text, F.lit(k)).bitwiseAND(F.lit((1 << 40) - 1))) for k in range(3)]
    return F.concat(F.lit(f"{kind}:"), F.left(F.sha2(F.concat_ws("|", F.count("*"), F.min(text), F.max(text), *sums), 256), F.lit(32)))


def shared_values(facts: DataFrame) -> DataFrame:
    """(signal, key, id) of every value that a message could share with another."""
    none = F.array().cast("array<string>")
    values = {
        "ref": F.col("refs") if "refs" in facts.columns else none,
        "thread": F.array("thread_id"),
        "subject": F.array("subject_norm"),
        "attachment": F.col("attachments"),
        "participants": F.array("participant_key"),
    }

    def marked(signal: str):
        return lambda x: F.struct(F.lit(signal).alias("signal"), x.cast("string").alias("key"))

    pairs = F.flatten(F.array(*[F.transform(F.coalesce(v.cast("array<string>"), none), marked(s)) for s, v in values.items()]))
    return facts.select("id", F.explode(pairs).alias("b")).select("b.signal", "b.key", "id").filter("key is not null and key != ''").distinct()


def signal_buckets(facts: DataFrame, cap: int | None = BUCKET_CAP, counts: dict[str, int] | None = None) -> DataFrame:
    """(signal, key, id, size, hub) of every value that messages share; hub is the smallest id that has it.

    A value that more than ``cap`` messages share is boilerplate and joins nothing; None keeps all.
    ``counts`` gets how many such values there are, and how many times messages have them.
    """
    rows = shared_values(facts)
    # a bucket's size is counted with map-side combine; only ids of kept buckets are shuffled again
    sizes = rows.groupBy("signal", "key").agg(F.count("*").alias("size"), F.min("id").alias("hub")).filter("size > 1")
    if counts is not None:
        large = F.lit(False) if cap is None else F.col("size") > cap
        sizes, seen = measured(sizes, dropped=F.count_if(large), members=F.coalesce(F.sum(F.when(large, F.col("size"))), F.lit(0)))
        counts |= {"dropped_buckets": seen["dropped"], "dropped_bucket_members": seen["members"]}
    return rows.join(sizes if cap is None else sizes.filter(F.col("size") <= cap), ["signal", "key"])


def strong_edges(buckets: DataFrame) -> DataFrame:
    """A star per bucket of a signal that joins alone: (src, dst, method, weight)."""
    strong = {s: w for s, w in SIGNALS.items() if w >= TOPIC_SCORE}
    weight = F.element_at(F.create_map(*[F.lit(x) for s in SIGNALS.items() for x in s]), F.col("signal"))
    rows = buckets.filter(F.col("signal").isin(list(strong))).filter("id != hub")
    return rows.select(F.col("hub").alias("src"), F.col("id").alias("dst"), F.col("signal").alias("method"), weight.alias("weight"))


def weak_edges(buckets: DataFrame) -> DataFrame:
    """Links of messages that share enough weak signals together, as stars: (src, dst, method, weight).

    Each set of weak signals that reaches the score makes a key of a value of each; who shares such
    a key shares all of them. So the links of a key are a star, no pairs are made, and none is left out.
    """
    weak = {s: w for s, w in SIGNALS.items() if w < TOPIC_SCORE and s != "conversation"}
    sets = [c for n in range(2, len(weak) + 1) for c in combinations_of(sorted(weak), n) if sum(weak[s] for s in c) >= TOPIC_SCORE - 1e-9]
    found = None
    for signals in sets:
        keys = [f"key{k}" for k in range(len(signals))]
        rows = None
        for signal, key in zip(signals, keys):
            own = buckets.filter(F.col("signal") == signal).select("id", F.col("key").alias(key))
            rows = own if rows is None else rows.join(own, "id")
        rows = cut(rows)
        star = rows.groupBy(*keys).agg(F.min("id").alias("src"), F.count("*").alias("size")).filter("size > 1")
        best, weight = max(signals, key=weak.get), round(sum(weak[s] for s in signals), 6)
        edges = rows.join(star, keys).filter("id != src").select("src", F.col("id").alias("dst"), F.lit(best).alias("method"), F.lit(weight).alias("weight"))
        found = edges if found is None else found.unionByName(edges)
    return found.distinct()


def conversation_edges(facts: DataFrame, replies: DataFrame) -> DataFrame:
    """Messages that threads and replies connect across threads, as stars."""
    in_thread = facts.filter("thread_id is not null").select("thread_id", "id")
    hub = in_thread.groupBy("thread_id").agg(F.min("id").alias("src"))
    links = in_thread.join(hub, "thread_id").filter("id != src").select("src", F.col("id").alias("dst")).union(replies.select("parent", "child"))
    part = graph.connected_components(links)
    return part.filter("id != component").select(
        F.col("component").alias("src"), F.col("id").alias("dst"), F.lit("conversation").alias("method"), F.lit(SIGNALS["conversation"]).alias("weight")
    )


def topic_links(facts: DataFrame, extra: DataFrame | None = None, cap: int | None = BUCKET_CAP, counts: dict[str, int] | None = None) -> DataFrame:
    """Members of topics (component, id, method, score) with the reason of each; component is the smallest id of a topic.

    ``cap`` and ``counts`` as in :func:`signal_buckets`.
    """
    buckets = cut(signal_buckets(facts, cap, counts))
    edges = strong_edges(buckets).unionByName(weak_edges(buckets))
    if extra is not None:
        edges = edges.unionByName(extra.filter((F.col("weight") >= TOPIC_SCORE) & (F.col("src") != F.col("dst"))).select("src", "dst", "method", "weight"))
    edges = cut(edges)
    ends = edges.select(F.col("src").alias("id"), "method", "weight").union(edges.select("dst", "method", "weight"))
    reason = F.min_by(F.struct("method", F.col("weight").alias("score")), F.struct(~_known(), -F.col("weight"), F.col("method")))
    return cut(ends.groupBy("id").agg(reason.alias("r")).join(graph.connected_components(edges), "id").select("component", "id", "r.method", "r.score"))


def _known() -> Column:
    return F.col("method").isin(list(SIGNALS))


def topic_facts(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Topics of :func:`topic_links`: component, id, label, method, score, message_count, first and last date."""
    named = members.join(facts.select("id", "subject_norm", "sent_at"), "id")
    subject = named.filter("subject_norm is not null and subject_norm != ''").groupBy("component", "subject_norm").agg(F.count("*").alias("n"))
    label = subject.groupBy("component").agg(F.min_by("subject_norm", F.struct(-F.col("n"), F.col("subject_norm"))).alias("label"))
    found = named.groupBy("component").agg(
        digest_id("topic", F.col("id")).alias("id"), F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("message_count"),
        F.min_by("method", F.struct(~_known(), -F.col("score"), F.col("method"))).alias("method"),
        F.min("sent_at").alias("first_seen"), F.max("sent_at").alias("last_seen"),
    )
    return cut(found.join(label, "component", "left").select("component", "id", F.coalesce("label", F.lit("")).alias("label"), "method", "score", "message_count", "first_seen", "last_seen"))


def topics(facts: DataFrame, extra: DataFrame | None = None, cap: int | None = BUCKET_CAP, counts: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Topics (id, label, method, score, message_count, first and last date) and members (topic_id, id, method, score).

    ``cap`` and ``counts`` as in :func:`signal_buckets`.
    """
    members = topic_links(facts, extra, cap, counts)
    found = topic_facts(members, facts)
    ids = found.select("component", F.col("id").alias("topic_id"))
    return found.drop("component"), members.join(ids, "component").select("topic_id", "id", "method", "score")


def stop_words() -> list[str]:
    """Filler of the two languages, from Spark's own lists."""
    return sorted({w.lower() for x in ("english", "german") for w in StopWordsRemover.loadDefaultStopWords(x)})


def keywords(members: DataFrame, texts: DataFrame, stop: list[str] | None = None, count: int = KEYWORDS) -> DataFrame:
    """(topic_id, term, tf, score, place): TF-IDF over topics, from the whole texts (id, text) of all their members."""
    bare = F.regexp_replace(F.lower("text"), r"[a-z][a-z0-9]{1,9}-\d{1,8}|#\d{2,8}", " ")
    terms = (
        members.select("topic_id", "id").distinct().join(texts, "id").select("topic_id", F.explode(F.regexp_extract_all(bare, F.lit(r"(?U)([\p{L}]{3,})"), F.lit(1))).alias("term"))
        .filter(~F.col("term").isin(stop_words() if stop is None else stop))
    )
    tf = terms.groupBy("topic_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = tf.agg(F.count_distinct("topic_id").alias("n"))
    idf = F.greatest(F.lit(0.0), F.log(F.col("n") / (1 + F.col("df"))))
    scored = tf.join(df, "term").join(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * idf, 6))  # n is one row
    place = F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("score"), F.desc("tf"), "term"))
    return scored.withColumn("place", place).filter(F.col("place") <= count).select("topic_id", "term", "tf", "score", "place")


def near_keys(simhash: Column, distance: int) -> Column:
    """Keys of which two fingerprints share one if they share a band and differ in at most ``distance`` bits.

    What is outside the shared band is cut into ``distance`` + 1 blocks, of which one has to be
    equal too. A band alone has 2^16 values, so its buckets would grow with the archive.
    """
    keys = []
    for band, value in enumerate(range(0, 64, BAND_BITS)):
        rest = [i for i in range(64) if not value <= i < value + BAND_BITS]
        size = -(-len(rest) // (distance + 1))
        for at in range(0, len(rest), size):
            mask = sum(1 << i for i in [*range(value, value + BAND_BITS), *rest[at : at + size]])
            keys.append(F.struct(F.lit(band * 64 + at).alias("k"), simhash.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("v")))
    return F.array(*keys)


def near_leaders(leaders: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(scope, simhash, other): fingerprints of a scope that share a band and differ in few bits, each pair once."""
    banded = leaders.select("scope", "simhash", F.explode(near_keys(F.col("simhash"), distance)).alias("key"))
    other = banded.select("scope", "key", F.col("simhash").alias("other"))
    # Spark sizes what is exploded by its input, and would send all keys through the driver
    return (
        banded.join(other.hint("merge"), ["scope", "key"]).filter("simhash < other")
        .filter(hamming(F.col("simhash"), F.col("other")) <= distance).select("scope", "simhash", "other").distinct()
    )


def templates(facts: DataFrame, distance: int = DISTANCE, least: int = OCCURRENCES, apart: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Near-identical bodies by direction. facts: id, sent_at, simhash, outbound, body_clean.

    Equal fingerprints collapse first; leaders that share a band and differ in few bits are
    linked, and the linked components are templates. ``apart`` names a column of facts that keeps
    bodies apart as the direction does: where few bits can be alike by chance, what is known to be
    of different makers isn't linked.
    """
    direction = F.when(F.col("outbound"), "sent").otherwise("received").alias("direction")
    scope = direction if apart is None else F.concat_ws(":", direction, F.col(apart).cast("string"))
    rows = facts.filter("simhash != 0").select("id", "sent_at", "simhash", "body_clean", direction, scope.alias("scope"))
    rows = cut(rows)
    leaders = cut(rows.select("scope", "simhash").distinct())
    near = near_leaders(leaders, distance)
    # nodes of all scopes in one job: a node is (scope, fingerprint)
    node = lambda c: F.concat_ws(":", "scope", F.col(c).cast("string"))
    edges = near.select(node("simhash").alias("src"), node("other").alias("dst")).union(leaders.select(node("simhash"), node("simhash")))
    part = graph.connected_components(edges)
    placed = cut(rows.withColumn("node", node("simhash")).join(part.withColumnRenamed("id", "node"), "node"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("occurrences"), F.min_by("simhash", "id").alias("model")).filter(F.col("occurrences") >= least)
    members = cut(placed.join(sizes, "component"))
    seconds = F.col("sent_at").cast("timestamp").cast("double")
    gap = (seconds - F.lag(seconds).over(W.partitionBy("component").orderBy("sent_at", "id")))
    gaps = members.filter("sent_at is not null").withColumn("gap", gap)
    regular = gaps.groupBy("component").agg(
        F.when((F.count("*") >= 3) & (F.avg("gap") > 0), 1 / (1 + F.stddev_pop("gap") / F.avg("gap"))).otherwise(0.0).alias("regularity")
    )
    short = members.groupBy("component").agg(
        F.min_by("body_clean", F.struct(F.length("body_clean"), F.col("id"))).alias("sample"),
        F.first("direction").alias("direction"), F.first("occurrences").alias("occurrences"), F.first("model").alias("model"),
        F.min("sent_at").alias("first_seen"), F.max("sent_at").alias("last_seen"),
    )
    name = F.concat(F.lit("template:"), F.lower(F.lpad(F.hex("model"), 16, "0")), F.lit(":"), F.col("direction"))
    words = F.size(F.split(F.trim("sample"), r"\s+"))
    frequency = F.least(F.lit(1.0), F.log1p("occurrences") / F.log1p(F.lit(12.0)))
    brevity = F.least(F.lit(1.0), words / 25.0) * (200.0 / (200.0 + words))
    found = short.join(regular, "component", "left").select(
        "component", name.alias("id"), "direction", "occurrences", F.left("sample", F.lit(500)).alias("sample_text"),
        F.round(frequency * F.coalesce("regularity", F.lit(0.0)) * brevity, 6).alias("automation_score"), "first_seen", "last_seen",
    )
    found = cut(found)
    of = members.join(found.select("component", F.col("id").alias("template_id")), "component")
    return found.drop("component"), of.select("template_id", "id", hamming(F.col("simhash"), F.col("model")).alias("distance"))


def automation(found: DataFrame, instances: DataFrame) -> DataFrame:
    """(id, score): how automated the templates of a message look, from what ``templates`` returns."""
    scored = found.select(F.col("id").alias("template_id"), "automation_score")
    return instances.join(scored, "template_id").groupBy("id").agg(F.max("automation_score").alias("score"))


def communities(labels: DataFrame, ranks: DataFrame, addresses: DataFrame, least: int = COMMUNITY_SIZE) -> tuple[DataFrame, DataFrame]:
    """Communities (id, size, label) and members (community_id, id, rank) from a partition (id, label)."""
    known = labels.join(ranks, "id", "left").join(addresses.select("id", "domain"), "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    group = cut(known.groupBy("label").agg(digest_id("community", F.col("id")).alias("community_id"), F.count("*").alias("size")).filter(F.col("size") >= least))
    members = known.join(group.select("label", "community_id"), "label")
    domains = members.filter("domain is not null").groupBy("community_id", "domain").agg(F.count("*").alias("n"), F.max("rank").alias("best"))
    named = domains.groupBy("community_id").agg(F.min_by("domain", F.struct(-F.col("n"), -F.col("best"), F.col("domain"))).alias("label"))
    return (
        group.join(named, "community_id", "left").select(F.col("community_id").alias("id"), "size", named["label"].alias("label")),
        members.select("community_id", "id", "rank"),
    )


def circles(facts: DataFrame, members: DataFrame, least: float = CIRCLE_SHARE) -> DataFrame:
    """(id, community_id, score): the community that holds the largest share of a message's participants."""
    people = facts.filter(F.size("participants") > 0).select("id", F.size("participants").alias("n"), F.explode("participants").alias("address"))
    hit = people.join(members.select("community_id", F.col("id").alias("address")), "address").groupBy("id", "community_id").agg((F.count("*") / F.first("n")).alias("share"))
    best = hit.filter(F.col("share") >= least).groupBy("id").agg(F.min_by(F.struct("community_id", "share"), F.struct(-F.col("share"), F.col("community_id"))).alias("b"))
    return best.select("id", "b.community_id", F.round("b.share", 6).alias("score"))


def importance(facts: DataFrame, signals: DataFrame, own: DataFrame, sender_rank: DataFrame, reply_rank: DataFrame, automation: DataFrame) -> DataFrame:
    """(id, importance, reasons) of every message. own: address; ranks: id, rank; automation: id, score."""
    mine = own.select(F.lower(F.trim("address")).alias("a")).distinct()
    to = signals.select("id", F.explode("sent_to").alias("a")).join(mine, "a", "left_semi").select("id").distinct().withColumn("direct", F.lit(True))
    by = signals.select("id", F.explode("replied_by").alias("a")).join(mine, "a", "left_semi").select("id").distinct().withColumn("by_you", F.lit(True))
    top = lambda r, c: r.agg(F.max("rank").alias(c))
    rows = (
        facts.select("id", "sender").join(signals, "id", "left").join(to, "id", "left").join(by, "id", "left")
        .join(sender_rank.select(F.col("id").alias("sender"), F.col("rank").alias("s_rank")), "sender", "left")
        .join(reply_rank.select("id", F.col("rank").alias("r_rank")), "id", "left")
        .join(automation.select("id", F.col("score").alias("auto")), "id", "left")
        .join(F.broadcast(top(sender_rank, "s_top"))).join(F.broadcast(top(reply_rank, "r_top")))  # one row each
    )
    part = lambda r, t: F.when(F.col(t) > 0, F.coalesce(r, F.lit(0.0)) / F.col(t)).otherwise(0.0)
    zero = F.lit(0.0)
    n = F.coalesce("reply_count", F.lit(0))
    s_share, auto = part("s_rank", "s_top"), F.coalesce("auto", zero)
    replies = F.when(n > 0, F.greatest(F.least(F.lit(1.0), n / 3.0), part("r_rank", "r_top"))).otherwise(zero)
    line = F.coalesce(F.size("sent_to"), F.lit(0))
    flagged = F.coalesce(F.exists("label_names", lambda x: x.isin(*FLAGS)), F.lit(False))
    on = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    strength = {
        "replied by you": on(F.col("by_you")),
        "flagged by the provider": on(flagged),
        "replies": replies,
        "sent by a central correspondent": F.when(s_share >= 0.5, s_share).otherwise(zero),
        "addressed directly": on(F.col("direct")),
        "few recipients": on(line.between(1, 3)),
        "has attachments": on(F.col("has_attachments")),
        "looks automated": F.when(auto >= 0.25, auto).otherwise(zero),
    }
    score = zero
    for reason, weight in IMPORTANCE.items():
        score = score + weight * strength[reason]
    shown = {r: F.lit(r) for r in IMPORTANCE} | {"replies": F.concat(n.cast("string"), F.when(n == 1, " reply").otherwise(" replies"))}
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(strength[r] > 0, shown[r]) for r in IMPORTANCE])))
    return rows.select("id", F.round(F.greatest(zero, F.least(F.lit(1.0), score)), 6).alias("importance"), reasons.alias("reasons"))


def suggestions(groups: DataFrame, tags: DataFrame, tagged: int = TAGGED, least: float = TAG_SHARE) -> DataFrame:
    """(tag_id, id, score, method): tags of a group's members for its other members.

    groups: kind, group_id, id; tags: tag_id, message_id. A tag needs ``tagged`` members and a share of the group.
    """
    groups = groups.distinct()
    size = groups.groupBy("kind", "group_id").agg(F.count("*").alias("size")).filter("size > 1")
    hit = groups.join(tags.select(F.col("message_id").alias("id"), "tag_id").distinct(), "id").groupBy("kind", "group_id", "tag_id").agg(F.count("*").alias("n"))
    weight = F.element_at(F.create_map(*[F.lit(x) for s in GROUPING.items() for x in s]), F.col("kind"))
    offered = hit.join(size, ["kind", "group_id"]).withColumn("share", F.col("n") / F.col("size")).filter((F.col("n") >= tagged) & (F.col("share") >= least))
    offered = offered.select("kind", "group_id", "tag_id", weight.alias("weight"), F.round(weight * F.col("share"), 6).alias("score"))
    to = offered.join(groups, ["kind", "group_id"]).join(tags.select("tag_id", F.col("message_id").alias("id")), ["tag_id", "id"], "left_anti")
    best = to.groupBy("tag_id", "id").agg(F.max_by(F.struct("score", "kind"), F.struct("score", "weight")).alias("b"))
    return best.select("tag_id", "id", "b.score", F.col("b.kind").alias("method"))
