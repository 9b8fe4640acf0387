"""Registered reads over findings, on derived tables that SQL can state too.

Threads stand for topics, nations for communities and order priorities for templates, so that
every listing and view can be checked; the queries of the derived layer itself are in ``registry``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.plans import derived, findings, reports
from mailweave.plans.findings import Findings
from mailweave.plans.registry import joined, query
from mailweave.session import cut
from mailweave.tables import Archive

#: The same tables in SQL.
FOUND = """
topics AS (SELECT 'topic:' || thread_id AS id, min(subject_norm) AS label, count(*) AS message_count,
                  CASE WHEN count(*) % 2 = 0 THEN thread_id || ',' || min(subject_norm) END AS keywords
           FROM message_threads JOIN messages ON id = message_id GROUP BY thread_id HAVING count(*) > 1),
topic_members AS (SELECT t.id AS topic_id, message_id AS id, CASE WHEN message_id % 3 = 0 THEN 'ref' ELSE 'thread' END AS method
                  FROM message_threads JOIN topics t ON t.id = 'topic:' || thread_id),
community_members AS (SELECT 'community:' || domain AS community_id, id, round(CAST(substr(id, 2) AS BIGINT) % 97 / 97.0, 6) AS rank, domain FROM addresses),
community_messages AS (
  SELECT message_id AS id, 'community:' || any_value(domain) AS community_id, round(max(k * 1.0 / size), 6) AS score FROM (
    SELECT p.message_id, domain, count(*) AS k, any_value(size) AS size FROM people p JOIN keyed USING (message_id) JOIN addresses a ON a.id = p.address_id GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY p.message_id ORDER BY count(*) * 1.0 / any_value(size) DESC, 'community:' || domain) = 1) WHERE k * 1.0 / size >= 0.5 GROUP BY 1),
communities AS (
  SELECT c.id, label, size, 'nation' AS method, coalesce(n, 0) AS message_count, first_seen, last_seen
  FROM (SELECT 'community:' || domain AS id, domain AS label, count(*) AS size FROM addresses GROUP BY domain) c LEFT JOIN (
    SELECT community_id, count(*) AS n, min(sent_at) AS first_seen, max(sent_at) AS last_seen FROM community_messages JOIN messages USING (id) GROUP BY 1) m ON m.community_id = c.id),
templates AS (SELECT 'template:' || subject_norm || ':' || d AS id, d AS direction, count(*) AS occurrences, round(count(*) / 100000.0, 6) AS automation_score,
                     subject_norm AS sample_text, min(sent_at) AS first_seen, max(sent_at) AS last_seen
              FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'sent' ELSE 'received' END AS d FROM messages) GROUP BY subject_norm, d),
importance AS (SELECT id, CASE WHEN id % 10 <> 0 THEN round(id % 101 / 101.0, 6) END AS importance, CASE WHEN id % 2 = 0 THEN 'replies' ELSE 'few recipients' END AS reasons FROM messages),
tags AS (SELECT * FROM (VALUES ('tag:good', 'Good', '#00aa00'), ('tag:toxic', 'Toxic', NULL), ('tag:unused', 'Unused', NULL)) v(tag_id, name, color)),
sender AS (SELECT message_id, min(address_id) AS sender FROM recipients WHERE role = 'FROM' GROUP BY 1)
"""


def planted(a: Archive) -> Findings:
    spark = a.messages.sparkSession
    key = F.concat(F.lit("topic:"), "thread_id")
    sent = a.message_threads.join(a.messages, F.col("message_id") == F.col("id"))
    topics = sent.groupBy("thread_id").agg(F.min("subject_norm").alias("label"), F.count("*").alias("message_count")).filter("message_count > 1")
    topics = topics.select(key.alias("id"), "label", "message_count", F.when(F.col("message_count") % 2 == 0, F.array("thread_id", "label")).alias("keywords"))
    method = F.when(F.col("message_id") % 3 == 0, "ref").otherwise("thread")
    members = a.message_threads.select(key.alias("topic_id"), F.col("message_id").alias("id"), method.alias("method"), F.lit(0.8).alias("score"))
    circle = F.concat(F.lit("community:"), "domain")
    people = a.addresses.select(circle.alias("community_id"), "id", F.round(F.substring("id", 2, 20).cast("long") % 97 / 97.0, 6).alias("rank"))
    communities = a.addresses.groupBy("domain").agg(F.count("*").alias("size")).select(circle.alias("id"), F.col("domain").alias("label"), "size", F.lit("nation").alias("method"))
    direction = F.when(F.col("id") % 2 == 0, "sent").otherwise("received")
    templates = a.messages.withColumn("direction", direction).groupBy("subject_norm", "direction").agg(F.count("*").alias("occurrences"), F.min("sent_at").alias("first_seen"), F.max("sent_at").alias("last_seen"))
    templates = templates.select(F.concat_ws(":", F.lit("template"), "subject_norm", "direction").alias("id"), "direction", "occurrences", F.round(F.col("occurrences") / 100000.0, 6).alias("automation_score"), F.col("subject_norm").alias("sample_text"), "first_seen", "last_seen")
    importance = a.messages.select("id", F.when(F.col("id") % 10 != 0, F.round(F.col("id") % 101 / 101.0, 6)).alias("importance"), F.array(F.when(F.col("id") % 2 == 0, "replies").otherwise("few recipients")).alias("reasons"))
    tags = spark.createDataFrame([("tag:good", "Good", "#00aa00"), ("tag:toxic", "Toxic", None), ("tag:unused", "Unused", None)], "tag_id string, name string, color string")
    return Findings(
        topics=topics, topic_members=members.join(topics.select(F.col("id").alias("topic_id")), "topic_id", "left_semi"), communities=communities, community_members=people,
        community_messages=derived.circles(reports.facts(a), people), templates=templates, importance=importance, tags=tags,
    )


def held(f: Findings) -> Findings:
    """The findings with the mail of communities as a table, for reads that need it more than once."""
    return replace(f, community_messages=cut(f.community_messages))


def read(sql: str):
    """Register a query over the archive and the planted findings."""

    def named(f):
        def run(a: Archive) -> DataFrame:
            return f(a, planted(a))

        run.__name__ = f.__name__
        return query(f", {FOUND} {sql}")(run)

    return named


@read("SELECT id, occurrences, automation_score, sample_text, first_seen, last_seen FROM templates WHERE direction = 'sent' ORDER BY 3 DESC, 1 LIMIT 50")
def top_templates(a: Archive, f: Findings) -> DataFrame:
    return findings.top_templates(f, "sent")


@read("SELECT t.id, label, method, count(*) AS messages FROM topics t JOIN topic_members m ON topic_id = t.id GROUP BY ALL ORDER BY 4 DESC, 1, 3 LIMIT 50")
def topic_breakdown(a: Archive, f: Findings) -> DataFrame:
    return findings.topic_breakdown(f)


@read("SELECT id, label, size, message_count, method, first_seen, last_seen FROM communities ORDER BY message_count DESC, id LIMIT 50")
def top_communities(a: Archive, f: Findings) -> DataFrame:
    return findings.top_communities(a, f)


@read("SELECT id, subject_norm, sent_at, sender, importance, reasons FROM importance JOIN messages USING (id) LEFT JOIN sender ON message_id = id WHERE importance IS NOT NULL ORDER BY importance DESC, id LIMIT 50")
def top_important(a: Archive, f: Findings) -> DataFrame:
    return findings.top_important(a, f).withColumns(joined("reasons"))


@read("SELECT id, label, keywords, message_count FROM topics WHERE keywords IS NOT NULL ORDER BY 4 DESC, 1 LIMIT 50")
def keyword_listing(a: Archive, f: Findings) -> DataFrame:
    return findings.keyword_listing(f).withColumns(joined("keywords"))


@read("SELECT m.id AS message_id, topic_id, label, keywords FROM topic_members m JOIN topics t ON t.id = topic_id")
def topics_of_messages(a: Archive, f: Findings) -> DataFrame:
    return findings.topics_of_messages(f, a.messages).withColumns(joined("keywords"))


@read(""", g AS (SELECT participant_key, max(size) AS size, count(*) AS message_count FROM keyed JOIN messages ON id = message_id GROUP BY 1 HAVING max(size) >= 2 AND count(*) >= 2)
SELECT message_id, participant_key AS group_id, CAST(g.size AS BIGINT) AS size, message_count FROM keyed JOIN g USING (participant_key)""")
def groups_of_messages(a: Archive, f: Findings) -> DataFrame:
    members = reports.participants(a).select("participant_key", F.col("message_id").alias("id"))
    return findings.groups_of_messages(members, reports.recurring_groups(a, 2, 2), a.messages)


@read("""SELECT 'topics' AS name, count(*) AS total FROM topics UNION ALL SELECT 'templates', count(*) FROM templates UNION ALL SELECT 'communities', count(*) FROM communities
UNION ALL SELECT 'co_addressed', count(*) FROM pairs""")
def finding_counts(a: Archive, f: Findings) -> DataFrame:
    return findings.finding_counts(f, co_addressed=reports.addressed_pairs(a))


@read("SELECT t.id, label, message_count, method FROM topic_members m JOIN topics t ON t.id = topic_id WHERE m.id = 100")
def message_topics(a: Archive, f: Findings) -> DataFrame:
    return findings.message_topics(f, 100)


@read("SELECT DISTINCT tag_id AS id, name, color FROM message_tags JOIN tags USING (tag_id) WHERE message_id = (SELECT min(message_id) FROM message_tags)")
def message_tags(a: Archive, f: Findings) -> DataFrame:
    return findings.message_tags(a, f, a.message_tags.agg(F.min("message_id")).first()[0])


@read("SELECT c.id, label, size, message_count, score FROM community_messages m JOIN communities c ON c.id = community_id WHERE m.id = (SELECT min(id) FROM community_messages)")
def message_circle(a: Archive, f: Findings) -> DataFrame:
    f = held(f)
    return findings.message_circle(a, f, f.community_messages.agg(F.min("id")).first()[0])


@read("""SELECT m.id, subject_norm, sent_at, importance, method FROM topic_members m JOIN messages USING (id) LEFT JOIN importance i ON i.id = m.id
WHERE topic_id = (SELECT min(id) FROM topics) ORDER BY importance DESC NULLS LAST, 1, 5 LIMIT 50""")
def members_of_topic(a: Archive, f: Findings) -> DataFrame:
    return findings.topic_members(a, f, f.topics.agg(F.min("id")).first()[0])


@read("""SELECT address_id, count(DISTINCT message_id) AS messages FROM recipients WHERE role <> 'BCC' AND message_id IN (SELECT id FROM topic_members WHERE topic_id = (SELECT min(id) FROM topics))
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def topic_participants(a: Archive, f: Findings) -> DataFrame:
    from mailweave.plans import explorer

    return explorer.topic_participants(a, f.topic_members, f.topics.agg(F.min("id")).first()[0])


@read("SELECT id, domain, rank FROM community_members WHERE community_id = (SELECT min(id) FROM communities) ORDER BY 3 DESC, 1 LIMIT 50")
def community_members(a: Archive, f: Findings) -> DataFrame:
    return findings.community_members(a, f, f.communities.agg(F.min("id")).first()[0])


@read("""SELECT m.id, subject_norm, sent_at, importance, score FROM community_messages m JOIN messages USING (id) LEFT JOIN importance i ON i.id = m.id
WHERE community_id = (SELECT min(community_id) FROM community_messages) ORDER BY score DESC, 1 LIMIT 50""")
def community_messages(a: Archive, f: Findings) -> DataFrame:
    f = held(f)
    return findings.community_messages(a, f, f.community_messages.agg(F.min("community_id")).first()[0])


@read("SELECT id, label, message_count FROM topics ORDER BY 3 DESC, 1 LIMIT 50")
def overview_topics(a: Archive, f: Findings) -> DataFrame:
    return findings.overview_topics(f)


@read("SELECT id, label, size, message_count FROM communities ORDER BY 4 DESC, 1 LIMIT 50")
def overview_communities(a: Archive, f: Findings) -> DataFrame:
    return findings.overview_communities(a, f)


@read("SELECT tag_id AS id, name, count(DISTINCT message_id) AS messages FROM tags LEFT JOIN message_tags USING (tag_id) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 50")
def overview_tags(a: Archive, f: Findings) -> DataFrame:
    return findings.overview_tags(a, f)


@read("SELECT topic_id, community_id, count(DISTINCT id) AS messages FROM topic_members JOIN community_messages USING (id) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50")
def overview_topic_circle(a: Archive, f: Findings) -> DataFrame:
    return findings.overview_topic_circle(f)


@read("SELECT tag_id, topic_id, count(DISTINCT id) AS messages FROM topic_members JOIN message_tags ON message_id = id GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50")
def overview_tag_topic(a: Archive, f: Findings) -> DataFrame:
    return findings.overview_tag_topic(a, f)


@read("""SELECT topic_id, t.label, m.id, subject_norm, sender, sent_at, '' AS preview, coalesce(importance, 0) AS importance, message_count > least(message_count, 3) AS truncated
FROM (SELECT * FROM topic_members JOIN importance USING (id) WHERE topic_id = (SELECT min(id) FROM topics) ORDER BY importance DESC NULLS LAST, id LIMIT 3) m
JOIN topics t ON t.id = topic_id JOIN messages x ON x.id = m.id LEFT JOIN sender ON message_id = m.id""")
def topic_reading(a: Archive, f: Findings) -> DataFrame:
    return findings.topic_reading(a, f, f.topics.agg(F.min("id")).first()[0], 3)


# --- views: nodes with their degree --------------------------------------------------------


def _view(nodes: str, edges: str) -> str:
    return f""", n AS (SELECT id, kind, coalesce(min(nullif(label, '')), '') AS label FROM ({nodes}) x(id, kind, label) GROUP BY 1, 2),
e AS (SELECT DISTINCT source, target, kind FROM ({edges}) x(source, target, kind) WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n))
SELECT id, kind, label, (SELECT count(*) FROM e WHERE source = n.id) + (SELECT count(*) FROM e WHERE target = n.id) AS degree FROM n"""


def _seen(sub) -> DataFrame:
    return sub.degrees().select("id", "kind", F.coalesce("label", F.lit("")).alias("label"), "degree")


_TOPIC = "(SELECT min(id) FROM topics)"
_CIRCLE = "(SELECT min(community_id) FROM community_messages)"
_TOPIC_MAIL = f"SELECT m.id FROM topic_members m LEFT JOIN importance i ON i.id = m.id WHERE topic_id = {_TOPIC} ORDER BY importance DESC NULLS LAST, 1 LIMIT 100"
_TOPIC_PEOPLE = f"""SELECT address_id FROM recipients WHERE role <> 'BCC' AND message_id IN (SELECT id FROM topic_members WHERE topic_id = {_TOPIC})
GROUP BY 1 ORDER BY count(DISTINCT message_id) DESC, 1 LIMIT 100"""


@read(_view(
    f"""SELECT id, 'topic', label FROM topics WHERE id = {_TOPIC} UNION ALL SELECT CAST(id AS VARCHAR), 'message', subject_norm FROM ({_TOPIC_MAIL}) JOIN messages USING (id)
    UNION ALL SELECT address_id, 'address', address_id FROM ({_TOPIC_PEOPLE})""",
    f"SELECT CAST(id AS VARCHAR), {_TOPIC}, 'ABOUT' FROM ({_TOPIC_MAIL}) UNION ALL SELECT address_id, {_TOPIC}, 'PARTICIPATES' FROM ({_TOPIC_PEOPLE})",
))
def topic_view(a: Archive, f: Findings) -> DataFrame:
    return _seen(findings.topic_view(a, f, f.topics.agg(F.min("id")).first()[0]))


_MAIL_OF = """SELECT id, CASE role WHEN 'FROM' THEN 'SENT_FROM' WHEN 'TO' THEN 'SENT_TO' ELSE 'COPIED_TO' END AS edge FROM recipients JOIN messages ON id = message_id
WHERE address_id = 's1' AND role <> 'BCC' ORDER BY sent_at DESC, id, edge LIMIT 100"""
_NEAR = """SELECT CASE WHEN "left" = 's1' THEN "right" ELSE "left" END AS other FROM pairs WHERE 's1' IN ("left", "right") ORDER BY n DESC, 1 LIMIT 100"""


@read(_view(
    f"SELECT 's1', 'address', 's1' UNION ALL SELECT CAST(id AS VARCHAR), 'message', '' FROM ({_MAIL_OF}) UNION ALL SELECT other, 'address', other FROM ({_NEAR})",
    f"SELECT CAST(id AS VARCHAR), 's1', edge FROM ({_MAIL_OF}) UNION ALL SELECT 's1', other, 'CO_ADDRESSED' FROM ({_NEAR})",
))
def address_view(a: Archive, f: Findings) -> DataFrame:
    return _seen(findings.address_view(a, reports.addressed_pairs(a), "s1"))


_TAGGED = "SELECT id FROM message_tags JOIN messages ON id = message_id WHERE tag_id = 'tag:good' ORDER BY sent_at DESC NULLS LAST, id LIMIT 100"


@read(_view(f"SELECT 'tag:good', 'tag', 'Good' UNION ALL SELECT CAST(id AS VARCHAR), 'message', '' FROM ({_TAGGED})", f"SELECT CAST(id AS VARCHAR), 'tag:good', 'TAGGED' FROM ({_TAGGED})"))
def tag_view(a: Archive, f: Findings) -> DataFrame:
    return _seen(findings.tag_view(a, f, "tag:good"))


@read(_view(
    f"""SELECT id, 'topic', label FROM topics WHERE id = {_TOPIC} UNION ALL SELECT CAST(id AS VARCHAR), 'message', subject_norm FROM ({_TOPIC_MAIL}) JOIN messages USING (id)
    UNION ALL SELECT address_id, 'address', address_id FROM ({_TOPIC_PEOPLE})""",
    f"SELECT CAST(id AS VARCHAR), {_TOPIC}, 'ABOUT' FROM ({_TOPIC_MAIL}) UNION ALL SELECT address_id, {_TOPIC}, 'PARTICIPATES' FROM ({_TOPIC_PEOPLE})",
))
def expanded_topic(a: Archive, f: Findings) -> DataFrame:
    """One hop out of a topic; its view, as a picture lays it over what is drawn."""
    return _seen(findings.expand(a, f, reports.addressed_pairs(a), f.topics.agg(F.min("id")).first()[0], "topic"))


@read(_view(f"SELECT 'tag:good', 'tag', 'Good' UNION ALL SELECT CAST(id AS VARCHAR), 'message', '' FROM ({_TAGGED})", f"SELECT CAST(id AS VARCHAR), 'tag:good', 'TAGGED' FROM ({_TAGGED})"))
def expanded_tag(a: Archive, f: Findings) -> DataFrame:
    return _seen(findings.expand(a, f, reports.addressed_pairs(a), "tag:good", "tag"))


_CIRCLE_PEOPLE = f"SELECT id FROM community_members WHERE community_id = {_CIRCLE} ORDER BY rank DESC, id LIMIT 100"
_CIRCLE_MAIL = f"SELECT id FROM community_messages WHERE community_id = {_CIRCLE} ORDER BY score DESC, id LIMIT 100"


@read(_view(
    f"""SELECT id, 'community', label FROM communities WHERE id = {_CIRCLE} UNION ALL SELECT id, 'address', id FROM ({_CIRCLE_PEOPLE})
    UNION ALL SELECT CAST(id AS VARCHAR), 'message', subject_norm FROM ({_CIRCLE_MAIL}) JOIN messages USING (id)""",
    f"SELECT id, {_CIRCLE}, 'MEMBER_OF' FROM ({_CIRCLE_PEOPLE}) UNION ALL SELECT CAST(id AS VARCHAR), {_CIRCLE}, 'IN_CIRCLE' FROM ({_CIRCLE_MAIL})",
))
def community_view(a: Archive, f: Findings) -> DataFrame:
    f = held(f)
    return _seen(findings.community_view(a, f, f.community_messages.agg(F.min("community_id")).first()[0]))


@read(_view(
    """SELECT * FROM (SELECT id, 'topic', label FROM topics ORDER BY message_count DESC, id LIMIT 100) UNION ALL SELECT * FROM (SELECT id, 'community', label FROM communities ORDER BY message_count DESC, id LIMIT 100)
    UNION ALL SELECT tag_id, 'tag', name FROM tags""",
    """SELECT * FROM (SELECT topic_id, community_id, 'OVERLAPS' FROM topic_members JOIN community_messages USING (id) GROUP BY 1, 2 ORDER BY count(DISTINCT id) DESC, 1, 2 LIMIT 100)
    UNION ALL SELECT * FROM (SELECT tag_id, topic_id, 'OVERLAPS' FROM topic_members JOIN message_tags ON message_id = id GROUP BY 1, 2 ORDER BY count(DISTINCT id) DESC, 1, 2 LIMIT 100)""",
))
def overview(a: Archive, f: Findings) -> DataFrame:
    f = held(f)
    return _seen(findings.overview(a, f))


@read(""", b AS (SELECT "left" AS s, "right" AS t FROM pairs UNION ALL SELECT "right", "left" FROM pairs),
p AS (SELECT ['s1', 's2'] AS n FROM b WHERE s = 's1' AND t = 's2' UNION ALL SELECT ['s1', x.t, 's2'] FROM b x JOIN b y ON x.t = y.s WHERE x.s = 's1' AND y.t = 's2'
  UNION ALL SELECT ['s1', x.t, y.t, 's2'] FROM b x JOIN b y ON x.t = y.s JOIN b z ON y.t = z.s WHERE x.s = 's1' AND z.t = 's2' AND x.t <> 's2' AND y.t <> 's1'),
r AS (SELECT n FROM p ORDER BY len(n), n LIMIT 3), steps AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT n[i] AS a, n[i + 1] AS b FROM r, unnest(range(1, len(n))) u(i)))
SELECT id, 'address' AS kind, id AS label, (SELECT count(*) FROM steps WHERE id IN (a, b)) AS degree FROM (SELECT DISTINCT unnest(n) AS id FROM r)""")
def path_view(a: Archive, f: Findings) -> DataFrame:
    return _seen(findings.path_view(reports.addressed_pairs(a), "s1", "s2", 3))


@read("""SELECT "left", "right", count, CAST(place AS INTEGER) AS place FROM (SELECT s AS "left", t AS "right", CAST(n AS BIGINT) AS count, row_number() OVER (PARTITION BY s ORDER BY n DESC, t) AS place
FROM (SELECT "left" AS s, "right" AS t, n FROM pairs UNION ALL SELECT "right", "left", n FROM pairs)) WHERE place <= 5""")
def heaviest_neighbours(a: Archive, f: Findings) -> DataFrame:
    return findings.heaviest_neighbours(reports.addressed_pairs(a), 5)


@read("""SELECT source, target, kind, round(weight / max(weight) OVER (), 6) AS weight FROM (
  SELECT CAST(id AS VARCHAR) AS source, 's1' AS target, edge AS kind, 1.0 AS weight FROM (SELECT id, CASE role WHEN 'FROM' THEN 'SENT_FROM' WHEN 'TO' THEN 'SENT_TO' ELSE 'COPIED_TO' END AS edge
    FROM recipients JOIN messages ON id = message_id WHERE address_id = 's1' AND role <> 'BCC' ORDER BY sent_at DESC, id, edge LIMIT 100)
  UNION ALL SELECT 's1', other, 'CO_ADDRESSED', n FROM (SELECT CASE WHEN "left" = 's1' THEN "right" ELSE "left" END AS other, n FROM pairs WHERE 's1' IN ("left", "right") ORDER BY n DESC, 1 LIMIT 100))""")
def address_view_weights(a: Archive, f: Findings) -> DataFrame:
    """Edges within one hop of the address, with weights as shares of the heaviest."""
    sub = findings.address_view(a, reports.addressed_pairs(a), "s1").within("s1", 1)
    return sub.normalised().withColumn("weight", F.round("weight", 6))
