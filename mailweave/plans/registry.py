"""Registered queries of the archive engine over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions import text
from mailweave.operators import algebra, graph
from mailweave.plans import derived, explorer, listing, neighbours, reports, semantic, tags
from mailweave.plans.listing import Filters
from mailweave.plans.postings import PostingsIndex
from mailweave.sources import mail
from mailweave.session import cut, scratch_dir, spread
from mailweave.tables import Archive, driver_archive, load

Query = Callable[[SparkSession, str], DataFrame]

#: The archive of the driver's tables, in SQL.
ARCHIVE = """
messages AS (SELECT o_orderkey AS id, o_orderpriority AS subject_norm, o_orderdate AS sent_at,
                    CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders),
recipients AS (
  SELECT o_orderkey AS message_id, 'c' || o_custkey AS address_id, 'FROM' AS role FROM orders
  UNION ALL
  SELECT DISTINCT l_orderkey, 's' || l_suppkey,
         CASE l_returnflag WHEN 'N' THEN 'TO' WHEN 'R' THEN 'CC' ELSE 'BCC' END FROM lineitem),
addresses AS (
  SELECT 'c' || c_custkey AS id, n_name AS domain, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
accounts AS (SELECT 'c' || c_custkey AS address FROM customer WHERE c_mktsegment = 'BUILDING'),
message_threads AS (SELECT o_orderkey AS message_id, 't' || o_custkey AS thread_id FROM orders),
replies AS (SELECT child, parent FROM (
  SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders)
  WHERE parent IS NOT NULL AND child % 2 = 0),
message_labels AS (SELECT o_orderkey AS message_id, o_orderstatus AS name FROM orders),
message_attachments AS (SELECT DISTINCT l_orderkey AS message_id, l_partkey AS sha, p_name AS filename, p_type AS content_type
                        FROM lineitem JOIN part ON l_partkey = p_partkey),
copies AS (SELECT event_id AS message_id, user_id AS account, ts AS archived_at, CAST(floor(value) AS BIGINT) AS size_bytes FROM events),
message_tags AS (SELECT doc_id AS message_id, 'tag:good' AS tag_id FROM labels WHERE quality = 1
                 UNION ALL SELECT doc_id, 'tag:toxic' FROM labels WHERE toxic = 1),
addressed AS (SELECT DISTINCT message_id, address_id FROM recipients WHERE role IN ('TO', 'CC')),
pairs AS (
  SELECT l.address_id AS "left", r.address_id AS "right", count(*) AS n, min(m.sent_at) AS first_seen, max(m.sent_at) AS last_seen
  FROM addressed l JOIN addressed r ON l.message_id = r.message_id AND l.address_id < r.address_id
  JOIN messages m ON m.id = l.message_id GROUP BY ALL),
people AS (SELECT DISTINCT message_id, address_id FROM recipients),
keyed AS (SELECT message_id, sha256(string_agg(address_id, '|' ORDER BY address_id)) AS participant_key, count(*) AS size
          FROM people GROUP BY message_id)
"""

_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, archive: bool = True):
    """Register a function under its name; its SQL starts after the archive's tables."""

    def add(f):
        run = (lambda spark, sf_dir: f(driver_archive(spark, sf_dir))) if archive else f
        _QUERIES[f.__name__] = (run, None if sql is None else f"WITH {ARCHIVE}{sql}" if sql.lstrip().startswith(",") else f"WITH {ARCHIVE} {sql}" if archive else sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}


def joined(*columns: str):
    """Arrays as text, so that every engine compares them alike."""
    return {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns}


# --- reports -------------------------------------------------------------------------------


@query('SELECT "left", "right", CAST(n AS BIGINT) AS messages FROM pairs ORDER BY n DESC, 1, 2 LIMIT 50')
def co_recipients(a: Archive) -> DataFrame:
    return reports.co_recipients(a, 50)


@query('SELECT "left", "right", CAST(n AS BIGINT) AS count, first_seen, last_seen FROM pairs')
def addressed_pairs(a: Archive) -> DataFrame:
    return reports.addressed_pairs(a)


@query(""", w AS (SELECT message_id FROM addressed GROUP BY 1 HAVING count(*) <= 3)
SELECT l.address_id AS "left", r.address_id AS "right", count(*) AS count, min(m.sent_at) AS first_seen, max(m.sent_at) AS last_seen
FROM addressed l JOIN addressed r ON l.message_id = r.message_id AND l.address_id < r.address_id
JOIN w ON w.message_id = l.message_id JOIN messages m ON m.id = l.message_id GROUP BY 1, 2""")
def addressed_pairs_narrow(a: Archive) -> DataFrame:
    """Messages with more than three addressed are left out."""
    return reports.addressed_pairs(a, 3)


@query("SELECT count(*) AS wide FROM (SELECT 1 FROM addressed GROUP BY message_id HAVING count(*) > 5)")
def wide_messages(a: Archive) -> DataFrame:
    return reports.wide_messages(a, 5)


@query('SELECT "left", "right", CAST(n AS BIGINT) AS count, first_seen, last_seen FROM pairs ORDER BY n DESC, 1, 2 LIMIT 20')
def top_co_addressed(a: Archive) -> DataFrame:
    return reports.top_pairs(reports.addressed_pairs(a), 20)


@query("""SELECT 'matched' AS verdict, least(count(*), 100) AS pairs FROM pairs HAVING count(*) > 0""")
def co_addressed_agreement(a: Archive) -> DataFrame:
    pairs = reports.addressed_pairs(a)
    truth = reports.co_recipients(a, reports.MOST_ROWS).withColumnRenamed("messages", "count")
    return reports.agreement(truth, pairs, 100)


@query("""SELECT participant_key, CAST(max(size) AS BIGINT) AS size, count(*) AS message_count, min(sent_at) AS first_seen, max(sent_at) AS last_seen
FROM keyed JOIN messages ON id = message_id GROUP BY 1 HAVING max(size) >= 2 AND count(*) >= 2""")
def recurring_groups(a: Archive) -> DataFrame:
    return reports.recurring_groups(a, 2, 2)


@query("SELECT participant_key, message_id AS id, CAST(size AS BIGINT) AS size FROM keyed")
def participant_keys(a: Archive) -> DataFrame:
    return reports.participants(a).select("participant_key", F.col("message_id").alias("id"), F.size("people").cast("long").alias("size"))


@query("""SELECT CAST(archived_at AS DATE) AS day, count(*) AS copies, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes
FROM copies WHERE archived_at IS NOT NULL GROUP BY 1""")
def archived_per_day(a: Archive) -> DataFrame:
    return reports.archived_per_day(a)


@query(""", last AS (SELECT CAST(max(archived_at) AS DATE) AS d FROM copies),
cal AS (SELECT CAST(unnest(generate_series(CAST('2024-01-20' AS DATE) - 13, CAST('2024-01-20' AS DATE), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, count(c.message_id) AS copies, CAST(coalesce(sum(c.size_bytes), 0) AS BIGINT) AS bytes
FROM cal LEFT JOIN copies c ON CAST(c.archived_at AS DATE) = cal.day GROUP BY day""")
def archived_calendar(a: Archive) -> DataFrame:
    return reports.archived_calendar(a, "2024-01-20", 14)


@query("""SELECT 'addresses' AS name, count(*) AS n FROM addresses UNION ALL SELECT 'copies', count(*) FROM copies
UNION ALL SELECT 'messages', count(*) FROM messages UNION ALL SELECT 'recipients', count(*) FROM recipients
UNION ALL SELECT 'replies', count(*) FROM replies UNION ALL SELECT 'tagged', count(*) FROM message_tags""")
def totals(a: Archive) -> DataFrame:
    return reports.totals(addresses=a.addresses, copies=a.copies, messages=a.messages, recipients=a.recipients, replies=a.replies, tagged=a.message_tags)


@query("""SELECT m.id,
  coalesce((SELECT string_agg(DISTINCT address_id, ',' ORDER BY address_id) FROM recipients r WHERE r.message_id = m.id AND role = 'FROM'), '') AS senders,
  coalesce((SELECT string_agg(DISTINCT address_id, ',' ORDER BY address_id) FROM recipients r WHERE r.message_id = m.id AND role IN ('TO', 'CC')), '') AS addressed,
  coalesce((SELECT string_agg(DISTINCT address_id, ',' ORDER BY address_id) FROM recipients r WHERE r.message_id = m.id AND role = 'BCC'), '') AS blind_copied,
  coalesce((SELECT string_agg(DISTINCT thread_id, ',' ORDER BY thread_id) FROM message_threads t WHERE t.message_id = m.id), '') AS threads,
  coalesce((SELECT string_agg(CAST(sha AS VARCHAR), ',' ORDER BY sha) FROM message_attachments f WHERE f.message_id = m.id), '') AS attachments
FROM messages m""")
def message_relations(a: Archive) -> DataFrame:
    return reports.message_relations(a).withColumns(joined("senders", "addressed", "blind_copied", "threads", "attachments"))


@query("""SELECT m.id,
  coalesce((SELECT string_agg(DISTINCT address_id, ',' ORDER BY address_id) FROM recipients r WHERE r.message_id = m.id AND role = 'TO'), '') AS sent_to,
  (SELECT count(DISTINCT child) FROM replies p WHERE p.parent = m.id) AS reply_count,
  coalesce((SELECT string_agg(DISTINCT address_id, ',' ORDER BY address_id) FROM replies p JOIN recipients r ON r.message_id = p.child AND role = 'FROM' WHERE p.parent = m.id), '') AS replied_by,
  coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM message_labels l WHERE l.message_id = m.id), '') AS label_names,
  EXISTS (SELECT 1 FROM message_attachments f WHERE f.message_id = m.id) AS has_attachments
FROM messages m""")
def message_signals(a: Archive) -> DataFrame:
    return reports.message_signals(a).withColumns(joined("sent_to", "replied_by", "label_names"))


@query("SELECT count(*) FILTER (id IS NULL OR CAST(id AS VARCHAR) = '') AS unidentified, count(*) AS messages FROM messages")
def unidentified(a: Archive) -> DataFrame:
    return reports.unidentified(a)


@query("SELECT child, min(parent) AS parent FROM replies GROUP BY child")
def message_parents(a: Archive) -> DataFrame:
    return reports.parents(a)


@query("""SELECT m.id, m.sent_at, subject_norm, s.sender, coalesce(k.participant_key, '') AS participant_key, t.thread_id,
  s.sender IN (SELECT address FROM accounts) AS outbound, CAST(coalesce(k.size, 0) AS BIGINT) AS people
FROM messages m LEFT JOIN (SELECT message_id, min(address_id) AS sender FROM recipients WHERE role = 'FROM' GROUP BY 1) s ON s.message_id = m.id
LEFT JOIN keyed k ON k.message_id = m.id LEFT JOIN (SELECT message_id, min(thread_id) AS thread_id FROM message_threads GROUP BY 1) t ON t.message_id = m.id""")
def message_facts(a: Archive) -> DataFrame:
    return reports.facts(a).select("id", "sent_at", "subject_norm", "sender", "participant_key", "thread_id", "outbound", F.size("participants").cast("long").alias("people"))


# --- listing, search, facets ---------------------------------------------------------------


@query("""SELECT id, sent_at, subject_norm, min(address_id) AS sender FROM
(SELECT * FROM messages ORDER BY sent_at DESC NULLS LAST, id LIMIT 50 OFFSET 100) m LEFT JOIN recipients r ON r.message_id = id AND role = 'FROM' GROUP BY 1, 2, 3""")
def find_recent(a: Archive) -> DataFrame:
    return listing.find_recent(a, 50, 100)


_FILTERS = Filters(senders=[f"c{i}" for i in range(1, 200)], recipients=["s1", "s2", "s3", "s4", "s5"], sent_from="1993-01-01", sent_until="1997-06-30", has_attachments=True)
_FILTER_SQL = """FROM messages m WHERE
  EXISTS (SELECT 1 FROM recipients r WHERE r.message_id = m.id AND role = 'FROM' AND CAST(substr(address_id, 2) AS BIGINT) BETWEEN 1 AND 199)
  AND EXISTS (SELECT 1 FROM recipients r WHERE r.message_id = m.id AND role IN ('TO', 'CC') AND address_id IN ('s1', 's2', 's3', 's4', 's5'))
  AND strftime(sent_at, '%Y-%m-%dT%H:%M:%S') >= '1993-01-01' AND strftime(sent_at, '%Y-%m-%dT%H:%M:%S') <= '1997-06-30T23:59:59'
  AND EXISTS (SELECT 1 FROM message_attachments f WHERE f.message_id = m.id)"""


@query(f"SELECT id, sent_at, subject_norm {_FILTER_SQL} ORDER BY sent_at DESC NULLS LAST, id LIMIT 50")
def find_filtered(a: Archive) -> DataFrame:
    return listing.find_filtered(a, _FILTERS, 50)


@query(f"SELECT count(*) AS total {_FILTER_SQL}")
def count_filtered(a: Archive) -> DataFrame:
    return listing.count_filtered(a, _FILTERS)


@query("""SELECT count(*) AS total FROM (SELECT message_id FROM recipients WHERE role IN ('TO', 'CC') AND address_id IN ('s1', 's2')
GROUP BY 1 HAVING count(DISTINCT address_id) = 2)""")
def recipients_all(a: Archive) -> DataFrame:
    return listing.count_filtered(a, Filters(recipients=["s1", "s2"], recipients_all=True))


@query("SELECT count(*) AS total FROM messages WHERE id IN (SELECT message_id FROM copies WHERE account = 7)")
def account_filter(a: Archive) -> DataFrame:
    return listing.count_filtered(a, Filters(account=7))


@query("""SELECT count(DISTINCT message_id) AS total FROM message_attachments WHERE content_type LIKE 'PROMO%' OR filename = 'none'""")
def file_filter(a: Archive) -> DataFrame:
    kinds = [f"{x} {y} {z}" for x in ("PROMO",) for y in ("ANODIZED", "BRUSHED", "BURNISHED", "PLATED", "POLISHED") for z in ("BRASS", "COPPER", "NICKEL", "STEEL", "TIN")]
    return listing.count_filtered(a, Filters(content_types=[*kinds, "PROMO%"], filenames=["none"]))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


_POSTINGS = r"""t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
p AS (SELECT term, id, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT id, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
hit AS (SELECT p.*, l.n FROM p JOIN l USING (id) WHERE term IN ('the', 'with', 'for')),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
score AS (SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score, count(*) AS k
          FROM hit JOIN df USING (term), s GROUP BY id)"""


@query(f"WITH {_POSTINGS} SELECT id, score FROM score WHERE k = 3 ORDER BY score DESC, id LIMIT 50", archive=False)
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.full_text(listing.postings(_texts(spark, sf_dir)), "the for WITH", 50)


@query(f"WITH {_POSTINGS} SELECT id, score FROM score WHERE k = 3 ORDER BY score DESC, id LIMIT 50", archive=False)
def full_text_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index that was written in three batches, two of them merged."""
    texts = _texts(spark, sf_dir)
    index = PostingsIndex(spark, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}")
    for k in range(3):
        index.add(texts.filter(F.pmod(F.col("id"), F.lit(3)) == k), f"batch-{k}")
    index.merge("merged", ["batch-0", "batch-1"])
    return index.search("the for WITH", 50)


@query(f"""WITH {_POSTINGS}, page AS (SELECT id, score FROM score WHERE k = 3 ORDER BY score DESC, id LIMIT 50)
SELECT id, round(score / max(score) OVER (), 6) AS score FROM page""", archive=False)
def full_text_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.scaled(listing.full_text(listing.postings(_texts(spark, sf_dir)), "the for with", 50))


@query(r"""SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences FROM
(SELECT term, id, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL)
GROUP BY term""", archive=False)
def postings_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.postings(_texts(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@query("SELECT address_id, count(DISTINCT message_id) AS messages FROM recipients WHERE role = 'FROM' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def facet_senders(a: Archive) -> DataFrame:
    return listing.facet_addresses(a, ("FROM",))


@query("SELECT address_id, count(DISTINCT message_id) AS messages FROM recipients WHERE role IN ('TO', 'CC') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def facet_recipients(a: Archive) -> DataFrame:
    return listing.facet_addresses(a, ("TO", "CC"))


@query("SELECT id, domain, name FROM addresses")
def address_directory(a: Archive) -> DataFrame:
    return a.addresses


@query("SELECT content_type, count(DISTINCT message_id) AS messages FROM message_attachments GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def facet_content_types(a: Archive) -> DataFrame:
    return listing.facet_content_types(a)


@query("""SELECT message_id AS id, min(thread_id) AS thread_id, any_value(n) AS size FROM message_threads JOIN
(SELECT thread_id, count(DISTINCT message_id) AS n FROM message_threads GROUP BY 1) USING (thread_id) GROUP BY 1""")
def conversations_of(a: Archive) -> DataFrame:
    return listing.conversations_of(a, a.messages.select("id"))


@query("""SELECT thread_id, id, CAST(place AS INTEGER) AS place FROM (SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC NULLS LAST, id) AS place
FROM message_threads JOIN messages ON id = message_id) WHERE place <= 5""")
def conversation_members(a: Archive) -> DataFrame:
    return listing.conversation_members(a, a.message_threads.select("thread_id").distinct(), 5)


@query("""SELECT message_id AS id, string_agg(DISTINCT name, ',' ORDER BY name) AS labels FROM message_labels GROUP BY 1""")
def labels_of(a: Archive) -> DataFrame:
    return listing.labels_of(a, a.messages.select("id")).withColumns(joined("labels"))


@query(""", page AS (SELECT id, subject_norm, row_number() OVER (ORDER BY sent_at DESC NULLS LAST, id) AS position FROM messages),
p AS (SELECT * FROM page WHERE position <= 50)
SELECT id, CAST(position AS INTEGER) AS position, subject_norm AS "group", CAST(min(position) OVER (PARTITION BY subject_norm) AS INTEGER) AS group_position,
count(*) OVER (PARTITION BY subject_norm) AS group_size FROM p""")
def grouped_by_subject(a: Archive) -> DataFrame:
    page = listing.newest(a.messages.select("id", "sent_at", "subject_norm"), 50)
    from pyspark.sql import Window as W

    numbered = page.withColumn("position", F.row_number().over(W.orderBy(F.desc_nulls_last("sent_at"), "id")))  # a page
    return listing.grouped(numbered, F.col("subject_norm")).select("id", "position", "group", "group_position", "group_size")


# --- explorer ------------------------------------------------------------------------------


@query("""SELECT DISTINCT address_id, CASE role WHEN 'FROM' THEN 'SENT_FROM' WHEN 'TO' THEN 'SENT_TO' ELSE 'COPIED_TO' END AS edge
FROM recipients WHERE message_id = 100 AND role <> 'BCC'""")
def message_addresses(a: Archive) -> DataFrame:
    return explorer.message_addresses(a, 100)


@query("SELECT thread_id, message_id FROM message_threads WHERE thread_id IN (SELECT thread_id FROM message_threads WHERE message_id = 100)")
def thread_siblings(a: Archive) -> DataFrame:
    return explorer.thread_siblings(a, 100)


@query(""", e AS (SELECT child AS s, parent AS t, child || '-' || parent AS k FROM replies UNION ALL SELECT parent, child, child || '-' || parent FROM replies),
r1 AS (SELECT [s, t] AS n, [k] AS u FROM e WHERE s = 100),
r2 AS (SELECT list_append(n, t) AS n, list_append(u, k) AS u FROM r1 JOIN e ON n[-1] = s WHERE NOT list_contains(u, k)),
r3 AS (SELECT list_append(n, t) AS n, list_append(u, k) AS u FROM r2 JOIN e ON n[-1] = s WHERE NOT list_contains(u, k))
SELECT array_to_string(n, ',') AS nodes, CAST(len(n) - 1 AS INTEGER) AS length FROM (SELECT n FROM r1 UNION ALL SELECT n FROM r2 UNION ALL SELECT n FROM r3)""")
def reply_chain(a: Archive) -> DataFrame:
    return explorer.reply_chain(a, 100).withColumns(joined("nodes"))


@query("""SELECT CASE WHEN "left" = 's1' THEN "right" ELSE "left" END AS neighbour, CAST(n AS BIGINT) AS count FROM pairs WHERE 's1' IN ("left", "right")
ORDER BY n DESC, 1 LIMIT 20""")
def address_neighbours(a: Archive) -> DataFrame:
    return explorer.address_neighbours(reports.addressed_pairs(a), "s1", 20)


@query("""SELECT id, sent_at, CASE role WHEN 'FROM' THEN 'SENT_FROM' WHEN 'TO' THEN 'SENT_TO' ELSE 'COPIED_TO' END AS edge
FROM recipients JOIN messages ON id = message_id WHERE address_id = 's1' AND role <> 'BCC' ORDER BY sent_at DESC, id, edge LIMIT 50""")
def address_messages(a: Archive) -> DataFrame:
    return explorer.address_messages(a, "s1", 50)


@query("""SELECT id, sent_at, 'manual' AS source FROM message_tags JOIN messages ON id = message_id WHERE tag_id = 'tag:good' ORDER BY sent_at DESC NULLS LAST, id LIMIT 50""")
def tag_members(a: Archive) -> DataFrame:
    return explorer.tag_members(a, "tag:good")


@query("""SELECT tag_id AS "left", thread_id AS "right", count(DISTINCT message_id) AS messages FROM message_tags JOIN message_threads USING (message_id)
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50""")
def overlap_tags_threads(a: Archive) -> DataFrame:
    left = a.message_tags.select(F.col("tag_id").alias("collection"), F.col("message_id").alias("id"))
    return explorer.overlap(left, a.message_threads.select(F.col("thread_id").alias("collection"), F.col("message_id").alias("id")))


@query()
def message_subgraph(a: Archive) -> DataFrame:
    sub = explorer.message_subgraph(a, 100)
    return sub.degrees().select("id", "kind", F.coalesce("label", F.lit("")).alias("label"), "degree")


# --- graph algorithms ----------------------------------------------------------------------


def _edges(a: Archive) -> DataFrame:
    """All addressed pairs as weighted edges."""
    return reports.addressed_pairs(a).select(F.col("left").alias("src"), F.col("right").alias("dst"), F.col("count").alias("weight"))


def _pagerank_sql(passes: int) -> str:
    steps = ""
    for k in range(1, passes + 1):
        steps += f""", r{k} AS MATERIALIZED (SELECT e.d AS id, any_value(n) * 0 + 0.15 / any_value(n) + 0.85 * sum(r.r * e.w / o.w) AS r
FROM e JOIN r{k - 1} r ON r.id = e.s JOIN o ON o.s = e.s, c GROUP BY e.d)"""
    return f""", thin AS (SELECT "left" AS a, "right" AS b, greatest(n, 1) AS w FROM pairs),
e AS MATERIALIZED (SELECT a AS s, b AS d, w FROM thin UNION ALL SELECT b, a, w FROM thin), o AS MATERIALIZED (SELECT s, sum(w) AS w FROM e GROUP BY s),
c AS (SELECT count(*) AS n FROM o), r0 AS (SELECT s AS id, 1.0 / n AS r FROM o, c){steps}
SELECT id, round(r, 8) AS rank FROM r{passes}"""


@query(_pagerank_sql(20))
def weighted_pagerank(a: Archive) -> DataFrame:
    return graph.weighted_pagerank(_edges(a)).select("id", F.round("rank", 8).alias("rank"))


def _reply_rank_sql(passes: int) -> str:
    steps = ""
    for k in range(1, passes + 1):
        steps += f""", r{k} AS MATERIALIZED (SELECT v.id, 0.15 / c.n + 0.85 * (coalesce(g.r, 0) + l.lost / c.n) AS r FROM v LEFT JOIN
(SELECT e.t AS id, sum(p.r / o.k) AS r FROM e JOIN r{k - 1} p ON p.id = e.s JOIN o ON o.s = e.s GROUP BY 1) g ON g.id = v.id, c,
(SELECT coalesce(sum(r), 0) AS lost FROM r{k - 1} WHERE id NOT IN (SELECT s FROM o)) l)"""
    return f""", e AS MATERIALIZED (SELECT child AS s, min(parent) AS t FROM replies GROUP BY 1), v AS MATERIALIZED (SELECT s AS id FROM e UNION SELECT t FROM e),
o AS (SELECT s, count(*) AS k FROM e GROUP BY 1), c AS (SELECT count(*) AS n FROM v), r0 AS (SELECT id, 1.0 / n AS r FROM v, c){steps} SELECT id, round(r, 9) AS rank FROM r{passes}"""


@query(_reply_rank_sql(20))
def reply_pagerank(a: Archive) -> DataFrame:
    found = graph.directed_pagerank(reports.parents(a).select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    return found.select("id", F.round("rank", 9).alias("rank"))


@query("""SELECT message_id AS id, min(message_id) OVER (PARTITION BY thread_id) AS component FROM message_threads
QUALIFY count(*) OVER (PARTITION BY thread_id) > 1""")
def connected_components(a: Archive) -> DataFrame:
    """Each message tied to the next of its thread: components are threads."""
    from pyspark.sql import Window as W

    after = F.lead("message_id").over(W.partitionBy("thread_id").orderBy("message_id"))
    edges = a.message_threads.select(F.col("message_id").alias("src"), after.alias("dst")).filter("dst is not null")
    return graph.connected_components(edges)


def _label_sql(rounds: int) -> str:
    steps = ""
    for k in range(1, 2 * rounds + 1):
        half = "<" if k % 2 else ">="
        steps += f""", l{k} AS MATERIALIZED (SELECT l.id, CASE WHEN left(md5(l.id), 1) {half} '8' THEN b.label ELSE l.label END AS label FROM l{k - 1} l JOIN (
SELECT s, label FROM (SELECT e.s, l.label, count(*) AS n FROM e JOIN l{k - 1} l ON l.id = e.t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, label) = 1) b ON b.s = l.id)"""
    return f""", e AS MATERIALIZED (SELECT "left" AS s, "right" AS t FROM pairs UNION ALL SELECT "right", "left" FROM pairs),
l0 AS (SELECT DISTINCT s AS id, s AS label FROM e){steps} SELECT id, label FROM l{2 * rounds}"""


@query(_label_sql(20))
def label_propagation(a: Archive) -> DataFrame:
    return graph.label_propagation(_edges(a))


@query(""", e AS (SELECT child AS s, parent AS t FROM replies), h1 AS (SELECT DISTINCT t AS id, 1 AS hop FROM e WHERE s = (SELECT max(child) FROM replies)),
h2 AS (SELECT DISTINCT t AS id, 2 AS hop FROM e JOIN h1 ON s = id), h3 AS (SELECT DISTINCT t AS id, 3 AS hop FROM e JOIN h2 ON s = id)
SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT max(child) AS id, 0 AS hop FROM replies UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY id""")
def neighbourhood(a: Archive) -> DataFrame:
    start = a.replies.agg(F.max("child")).first()[0]
    return graph.breadth_first(a.replies.select(F.col("child").alias("src"), F.col("parent").alias("dst")), start, 3)


@query(""", e AS (SELECT "left" AS s, "right" AS t FROM pairs UNION ALL SELECT "right", "left" FROM pairs), p1 AS (SELECT ['s1', t] AS n FROM e WHERE s = 's1'),
p2 AS (SELECT list_append(n, t) AS n FROM p1 JOIN e ON s = n[-1] WHERE n[-1] <> 's10' AND NOT list_contains(n, t)),
p3 AS (SELECT list_append(n, t) AS n FROM p2 JOIN e ON s = n[-1] WHERE n[-1] <> 's10' AND NOT list_contains(n, t) AND t = 's10')
SELECT array_to_string(n, ',') AS nodes, CAST(len(n) - 1 AS INTEGER) AS length FROM (SELECT n FROM p1 UNION ALL SELECT n FROM p2 UNION ALL SELECT n FROM p3) WHERE n[-1] = 's10' ORDER BY len(n), n LIMIT 3""")
def shortest_paths(a: Archive) -> DataFrame:
    return graph.shortest_paths(_edges(a), "s1", "s10", 8, 3).withColumns(joined("nodes"))


def _between_sql(levels: int) -> str:
    """Distances and path counts of all ordered pairs, level by level; a node between a pair gets its share."""
    steps, seen = "", "SELECT s, t, d, k FROM d0"
    for k in range(1, levels + 1):
        steps += f""", d{k} AS MATERIALIZED (SELECT x.s, e.t, {k} AS d, sum(x.k) AS k FROM d{k - 1} x JOIN e ON e.s = x.t
WHERE NOT EXISTS (SELECT 1 FROM ({seen}) y WHERE y.s = x.s AND y.t = e.t) GROUP BY 1, 2)"""
        seen += f" UNION ALL SELECT s, t, d, k FROM d{k}"
    return f""", e AS MATERIALIZED (SELECT "left" AS s, "right" AS t FROM pairs UNION ALL SELECT "right", "left" FROM pairs), v AS (SELECT DISTINCT s AS id FROM e),
d0 AS (SELECT id AS s, id AS t, 0 AS d, 1 AS k FROM v){steps}, d AS MATERIALIZED ({seen})
SELECT id, round(coalesce(b, 0), 6) AS betweenness FROM v LEFT JOIN (SELECT a.t AS id, sum(a.k * b.k * 1.0 / c.k) AS b FROM d a JOIN d b ON a.t = b.s JOIN d c ON c.s = a.s AND c.t = b.t
WHERE a.d > 0 AND b.d > 0 AND c.d = a.d + b.d GROUP BY 1) USING (id)"""


@query(_between_sql(6))
def betweenness(a: Archive) -> DataFrame:
    edges = cut(_edges(a))
    return graph.betweenness(edges, edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()).select("id", F.round("betweenness", 6).alias("betweenness"))


# --- derived layer -------------------------------------------------------------------------


def _similar(a: Archive) -> DataFrame:
    """Pairs of messages with similar vectors."""
    known = lambda c: a.messages.select(F.col("id").alias(c))
    return neighbours.topic_pairs(a.vectors).join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi")


def _topics(a: Archive) -> tuple[DataFrame, DataFrame]:
    """Topics with the links of conversations and of similar messages."""
    facts = reports.facts(a)
    return derived.topics(facts, derived.conversation_edges(facts, a.replies).unionByName(_similar(a)))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as bodies of the messages with the same id."""
    return _body_facts(spark, sf_dir).select("id", F.col("body_clean").alias("text"), "body_clean", "simhash")


@query()
def topics(a: Archive) -> DataFrame:
    return _topics(a)[0]


@query()
def topic_members(a: Archive) -> DataFrame:
    return _topics(a)[1]


@query("""SELECT signal, key, id FROM (
  SELECT signal, key, id, count(*) OVER (PARTITION BY signal, key) AS size FROM (
    SELECT 'thread' AS signal, thread_id AS key, message_id AS id FROM message_threads
    UNION ALL SELECT 'subject', subject_norm, id FROM messages
    UNION ALL SELECT 'attachment', CAST(sha AS VARCHAR), message_id FROM message_attachments
    UNION ALL SELECT 'participants', participant_key, message_id FROM keyed)) WHERE size BETWEEN 2 AND 200""")
def topic_buckets(a: Archive) -> DataFrame:
    return derived.signal_buckets(reports.facts(a)).select("signal", "key", "id")


@query(archive=False)
def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = driver_archive(spark, sf_dir)
    members = a.message_tags.select(F.col("tag_id").alias("topic_id"), F.col("message_id").alias("id"))
    return derived.keywords(members, _texts(spark, sf_dir))


def _body_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    day = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 86_400)
    body = F.coalesce("text", F.lit(""))
    docs = spread(docs.select("doc_id", "text", "lang"))
    return docs.select(F.col("doc_id").alias("id"), day.alias("sent_at"), text.simhash(body).alias("simhash"), body.alias("body_clean"), (F.col("lang") == "en").alias("outbound"))


@query(archive=False)
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.templates(_body_facts(spark, sf_dir))[0]


@query(archive=False)
def template_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.templates(_body_facts(spark, sf_dir))[1]


@query()
def communities(a: Archive) -> DataFrame:
    edges = cut(_edges(a))
    return derived.communities(graph.label_propagation(edges), graph.weighted_pagerank(edges), a.addresses)[0]


@query("""SELECT message_id AS id, 'community:' || any_value(domain) AS community_id, round(max(k * 1.0 / size), 6) AS score FROM (
  SELECT p.message_id, domain, count(*) AS k, any_value(size) AS size FROM people p JOIN keyed USING (message_id) JOIN addresses a ON a.id = p.address_id GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY p.message_id ORDER BY count(*) * 1.0 / any_value(size) DESC, 'community:' || domain) = 1) WHERE k * 1.0 / size >= 0.5 GROUP BY 1""")
def circles(a: Archive) -> DataFrame:
    """Each nation as a community."""
    members = a.addresses.select(F.concat(F.lit("community:"), "domain").alias("community_id"), "id")
    return derived.circles(reports.facts(a), members)


@query("""SELECT id, round(greatest(0, least(1, 0.0 + 0.3 * by_you + 0.2 * CASE WHEN n > 0 THEN least(1.0, n / 3.0) ELSE 0 END + 0.15 * 0 + 0.1 * few + 0.1 * files)), 6) AS importance,
concat_ws(',', CASE WHEN n = 1 THEN '1 reply' WHEN n > 1 THEN n || ' replies' END, CASE WHEN few = 1 THEN 'few recipients' END, CASE WHEN files = 1 THEN 'has attachments' END, CASE WHEN by_you = 1 THEN 'replied by you' END) AS reasons
FROM (SELECT m.id, (SELECT count(DISTINCT child) FROM replies p WHERE p.parent = m.id) AS n,
  CASE WHEN (SELECT count(DISTINCT address_id) FROM recipients r WHERE r.message_id = m.id AND role = 'TO') BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS few,
  CASE WHEN EXISTS (SELECT 1 FROM message_attachments f WHERE f.message_id = m.id) THEN 1 ELSE 0 END AS files,
  CASE WHEN EXISTS (SELECT 1 FROM replies p JOIN recipients r ON r.message_id = p.child AND role = 'FROM' WHERE p.parent = m.id AND r.address_id IN (SELECT address FROM accounts)) THEN 1 ELSE 0 END AS by_you FROM messages m)""")
def importance(a: Archive) -> DataFrame:
    """Without ranks and templates."""
    none = a.messages.select("id", F.lit(0.0).alias("rank")).limit(0)
    auto = a.messages.select("id", F.lit(0.0).alias("score")).limit(0)
    sender = a.addresses.select("id", F.lit(0.0).alias("rank")).limit(0)
    return derived.importance(reports.facts(a), reports.message_signals(a), a.accounts, sender, none, auto).withColumns(joined("reasons"))


@query(archive=False)
def importance_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ranks of senders and replies, and templates."""
    a = driver_archive(spark, sf_dir)
    facts = reports.facts(a)
    lines = facts.select("id", "sent_at", "outbound").join(_bodies(spark, sf_dir).drop("text"), "id")
    replies = reports.parents(a).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    found = derived.importance(
        facts, reports.message_signals(a), a.accounts, graph.weighted_pagerank(_edges(a)), graph.directed_pagerank(replies),
        derived.automation(*derived.templates(lines)),
    )
    return found.withColumns(joined("reasons"))


@query(""", g AS (SELECT thread_id AS g, message_id AS id, count(*) OVER (PARTITION BY thread_id) AS size FROM message_threads),
o AS (SELECT g, tag_id, any_value(size) AS size, count(*) AS n FROM g JOIN message_tags t ON t.message_id = g.id WHERE size > 1 GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) * 1.0 / any_value(size) >= 0.3)
SELECT tag_id, id, round(max(0.9 * n / o.size), 6) AS score, 'thread' AS method FROM o JOIN g USING (g)
WHERE NOT EXISTS (SELECT 1 FROM message_tags t WHERE t.tag_id = o.tag_id AND t.message_id = id) GROUP BY 1, 2""")
def tag_suggestions(a: Archive) -> DataFrame:
    groups = a.message_threads.select(F.lit("thread").alias("kind"), F.col("thread_id").alias("group_id"), F.col("message_id").alias("id"))
    return derived.suggestions(groups, a.message_tags)


@query(archive=False)
def rebuild_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailweave.plans.rebuild import rebuild

    a = driver_archive(spark, sf_dir)
    done = rebuild(a, _bodies(spark, sf_dir), lambda: _similar(a))
    return spark.createDataFrame(sorted(done.counts.items()), "name string, n long")


# --- tags ----------------------------------------------------------------------------------


@query("SELECT tag_id, count(DISTINCT message_id) AS messages FROM message_tags GROUP BY 1 UNION ALL SELECT 'tag:unused', 0")
def list_tags(a: Archive) -> DataFrame:
    known = a.message_tags.select("tag_id").distinct().unionByName(a.message_tags.sparkSession.createDataFrame([("tag:unused",)], "tag_id string"))
    return tags.list_tags(known, a.message_tags)


@query("""SELECT tag_id, source, count(*) AS members FROM (SELECT message_id, tag_id, 'manual' AS source FROM message_tags
UNION ALL SELECT id, 'tag:good', 'accepted' FROM messages WHERE id < 300 AND id NOT IN (SELECT message_id FROM message_tags WHERE tag_id = 'tag:good')) GROUP BY 1, 2""")
def tag_messages(a: Archive) -> DataFrame:
    new = tags.tag_messages(a.message_tags, "tag:good", a.messages.filter("id < 300").select("id"), "accepted")
    return new.groupBy("tag_id", "source").agg(F.count("*").alias("members"))


@query("SELECT tag_id, message_id FROM message_tags WHERE NOT (tag_id = 'tag:good' AND message_id < 300)")
def untag(a: Archive) -> DataFrame:
    return tags.untag(a.message_tags, "tag:good", a.messages.filter("id < 300").select("id")).select("tag_id", "message_id")


@query("""SELECT message_id AS id FROM copies GROUP BY 1 HAVING count(*) FILTER (account = 7) > 0 AND count(*) FILTER (account <> 7) = 0""")
def purge_account(a: Archive) -> DataFrame:
    return tags.purge_account(a, 7)[0]


# --- vectors -------------------------------------------------------------------------------

@query("""SELECT l.vec_id AS query, r.vec_id AS id, round(1 - list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 4) AS distance
FROM embeddings l JOIN embeddings r ON l.label = r.label WHERE l.vec_id % 100 = 0
QUALIFY row_number() OVER (PARTITION BY l.vec_id ORDER BY round(1 - list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9), r.vec_id) <= 10""", archive=False)
def semantic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search from every id divisible by 100."""
    vectors = driver_archive(spark, sf_dir).vectors
    found = semantic.nearest_of_all(vectors, 10, queries=vectors.filter("id % 100 = 0"), own=True)
    return found.select(F.col("left").alias("query"), F.col("right").alias("id"), F.round("distance", 4).alias("distance"))


@query("""SELECT l.vec_id AS "left", r.vec_id AS "right", round(1 - list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 4) AS distance
FROM embeddings l JOIN embeddings r ON l.label = r.label AND l.vec_id <> r.vec_id
QUALIFY row_number() OVER (PARTITION BY l.vec_id ORDER BY round(1 - list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9), r.vec_id) <= 5""", archive=False)
def nearest_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.nearest_of_all(driver_archive(spark, sf_dir).vectors, 5).withColumn("distance", F.round("distance", 4))


@query("""SELECT count(*) AS total, count(*) FILTER (label = 1) AS embedded, count(*) FILTER (label IS NOT NULL AND label <> 1) AS other_model,
count(*) FILTER (label IS NULL AND coalesce(trim(text), '') = '') AS unembeddable FROM documents LEFT JOIN embeddings ON vec_id = doc_id""", archive=False)
def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.coverage(_texts(spark, sf_dir), driver_archive(spark, sf_dir).vectors, "m1")


@query("""SELECT doc_id AS id, sha256(lang || chr(10) || chr(10) || text) AS digest FROM documents
WHERE trim(text) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)""", archive=False)
def needing_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), "text")
    return semantic.needing(rows, driver_archive(spark, sf_dir).vectors, "m1").select("id", F.sha2("text", 256).alias("digest"))


# --- ingest and scalar functions -----------------------------------------------------------


def _raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as RFC 5322 bytes."""
    t = load(spark, sf_dir, "conversations")
    mid = lambda turn: F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("."), turn.cast("string"), F.lit("@Talk.Example>"))
    lines = F.concat_ws(
        "\r\n",
        F.concat(F.lit("From: "), F.col("role"), F.lit(" <"), F.col("role"), F.lit("@Talk.example>")),
        F.concat(F.lit("To: All <all@talk.example>, <"), F.col("role"), F.lit("@talk.example>")),
        F.concat(F.lit("Subject: Re: AW: Talk "), F.col("conv_id").cast("string")),
        F.concat(F.lit("Message-ID: "), mid(F.col("turn"))),
        F.when(F.col("turn") > 0, F.concat(F.lit("In-Reply-To: "), mid(F.col("turn") - 1))),
        F.lit("Date: Mon, 01 Jan 2024 10:00:00 +0200"),
        F.lit("MIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n"),
        F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n", "\r\n"),
    )
    return t.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.encode(lines, "UTF-8").alias("content"))


@query(r"""SELECT conv_id || '.' || turn || '@talk.example' AS id, conv_id || '/' || turn AS path, 'Re: AW: Talk ' || conv_id AS subject,
role || '@talk.example' AS sender, CASE WHEN turn > 0 THEN '<' || conv_id || '.' || (turn - 1) || '@Talk.Example>' END AS in_reply_to,
sha256(rtrim(regexp_replace(coalesce(text, ''), '\r\n', chr(10), 'g'), chr(10))) AS body, TIMESTAMP '2024-01-01 08:00:00' AS sent_at FROM conversations""", archive=False)
def ingest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = mail.parsed_messages(_raw_mail(spark, sf_dir))
    body = F.sha2(F.regexp_replace("body_text", "\n+$", ""), 256)
    return parsed.select("id", "path", "subject", "sender", "in_reply_to", body.alias("body"), "sent_at")


@query("""SELECT conv_id || '.' || turn || '@talk.example' AS child, conv_id || '.' || (turn - 1) || '@talk.example' AS parent FROM conversations c
WHERE turn > 0 AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)""", archive=False)
def ingest_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = mail.parsed_messages(_raw_mail(spark, sf_dir)).filter("error is null")
    # both ends of a link are read from what one parse left
    return mail.replies(cut(parsed.select("id", "in_reply_to", "references").dropDuplicates(["id"]))).select("child", "parent")


@query("""SELECT o_orderkey AS id, lower(o_orderpriority) AS subject_norm, CASE WHEN o_orderkey >= 10 THEN '#' || o_orderkey || ',' ELSE '' END || 'PRJ-' || o_orderkey AS refs FROM orders""", archive=False)
def normalised_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    subject = F.concat(F.lit("Re: AW: Fwd[2]: [PRJ-"), key, F.lit("]  "), F.col("o_orderpriority"))
    tail = F.when(F.length(key) >= 2, F.concat(F.lit(" (#"), key, F.lit(")"))).otherwise("")
    subject = F.concat(subject, tail)
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), text.normalise_subject(subject).alias("subject_norm"),
        F.array_join(text.extract_refs(subject, F.lit("see RFC-5322 and UTF-8")), ",").alias("refs"),
    )


@query(r"""SELECT doc_id AS id, CASE WHEN length(t) > 160 THEN rtrim(left(t, 160)) || '…' ELSE t END AS preview FROM
(SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)""", archive=False)
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", text.preview(F.col("text")).alias("preview"))


@query(archive=False)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.html_to_text("html").alias("text"), text.remote_references(F.col("html")).alias("remote"))


@query(r"""SELECT sha256(html) AS sha256, left(sha256(html), 2) AS prefix, octet_length(encode(html)) AS size FROM pages GROUP BY html""", archive=False)
def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "pages").select(F.encode("html", "UTF-8").alias("content"))
    return mail.blobs(raw).select("sha256", "prefix", F.length("content").cast("long").alias("size"))


@query("""SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)""", archive=False)
def new_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = load(spark, sf_dir, "events").select("event_id")
    return mail.new_messages(refs, load(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id")), ["event_id"])


@query("SELECT id, subject_norm FROM messages WHERE id > 1000 ORDER BY id LIMIT 100")
def keyset_page(a: Archive) -> DataFrame:
    return algebra.keyset_page(a.messages.select("id", "subject_norm"), "id", 1000, 100)


@query("""SELECT id, subject_norm, CAST(position AS INTEGER) AS position FROM (VALUES (300, 0), (5, 1), (77, 2)) v(k, position) JOIN messages ON id = k""")
def find_by_ids(a: Archive) -> DataFrame:
    return algebra.pick(a.messages.select("id", "subject_norm"), "id", [300, 5, 77])


@query("""SELECT o_orderkey AS id, coalesce(new, o_orderpriority) AS subject_norm FROM orders LEFT JOIN (SELECT doc_id, 'tagged' AS new FROM labels GROUP BY 1) ON doc_id = o_orderkey""", archive=False)
def set_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = driver_archive(spark, sf_dir)
    values = a.message_tags.select(F.col("message_id").alias("id")).distinct().withColumn("subject_norm", F.lit("tagged"))
    extra = spark.createDataFrame([(-1, "nobody")], "id long, subject_norm string")
    labelled = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("tagged").alias("subject_norm"))
    return algebra.set_existing(a.messages.select("id", "subject_norm"), labelled.unionByName(values).unionByName(extra), "id")


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS copies, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1""", archive=False)
def copies_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mailweave.streaming.ingest import copies_per_window as windows

    return windows(driver_archive(spark, sf_dir).copies)


# More queries register themselves; they import this module's ``query``.
from mailweave.plans import archive_queries, findings_queries, layer_queries  # noqa: E402, F401
