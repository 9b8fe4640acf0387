"""Registered queries of groupings, file families, tags, embeddings and the graph algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions import text
from mailweave.operators import algebra, graph
from mailweave.plans import derived, listing, neighbours, reports, semantic, tags
from mailweave.plans.listing import Filters
from mailweave.plans.registry import _POSTINGS, query
from mailweave.session import cut
from mailweave.tables import Archive, driver_archive, load

# --- algebra -------------------------------------------------------------------------------


@query("SELECT a.id, domain, message_id FROM addresses a LEFT JOIN recipients r ON address_id = a.id AND role = 'FROM'")
def traverse_optional(a: Archive) -> DataFrame:
    sent = a.recipients.filter("role = 'FROM'").select("address_id", "message_id")
    return algebra.traverse(a.addresses.select("id", "domain"), "id", sent, "address_id", optional=True).drop("address_id")


@query("""SELECT id, coalesce(l.n, 0) AS labels, coalesce(f.n, 0) AS files FROM messages LEFT JOIN (SELECT message_id, count(*) AS n FROM message_labels GROUP BY 1) l ON l.message_id = id
LEFT JOIN (SELECT message_id, count(*) AS n FROM message_attachments GROUP BY 1) f ON f.message_id = id""")
def star_expand(a: Archive) -> DataFrame:
    n = lambda df, name: df.groupBy(F.col("message_id").alias("id")).agg(F.count("*").alias(name))
    rows = algebra.branch(a.messages.select("id"), "id", n(a.message_labels, "labels"), n(a.message_attachments, "files"))
    return rows.na.fill(0, ["labels", "files"])


@query("""SELECT message_id, tag_id, 'merged' AS source FROM message_tags WHERE message_id % 2 = 0 GROUP BY ALL UNION ALL SELECT message_id, tag_id, 'manual' FROM message_tags WHERE message_id % 2 = 1
UNION ALL SELECT -1, 'tag:new', 'merged'""")
def merge_edges(a: Archive) -> DataFrame:
    """Upsert: even memberships and a new one replace what is there."""
    rows = a.message_tags.filter("message_id % 2 = 0").unionByName(a.message_tags.sparkSession.range(1).select(F.lit(-1).cast("long").alias("message_id"), F.lit("tag:new").alias("tag_id"), F.lit("x").alias("source")))
    return algebra.merge(a.message_tags, rows.withColumn("source", F.lit("merged")), ["message_id", "tag_id"])


@query("SELECT id, subject_norm FROM messages WHERE id NOT IN (SELECT message_id FROM message_tags)")
def delete_nodes(a: Archive) -> DataFrame:
    return algebra.delete(a.messages.select("id", "subject_norm"), a.message_tags.select(F.col("message_id").alias("id")), "id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey = 3 THEN NULL ELSE c_mktsegment END AS color FROM customer", archive=False)
def set_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setting a property to nothing clears it."""
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tag_id"), F.col("c_mktsegment").alias("color"))
    return tags.recolor_tag(rows, 3, None).withColumnRenamed("tag_id", "id")


# --- bodies and texts ----------------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject_norm"), F.col("text").alias("body_clean"))


@query("SELECT doc_id AS id, sha256(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)", archive=False)
def message_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return reports.message_bodies(_written(spark, sf_dir), ids).select("id", F.sha2("body_clean", 256).alias("digest"))


@query("SELECT doc_id AS id, sha256(lang || chr(10) || chr(10) || text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)", archive=False)
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return reports.message_texts(_written(spark, sf_dir), ids).select("id", F.sha2("text", 256).alias("digest"))


_STOP = ["the", "and", "for", "with", "der", "die", "und", "les", "des", "que"]


@query(r"""WITH m AS (SELECT 'tag:good' AS topic_id, doc_id FROM labels WHERE quality = 1 UNION SELECT 'tag:toxic', doc_id FROM labels WHERE toxic = 1),
t AS (SELECT topic_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[a-z][a-z0-9]{1,9}-\d{1,8}|#\d{2,8}', ' ', 'g'), '\p{L}{3,}')) AS term FROM m JOIN documents USING (doc_id)),
f AS (SELECT topic_id, term, count(*) AS tf FROM t WHERE term NOT IN (""" + ", ".join(f"'{w}'" for w in _STOP) + r""") GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT topic_id, term, tf, round(tf * greatest(0, ln((SELECT count(DISTINCT topic_id) FROM f) * 1.0 / (1 + df))), 6) AS score FROM f JOIN d USING (term))
SELECT topic_id, term, tf, score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, tf DESC, term) AS INTEGER) AS place FROM s
QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, tf DESC, term) <= 8""", archive=False)
def keywords_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with a stop list of one's own."""
    a = driver_archive(spark, sf_dir)
    members = a.message_tags.select(F.col("tag_id").alias("topic_id"), F.col("message_id").alias("id"))
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return derived.keywords(members, texts, _STOP)


# --- listing -------------------------------------------------------------------------------


@query("SELECT DISTINCT message_id AS id, address_id FROM recipients WHERE role = 'TO'")
def recipients_of(a: Archive) -> DataFrame:
    return listing.recipients_of(a, a.messages)


def _typed(a: Archive) -> DataFrame:
    """Attachments with types and names that mail has, from the parts' types and keys."""
    kind = F.when(F.col("content_type").startswith("STANDARD"), "application/pdf").when(F.col("content_type").startswith("SMALL"), "image/png")
    kind = kind.when(F.col("content_type").startswith("MEDIUM"), "text/csv; charset=utf-8").when(F.col("content_type").startswith("LARGE"), "application/vnd.ms-excel")
    kind = kind.when(F.col("content_type").startswith("ECONOMY"), "").otherwise("application/octet-stream")
    name = F.when(F.col("sha") % 3 == 0, "a.DOCX").when(F.col("sha") % 3 == 1, "b.zip").otherwise("none")
    return a.message_attachments.withColumns({"content_type": kind, "filename": name})


_FAMILIES = """SELECT DISTINCT l_orderkey AS message_id, p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'pdf' WHEN p_type LIKE 'SMALL%' THEN 'image' WHEN p_type LIKE 'MEDIUM%' THEN 'table'
WHEN p_type LIKE 'LARGE%' THEN 'spreadsheet' ELSE CASE p_partkey % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'archive' ELSE 'other' END END AS family FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query(f"SELECT family, count(DISTINCT message_id) AS messages FROM ({_FAMILIES}) GROUP BY 1")
def facet_families(a: Archive) -> DataFrame:
    from dataclasses import replace

    return listing.facet_families(replace(a, message_attachments=_typed(a)))


@query(f"SELECT count(DISTINCT message_id) AS total FROM ({_FAMILIES}) WHERE family IN ('pdf', 'archive')")
def family_filter(a: Archive) -> DataFrame:
    from dataclasses import replace

    return listing.count_filtered(replace(a, message_attachments=_typed(a)), Filters(families=["pdf", "archive"]))


@query("SELECT count(*) AS total FROM messages WHERE id NOT IN (SELECT message_id FROM message_attachments)")
def without_attachments(a: Archive) -> DataFrame:
    return listing.count_filtered(a, Filters(has_attachments=False))


_PAGE = "page AS (SELECT *, row_number() OVER (ORDER BY sent_at DESC NULLS LAST, id) AS position FROM messages QUALIFY position <= 50)"
_MODES = {
    "conversation": "SELECT message_id AS id, thread_id AS g FROM message_threads",
    "topic": "SELECT message_id AS id, thread_id AS g FROM message_threads WHERE message_id % 2 = 0",
    "tag": "SELECT message_id AS id, tag_id AS g FROM message_tags",
    "recurring": "SELECT message_id AS id, participant_key AS g FROM keyed",
    "subject": "SELECT id, subject_norm AS g FROM messages",
    "sender": "SELECT message_id AS id, address_id AS g FROM recipients WHERE role = 'FROM'",
    "receiver": "SELECT message_id AS id, address_id AS g FROM recipients WHERE role = 'TO'",
    "none": "SELECT id, CAST(id AS VARCHAR) AS g FROM messages",
}


@query(f", {_PAGE}, f AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, id, min(g) AS g FROM ({sql}) GROUP BY id" for m, sql in _MODES.items()) + """),
r AS (SELECT m.mode, page.id, position, coalesce(f.g, '') AS g FROM page CROSS JOIN (SELECT DISTINCT mode FROM f) m LEFT JOIN f ON f.mode = m.mode AND f.id = page.id)
SELECT mode, id, CAST(position AS INTEGER) AS position, g AS "group", CAST(min(position) OVER (PARTITION BY mode, g) AS INTEGER) AS group_position, count(*) OVER (PARTITION BY mode, g) AS group_size FROM r""")
def grouped_pages(a: Archive) -> DataFrame:
    """The newest page under each of the eight groupings."""
    from pyspark.sql import Window as W

    page = listing.newest(a.messages.select("id", "sent_at", "subject_norm"), 50)
    page = page.withColumn("position", F.row_number().over(W.orderBy(F.desc_nulls_last("sent_at"), "id")))  # a page
    found = {
        "topic_members": a.message_threads.filter("message_id % 2 = 0").select(F.col("thread_id").alias("topic_id"), F.col("message_id").alias("id")),
        "group_members": reports.participants(a).select("participant_key", F.col("message_id").alias("id")),
    }
    out = None
    for mode in _MODES:
        one = listing.grouped_page(a, page, mode, **found).select(F.lit(mode).alias("mode"), "id", "position", "group", "group_position", "group_size")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT id, CAST(place AS INTEGER) AS place, n > 5 AS truncated FROM (SELECT message_id AS id, row_number() OVER (ORDER BY sent_at NULLS LAST, message_id) AS place, count(*) OVER () AS n
FROM message_threads JOIN messages ON id = message_id WHERE thread_id = 't7') WHERE place <= 5""")
def conversation_reading(a: Archive) -> DataFrame:
    return listing.thread_reading(a, "t7", 5).select("id", "place", "truncated")


@query(f"""WITH {_POSTINGS}, kept AS (SELECT id, score FROM score WHERE k = 3 AND id IN (SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey))
SELECT id, score FROM kept ORDER BY score DESC, id LIMIT 50""", archive=False)
def searched_with_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words decide the order, filters what is left of the hits."""
    index = listing.postings(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return listing.search(driver_archive(spark, sf_dir), Filters(text="the for WITH", has_attachments=True), index).select("id", "score")


@query("SELECT id FROM messages ORDER BY sent_at DESC NULLS LAST, id LIMIT 50")
def searched_for_nothing(a: Archive) -> DataFrame:
    """Nothing asked: the newest."""
    return listing.search(a, Filters()).select("id")


@query("""SELECT filename, count(DISTINCT l_orderkey) AS messages FROM (SELECT l_orderkey, CASE p_partkey % 3 WHEN 0 THEN 'a.DOCX' WHEN 1 THEN 'b.zip' ELSE 'none' END AS filename
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type LIKE 'ECONOMY%' OR p_type LIKE 'PROMO%') GROUP BY 1""")
def facet_untyped_names(a: Archive) -> DataFrame:
    from dataclasses import replace

    # an empty type counts as none
    rows = _typed(a).withColumn("content_type", F.when(F.col("content_type") != "", F.col("content_type")))
    return listing.facet_untyped_names(replace(a, message_attachments=rows))


@query("""SELECT round((SELECT count(DISTINCT message_id) FROM message_attachments) * 1.0 / count(*), 6) AS with_files,
round((SELECT count(DISTINCT child) FROM replies) * 1.0 / count(*), 6) AS answers, round((SELECT count(*) FROM messages WHERE id IS NULL) * 1.0 / count(*), 6) AS unidentified FROM messages""")
def dashboard_shares(a: Archive) -> DataFrame:
    n = lambda df, c, name: df.agg(F.count_distinct(c).alias(name))
    rows = a.messages.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("u"))
    rows = rows.join(F.broadcast(n(a.message_attachments, "message_id", "f"))).join(F.broadcast(n(a.replies, "child", "r")))  # one row each
    share = lambda c: F.round(reports.share(F.col(c), F.col("n")), 6)
    return rows.select(share("f").alias("with_files"), share("r").alias("answers"), share("u").alias("unidentified"))


# --- scalar functions ----------------------------------------------------------------------


@query("""SELECT k AS id, CAST(i AS INTEGER) AS band, (h >> (16 * i)) & 65535 AS value FROM (SELECT o_orderkey AS k, o_orderkey * 2654435761 AS h FROM orders), range(4) t(i)""", archive=False)
def fingerprint_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four bands of a fingerprint."""
    prints = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * F.lit(2654435761)).alias("h"))
    return prints.select("id", F.posexplode(text.bands(F.col("h"))).alias("band", "value"))


@query("""SELECT c_custkey AS id, n_name AS domain, replace(lower(c_name), '#', '@x.') AS local FROM customer JOIN nation ON c_nationkey = n_nationkey""", archive=False)
def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain and local part; only what follows the last @ is the domain."""
    people = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    address = F.concat(F.regexp_replace(F.lower("c_name"), "#", "@x."), F.lit("@"), "n_name")
    return people.select(F.col("c_custkey").alias("id"), text.domain_of(address).alias("domain"), text.local_part_of(address).alias("local"))


# --- tags and trust ------------------------------------------------------------------------


@query("""SELECT tag_id, source, count(*) AS members FROM (SELECT message_id, tag_id, 'manual' AS source FROM message_tags
UNION ALL SELECT message_id, 'tag:thread-7', 'accepted' FROM message_threads WHERE thread_id = 't7') GROUP BY 1, 2""")
def promoted(a: Archive) -> DataFrame:
    """A cluster made a tag: its members are accepted ones."""
    spark = a.messages.sparkSession
    known = spark.createDataFrame([("tag:good", "Good", None, "manual")], "tag_id string, name string, color string, origin string")
    members = a.message_threads.filter("thread_id = 't7'").select(F.col("message_id").alias("id"))
    return tags.promote(known, a.message_tags, "Thread 7", members)[1].groupBy("tag_id", "source").agg(F.count("*").alias("members"))


@query("SELECT id, id IN ('s1', 's2') AS remote_trusted FROM addresses")
def remote_trust(a: Archive) -> DataFrame:
    """Two senders are trusted; deciding on an unknown one changes nothing."""
    known = a.addresses.select("id")
    for sender in (" S1 ", "s2", "nobody"):
        known = tags.trust_remote(known, sender)
    return known.select("id", "remote_trusted")


@query("SELECT DISTINCT message_id, tag_id FROM message_tags")
def tags_of(a: Archive) -> DataFrame:
    return tags.tags_of(a.message_tags, a.message_tags.select(F.col("message_id").alias("id")))


_OFFERED = """o AS (SELECT DISTINCT message_id AS id, 'tag:good' AS tag_id, round(message_id % 10 / 10.0, 6) AS score FROM message_threads WHERE message_id NOT IN (SELECT message_id FROM message_tags WHERE tag_id = 'tag:good'))"""


def _offered(a: Archive) -> DataFrame:
    rows = a.message_threads.select(F.col("message_id").alias("id"), F.lit("tag:good").alias("tag_id"), F.round(F.col("message_id") % 10 / 10.0, 6).alias("score"))
    held = a.message_tags.filter("tag_id = 'tag:good'").select(F.col("message_id").alias("id"))
    return rows.join(held, "id", "left_anti")


@query(f", {_OFFERED} SELECT tag_id, count(DISTINCT id) AS suggested FROM o GROUP BY 1 UNION ALL SELECT 'tag:toxic', 0")
def suggestion_counts(a: Archive) -> DataFrame:
    known = a.message_tags.select("tag_id").distinct()
    return tags.suggestion_counts(known, _offered(a))


@query(f", {_OFFERED} SELECT id, tag_id, score FROM o ORDER BY score DESC, id LIMIT 50")
def suggestions_for(a: Archive) -> DataFrame:
    return tags.suggestions_for(_offered(a), "tag:good")


@query(f", {_OFFERED} SELECT tag_id, source, count(*) AS members FROM (SELECT message_id, tag_id, 'manual' AS source FROM message_tags UNION ALL SELECT id, tag_id, 'auto' FROM o WHERE score >= 0.6) GROUP BY 1, 2")
def accepted_suggestions(a: Archive) -> DataFrame:
    return tags.accept_suggestions(a.message_tags, _offered(a)).groupBy("tag_id", "source").agg(F.count("*").alias("members"))


@query("""SELECT 'messages' AS name, count(*) AS n FROM messages WHERE id NOT IN (SELECT message_id FROM copies GROUP BY 1 HAVING bool_and(account = 7))
UNION ALL SELECT 'copies', count(*) FROM copies WHERE account <> 7 UNION ALL SELECT 'ledger', count(*) FROM copies WHERE account <> 7""")
def erased_account(a: Archive) -> DataFrame:
    running = a.copies.select("account", F.lit("done").alias("state"))
    messages, copies, ledger = tags.erase_account(a, 7, a.copies, running)
    return reports.totals(messages=messages, copies=copies, ledger=ledger)


# --- vectors -------------------------------------------------------------------------------


@query("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 AND vec_id IN (SELECT o_orderkey FROM orders) THEN 'new' ELSE 'm' || label END AS model FROM embeddings", archive=False)
def written_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even vectors are written anew; vectors of messages that aren't there are left out."""
    a = driver_archive(spark, sf_dir)
    return semantic.write_embeddings(a.vectors, a.vectors.filter("id % 2 = 0").select("id", "vector"), a.messages, "new").select("id", "model")


@query("SELECT 'm' || label AS model, count(*) AS n FROM embeddings WHERE label <> 1 GROUP BY 1", archive=False)
def cleared_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = semantic.clear_embeddings(driver_archive(spark, sf_dir).vectors, "m1")
    return left.groupBy("model").agg(F.count("*").alias("n"))


@query("""SELECT vec_id AS id, greatest(0, least(1, 1 - round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 4))) AS score
FROM embeddings, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0)
ORDER BY round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 4), 1 LIMIT 10""", archive=False)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request by meaning, dispatched by kind; its vector stands for what an embedder makes of the words."""
    vectors = driver_archive(spark, sf_dir).vectors
    first = vectors.filter("id = 0").first()
    return semantic.search("semantic", "words", vectors, vectors, first["model"], lambda texts: [first["vector"]], 10).withColumn("score", F.round("score", 4))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of each document that SQL can make too: its words by first and last letter and length, in 64 places."""
    words = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    place = F.pmod(F.ascii("w") * 7 + F.ascii(F.right("w", F.lit(1))) * 3 + F.length("w"), F.lit(64))
    held = words.groupBy("id", place.alias("place")).agg(F.count("*").alias("n")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("held"))
    every = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0)).cast("float"))
    return held.select("id", F.lit("letters").alias("model"), every.alias("vector"))


_LETTERS = """w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
c AS (SELECT id, (ascii(w) * 7 + ascii(right(w, 1)) * 3 + length(w)) % 64 AS place, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT id, list_transform(range(64), lambda k: coalesce(map_from_entries(list((place, n)))[k], 0)::DOUBLE) AS v FROM c GROUP BY id)"""


@query(f"""WITH {_LETTERS} SELECT l AS src, r AS dst, round(1 - d, 6) AS weight FROM (
SELECT l.id AS l, r.id AS r, round(1 - list_cosine_similarity(l.v, r.v), 9) AS d FROM v l JOIN v r ON l.id <> r.id
QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY d, r.id) <= 5) WHERE d <= 0.02 AND r > l""", archive=False)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of nearly the same words, each against all others."""
    found = neighbours.topic_pairs(cut(_letters(spark, sf_dir)), 0.98, small=1 << 62)
    return found.select("src", "dst", "weight")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey = 3 THEN 'Renamed' ELSE c_name END AS name FROM customer""", archive=False)
def renamed_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag keeps its id under another name."""
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tag_id"), F.col("c_name").alias("name"))
    return tags.rename_tag(rows, 3, "Renamed").withColumnRenamed("tag_id", "id")


@query("SELECT tag_id, count(*) AS members FROM message_tags WHERE tag_id <> 'tag:toxic' GROUP BY 1")
def deleted_tag(a: Archive) -> DataFrame:
    """A tag goes with all of its memberships."""
    known, left = tags.delete_tag(a.message_tags.select("tag_id").distinct(), a.message_tags, "tag:toxic")
    return known.join(left, "tag_id").groupBy("tag_id").agg(F.count("*").alias("members"))


@query("SELECT true AS within")
def betweenness_sampled(a: Archive) -> DataFrame:
    """Whether betweenness from sampled paths is within its bound of the exact one, for every person."""
    edges = reports.addressed_pairs(a).select(F.col("left").alias("src"), F.col("right").alias("dst"))
    edges = cut(edges)
    exact = graph.betweenness(edges, edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    found, bound = graph.sampled_betweenness(edges, 0.02)
    near = F.abs(F.col("betweenness") - F.coalesce("exact", F.lit(0.0))) <= bound
    return found.join(exact.withColumnRenamed("betweenness", "exact"), "id", "left").agg(F.bool_and(near).alias("within"))


@query("SELECT true AS enough", archive=False)
def neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the neighbour graph of all documents holds 0.95 of the five nearest of every id divisible by 100."""
    vectors = cut(_letters(spark, sf_dir))
    made = neighbours.neighbour_graph(vectors, 5, small=256)
    truth = semantic.nearest_of_all(vectors, 5, queries=vectors.filter("id % 100 = 0"))
    found = made.pairs.select("left", "right", F.lit(1).alias("hit"))
    return truth.join(found, ["left", "right"], "left").agg((F.count("hit") >= F.count("*") * F.lit(0.95)).alias("enough"))


@query("""SELECT id, score FROM (SELECT doc_id AS id, 1 AS score FROM documents) WHERE id < 0""", archive=False)
def searched_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that no text holds together find nothing."""
    index = listing.postings(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return semantic.search("fulltext", "zzzzqq the", index, index).select("id", F.col("score").cast("int").alias("score"))


@query("SELECT true AS enough", archive=False)
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether searches by cells from every id divisible by 100 find nine tenths of what brute force finds."""
    vectors = driver_archive(spark, sf_dir).vectors
    asked = vectors.filter("id % 100 = 0")
    index = semantic.cell_index(vectors, 10)
    truth = semantic.nearest_of_all(vectors, 10, queries=asked)
    found = index.search(asked, 10).select("left", "right", F.lit(1).alias("hit"))
    return truth.join(found, ["left", "right"], "left").agg((F.count("hit") >= F.count("*") * F.lit(0.9)).alias("enough"))
