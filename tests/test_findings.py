"""Communities, importance with every reason, topics with every link, files and views on small fixtures."""

import pytest
from pyspark.sql import functions as F

from mailweave.functions import files
from mailweave.plans import derived, questions, tags
from mailweave.plans.semantic import SemanticError, clear_embeddings, search, write_embeddings


def test_importance_with_every_reason(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, sender string")
    signals = spark.createDataFrame(
        [(1, ["me"], 3, ["me"], ["STARRED"], True), (2, ["x", "y", "z", "w"], 0, [], [], False), (3, [], 1, [], [], False)],
        "id long, sent_to array<string>, reply_count long, replied_by array<string>, label_names array<string>, has_attachments boolean",
    )
    own = spark.createDataFrame([(" ME ",)], "address string")
    senders = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "id string, rank double")
    replies = spark.createDataFrame([(3, 0.2), (1, 0.1)], "id long, rank double")
    auto = spark.createDataFrame([(2, 0.5)], "id long, score double")
    got = {r["id"]: r for r in derived.importance(facts, signals, own, senders, replies, auto).collect()}
    assert got[1]["importance"] == pytest.approx(1.0)  # all add up beyond one
    assert set(got[1]["reasons"]) == {"replied by you", "flagged by the provider", "3 replies", "sent by a central correspondent", "addressed directly", "few recipients", "has attachments"}
    assert got[2]["importance"] == 0.0 and got[2]["reasons"] == ["looks automated", "sent by a central correspondent"]
    assert got[3]["importance"] == pytest.approx(0.2) and got[3]["reasons"] == ["1 reply"]


def test_communities(spark):
    labels = spark.createDataFrame([(x, "a") for x in "abc"] + [(x, "d") for x in "de"], "id string, label string")
    ranks = spark.createDataFrame([("a", 0.2), ("b", 0.7)], "id string, rank double")
    people = spark.createDataFrame([("a", "x.org"), ("b", "y.org"), ("c", "y.org")], "id string, domain string")
    found, members = derived.communities(labels, ranks, people)
    (one,) = found.collect()
    assert one["size"] == 3 and one["label"] == "y.org"
    assert {(r["id"], r["rank"]) for r in members.collect()} == {("a", 0.2), ("b", 0.7), ("c", 0.0)}
    again, _ = derived.communities(labels.orderBy(F.desc("id")), ranks, people)
    assert again.first()["id"] == one["id"]


def test_topics_of_every_link(spark):
    """A thread, a ticket, a conversation edge and a similar pair each join; a lone attachment doesn't."""
    rows = [
        (1, [], "t1", "", [], "k1"), (2, [], "t1", "", [], "k2"), (3, ["A-1"], "t3", "", ["f"], "k3"), (4, ["A-1"], "t4", "", [], "k4"),
        (5, [], "t5", "", ["f"], "k5"), (6, [], "t6", "", [], "k6"), (7, [], "t7", "", [], "k7"), (8, [], "t8", "", [], "k8"),
    ]
    facts = spark.createDataFrame(rows, "id long, refs array<string>, thread_id string, subject_norm string, attachments array<string>, participant_key string").withColumn("sent_at", F.lit(None).cast("timestamp"))
    extra = spark.createDataFrame([(6, 7, "conversation", 0.9), (7, 8, "embedding", 0.85), (5, 8, "embedding", 0.4)], "src long, dst long, method string, weight double")
    topics, members = derived.topics(facts, extra)
    groups: dict = {}
    for r in members.collect():
        groups.setdefault(r["topic_id"], set()).add(r["id"])
    assert {frozenset(g) for g in groups.values()} == {frozenset((1, 2)), frozenset((3, 4)), frozenset((6, 7, 8))}
    assert {r["method"] for r in topics.collect()} == {"thread", "ref", "conversation"}


def test_automation_of_messages(spark):
    found = spark.createDataFrame([("t1", 0.3), ("t2", 0.6)], "id string, automation_score double")
    of = spark.createDataFrame([("t1", 1, 0), ("t2", 1, 1), ("t1", 2, 0)], "template_id string, id long, distance int")
    assert {tuple(r) for r in derived.automation(found, of).collect()} == {(1, 0.6), (2, 0.3)}


def test_file_families(spark):
    rows = [
        ("application/pdf", "x", "pdf"), ("application/octet-stream", "a.XLSX", "spreadsheet"), (None, "b.zip", "archive"), ("", "none", "other"),
        ("text/plain", "x.pdf", "text"), ("application/x-unheard", "x.pdf", "other"), ("text/csv; charset=utf-8", None, "table"), ("image/png", None, "image"),
    ]
    df = spark.createDataFrame(rows, "t string, n string, want string").withColumn("got", files.file_family(F.col("t"), F.col("n")))
    assert df.filter("got != want").collect() == []
    assert len({*files.FAMILY_OF_TYPE, files.OTHER}) == 16 == len(files.LABELS)
    assert files.resolve_families(["Rechnungen", "Web page", "Hologramm", "image"], ["pdf", "web", "image"]) == (["pdf", "web", "image"], ["Hologramm"])


def test_created_tags_and_trust(spark):
    known = spark.createDataFrame([("tag:old", "Old", None, "manual")], "tag_id string, name string, color string, origin string")
    more = tags.create_tag(tags.create_tag(known, "Old", "#fff"), "New one")
    assert {(r["tag_id"], r["name"], r["color"]) for r in more.collect()} == {("tag:old", "Old", None), ("tag:new-one", "New one", None)}
    with pytest.raises(ValueError):
        tags.create_tag(known, "  ")
    people = spark.createDataFrame([("a@x.org",)], "id string")
    assert not tags.is_remote_trusted(people, "a@x.org")
    trusted = tags.trust_remote(people, " A@x.org")
    assert tags.is_remote_trusted(trusted, "a@X.org") and not tags.is_remote_trusted(trusted, "b@x.org")


def test_embeddings_and_dispatch(spark):
    messages = spark.createDataFrame([(1,), (2,)], "id long")
    vectors = spark.createDataFrame([(1, "m", [1.0, 0.0])], "id long, model string, vector array<float>")
    rows = spark.createDataFrame([(2, [0.0, 1.0]), (3, [1.0, 1.0]), (1, None)], "id long, vector array<float>")
    written = write_embeddings(vectors, rows, messages, "m")
    assert {r["id"] for r in written.collect()} == {1, 2}
    assert clear_embeddings(written, "m").count() == 0
    hit = search("semantic", "words", written, written, "m", lambda texts: [[0.0, 1.0]], 1).first()
    assert hit["id"] == 2 and hit["score"] == 1.0
    with pytest.raises(SemanticError):
        search("semantic", "words", written, written, "m", None)
    with pytest.raises(ValueError):
        search("other", "words", written, written)


def test_periods():
    from datetime import date, timedelta

    day = date(2024, 2, 29)
    want = {
        "last_7_days": (date(2024, 2, 23), day), "last_30_days": (day - timedelta(29), day), "this_month": (date(2024, 2, 1), day),
        "last_month": (date(2024, 1, 1), date(2024, 1, 31)), "this_quarter": (date(2024, 1, 1), day), "last_quarter": (date(2023, 10, 1), date(2023, 12, 31)),
        "this_year": (date(2024, 1, 1), day), "last_year": (date(2023, 1, 1), date(2023, 12, 31)), "last_12_months": (date(2023, 3, 1), day),
    }
    assert {p: questions.window_of(p, day) for p in want} == want


def test_cells_find_what_brute_force_finds(spark):
    """Clustered vectors of two models: few probes are enough, and every vector is in the index."""
    import numpy as np

    from mailweave.plans import semantic

    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 16))
    rows = [(i, f"m{i % 2}", (middle[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(600)]
    vectors = spark.createDataFrame(rows, "id long, model string, vector array<float>").repartition(3)
    index = semantic.cell_index(vectors, sample=200, small=50)
    assert index.rows.count() == 600 and max(index.probes.values()) < 16
    asked = vectors.filter("id % 20 = 0")
    truth = {(r["left"], r["right"]) for r in semantic.nearest_of_all(vectors, 5, queries=asked).collect()}
    found = {(r["left"], r["right"]) for r in index.search(asked, 5).collect()}
    assert len(truth & found) >= 0.9 * len(truth) and len(truth) == 150
    assert semantic.cell_index(vectors.limit(0)).search(asked, 5).count() == 0


def test_cells_of_vectors_without_clusters(spark):
    """Where nothing is near anything, probes go up until enough is found, for each model and the k that was asked for."""
    import numpy as np

    from mailweave.plans import semantic

    rng = np.random.default_rng(2)
    rows = [(i, "wide" if i % 4 else "flat", (rng.normal(size=24) * ([1] * 24 if i % 4 else [1, 1] + [0.01] * 22)).tolist()) for i in range(800)]
    vectors = spark.createDataFrame(rows, "id long, model string, vector array<float>").repartition(3)
    index = semantic.cell_index(vectors, 10, small=50)
    assert index.probes["flat"] < index.probes["wide"] <= len(index.centres["wide"])
    asked = vectors.filter("id % 10 = 0")
    truth = semantic.nearest_of_all(vectors, 10, queries=asked)
    found = semantic.recall_by_model(truth, index.search(asked, 10), asked)
    assert min(found.values()) >= 0.9
    with pytest.raises(ValueError):
        index.search(asked, 11)
    whole = semantic.cell_index(vectors, 3)
    assert semantic.recall_by_model(semantic.nearest_of_all(vectors, 3, queries=asked), whole.search(asked, 3), asked) == {"wide": 1.0, "flat": 1.0}


def test_neighbour_graph_by_descent(spark):
    """Clustered vectors are found with few comparisons; a model that can't be is compared whole; small ones always are."""
    import numpy as np

    from mailweave.plans import neighbours, semantic

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(160, 12))
    rows = [(i, "near", (middle[i % 160] + 0.2 * rng.normal(size=12)).tolist()) for i in range(6400)]
    rows += [(10_000 + i, "far", rng.normal(size=40).tolist()) for i in range(400)] + [(20_000 + i, "few", [float(i), 1.0]) for i in range(30)] + [(30_000, "few", None)]
    vectors = spark.createDataFrame(rows, "id long, model string, vector array<float>").repartition(4)
    made = neighbours.neighbour_graph(vectors, 5, small=100)
    assert made.whole == ("far", "few") and made.recall["near"] >= 0.95 and made.share["near"] < 0.1
    asked = vectors.filter("id % 50 = 0 AND vector is not null")
    found = semantic.recall_by_model(semantic.nearest_of_all(vectors, 5, queries=asked), made.pairs, asked)
    assert found["near"] >= 0.93 and found["far"] == found["few"] == 1.0
    assert made.pairs.groupBy("left").count().filter("count != 5").count() == 0
    assert neighbours.neighbour_graph(vectors.limit(0)).pairs.count() == 0


def test_accounts_and_files_of_a_question(spark):
    from datetime import date

    accounts = {"ann@x.org": "Gmail privat", "ann@work.example": "Office", "info@work.example": "Office desk"}
    assert questions.resolve_account(accounts, "my Gmail") == "ann@x.org"
    assert questions.resolve_account(accounts, "office") is None  # two match alike
    assert questions.resolve_account(accounts, "desk office") == "info@work.example"
    people = spark.createDataFrame([("bob@x.org", "Bob")], "id string, name string")
    read = {"text": "plan", "file_mentions": ["Tabellen", "Hologramm"], "account_mention": "gmail"}
    intent = questions.Intent(text="plan", file_mentions=("Tabellen", "Hologramm"), account_mention="gmail")
    got = questions.resolve(intent, people, accounts, date(2024, 5, 1), ["spreadsheet", "pdf"])
    assert got.filters.families == ["spreadsheet"] and got.filters.account == "ann@x.org" and got.filters.text == "plan Hologramm"
    none = questions.interpret("?", lambda q: read, people, accounts, date(2024, 5, 1))
    assert none.unresolved == ("Tabellen", "Hologramm") and none.filters.families == []
    with pytest.raises(TypeError):
        questions.interpret("?", lambda q: {"unheard": 1}, people, accounts, date(2024, 5, 1))
