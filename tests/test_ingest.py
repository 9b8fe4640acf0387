"""Parsing, cleaning, incremental ingest, thread repair, rebuild and question resolving."""

from datetime import date
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailweave.functions import text
from mailweave.plans import derived, questions, tags
from mailweave.plans.listing import Filters, NothingToSearch, full_text, postings
from mailweave.plans.semantic import SemanticError, embed, hashing_embedder, search_checked
from mailweave.sources import mail
from mailweave.streaming.ingest import ingest


def planted(key, sender, to, subject, body, parent=None, attach=False):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = sender, ", ".join(to), subject
    m["Message-ID"], m["Date"] = f"<{key}@Harbour.Example>", "Tue, 02 Jan 2024 09:00:00 +0100"
    if parent:
        m["In-Reply-To"] = f"<{parent}@harbour.example>"
    m.set_content(body)
    if attach:
        m.add_attachment(b"%PDF-1.4 x", maintype="application", subtype="pdf", filename="plan.pdf")
    return m.as_bytes()


@pytest.fixture
def folder(tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.eml").write_bytes(planted("m1", "Ann <ann@harbour.example>", ["bob@harbour.example"], "Quay PLAN-12", "Crane notes.\n-- \nAnn", attach=True))
    (box / "b.eml").write_bytes(planted("m2", "bob@harbour.example", ["ann@harbour.example"], "AW: Quay PLAN-12", "Fine.\n> Crane notes.", "m1"))
    (box / "c.eml").write_bytes(b"\n")  # Spark skips files of no bytes
    return box


def test_parse(spark, folder):
    parsed = mail.parsed_messages(mail.eml_files(spark, str(folder)))
    assert mail.dead_letters(parsed).count() == 1
    t = mail.ground_truth(parsed)
    by = {r["id"]: r for r in t["messages"].collect()}
    assert set(by) == {"m1@harbour.example", "m2@harbour.example"}
    assert by["m1@harbour.example"]["body_clean"] == "Crane notes." and by["m1@harbour.example"]["has_attachments"]
    assert by["m2@harbour.example"]["body_clean"] == "Fine."
    assert by["m1@harbour.example"]["simhash"] == text.simhash_text("Crane notes.")
    assert str(by["m1@harbour.example"]["sent_at"]) == "2024-01-02 08:00:00"
    assert [tuple(r) for r in t["replies"].select("child", "parent").collect()] == [("m2@harbour.example", "m1@harbour.example")]
    assert t["message_attachments"].count() == 1
    assert mail.storage_usage(spark, str(folder)).first()["files"] == 3


def test_incremental_ingest(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest(spark, str(folder), out, state)
    assert spark.read.parquet(f"{out}/messages").count() == 2
    (folder / "d.eml").write_bytes(planted("m3", "cyd@harbour.example", ["ann@harbour.example"], "New", "Hello"))
    (folder / "again.eml").write_bytes((folder / "a.eml").read_bytes())
    ingest(spark, str(folder), out, state)
    ingest(spark, str(folder), out, state)
    assert spark.read.parquet(f"{out}/messages").count() == 3
    assert spark.read.parquet(f"{out}/dead_letters").count() == 1


BAD = {
    "late": b"Date: Fri, 31 Dec 9999 23:59:59 -1200\r\nMessage-ID: <late@x.org>\r\nFrom: a@x.org\r\n\r\nlate",
    "old": b"Date: Mon, 01 Jan 1500 10:00:00 +0000\r\nMessage-ID: <old@x.org>\r\nFrom: a@x.org\r\n\r\none\rtwo\r\nthree",
    "odd": b"Content-Type: text/plain; charset=no-such-charset\r\nMessage-ID: <odd@x.org>\r\nFrom: a@x.org\r\n\r\nGr\xc3\xbc\xc3\x9fe \xff",
    "cut": b"Content-Type: multipart/mixed; boundary=zz\r\nMessage-ID: <cut@x.org>\r\n\r\nno boundary here",
    "raw": b"Subject: \xff\xfe\r\nMessage-ID: <raw@x.org>\r\nDate: never\r\n\r\n\xed\xa0\x80",
}


def test_no_mail_stops_the_job(spark):
    rows = [(k, bytearray(v)) for k, v in BAD.items()] + [("none", None), ("good", bytearray(planted("g", "a@x.org", ["b@x.org"], "Hi", "x" * 200_000)))]
    by = {r["path"]: r for r in mail.parsed_messages(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert set(by) == {*BAD, "none", "good"}
    assert by["old"]["error"] is None and by["old"]["sent_at"].year == 1500 and by["old"]["body_text"].strip() == "one\ntwo\nthree"
    assert by["late"]["error"] is None and by["late"]["sent_at"] is None
    assert by["odd"]["error"] is None and by["odd"]["body_text"].startswith("Grüße")
    assert by["cut"]["error"] and by["none"]["error"]
    assert by["raw"]["error"] is None and by["raw"]["sent_at"] is None
    assert len(by["good"]["body_text"].strip()) == 200_000


def test_a_replayed_batch_changes_nothing(spark, folder, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from mailweave.streaming.ingest import archive_batch, archived_addresses

    out = str(tmp_path / "out")
    raw = mail.eml_files(spark, str(folder))
    plain = DataFrameWriter.parquet

    def fails(self, path, *a, **k):
        if "/messages/" in path:
            raise OSError("lost between two writes")
        return plain(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", fails)
    with pytest.raises(OSError):
        archive_batch(out)(raw, 0)
    monkeypatch.setattr(DataFrameWriter, "parquet", plain)
    for _ in range(2):
        archive_batch(out)(raw, 0)
    archive_batch(out)(raw, 1)  # the same mail again in another batch
    n = {t: spark.read.parquet(f"{out}/{t}").count() for t in ("messages", "recipients", "message_attachments", "reply_links")}
    assert n == {"messages": 2, "recipients": 4, "message_attachments": 1, "reply_links": 1}
    assert {r["id"]: r["display_names"] for r in archived_addresses(spark, out).collect()} == {"ann@harbour.example": ["Ann"], "bob@harbour.example": []}
    assert spark.read.parquet(f"{out}/blobs").select("sha256").distinct().count() == 3


def test_threads_are_repaired(spark):
    messages = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    threads = spark.createDataFrame([(1, "t")], "message_id long, thread_id string")
    copies = spark.createDataFrame([(2, 7, "p"), (3, 7, None), (1, 7, "q")], "message_id long, account long, provider_thread_id string")
    assert {tuple(r) for r in mail.repair_threads(messages, threads, copies).collect()} == {(2, "7:p"), (3, "7:3")}


def test_near_keys_are_complete(spark):
    """Fingerprints that share a band and differ in at most five bits share a key; others that do needn't."""
    import random

    r = random.Random(2)
    rows = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), r.randint(0, 6)):
            b ^= 1 << i
        band = any((a ^ b) >> s & 0xFFFF == 0 for s in range(0, 64, 16))
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((signed(a), signed(b), band and (a ^ b).bit_count() <= 5))
    df = spark.createDataFrame(rows, "a long, b long, near boolean")
    shared = df.withColumn("hit", F.size(F.array_intersect(derived.near_keys(F.col("a"), 5), derived.near_keys(F.col("b"), 5))) > 0)
    assert not shared.filter("near and not hit").count() and shared.filter("near").count() > 50


def test_templates_against_brute_force(spark):
    import itertools
    import random

    r = random.Random(4)
    prints = []
    for _ in range(40):
        base = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            p = base
            for i in r.sample(range(64), r.randint(0, 4)):
                p ^= 1 << i
            prints.append(p - (1 << 64) if p >> 63 else p)
    facts = spark.createDataFrame([(i, p, f"body {i}", i % 3 == 0) for i, p in enumerate(prints)], "id long, simhash long, body_clean string, outbound boolean").withColumn("sent_at", F.timestamp_seconds(F.col("id") * 86400))
    up = {i: i for i in range(len(prints))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        x = (prints[i] ^ prints[j]) & (2**64 - 1)
        if (i % 3 == 0) == (j % 3 == 0) and x.bit_count() <= 5 and any(x >> s & 0xFFFF == 0 for s in range(0, 64, 16)):
            up[max(root(i), root(j))] = min(root(i), root(j))
    groups: dict = {}
    for i in range(len(prints)):
        groups.setdefault(root(i), set()).add(i)
    want = {frozenset(g) for g in groups.values() if len(g) >= 3}
    _, members = derived.templates(facts)
    got: dict = {}
    for row in members.collect():
        got.setdefault(row["template_id"], set()).add(row["id"])
    assert {frozenset(g) for g in got.values()} == want and len(want) > 3


def test_simhash_bit_by_bit():
    import hashlib
    from collections import Counter

    body = "the harbour office counts ships and the harbour office counts cranes and ships"
    words = body.split()
    ones = [0] * 64
    for s, n in Counter(" ".join(words[i : i + 3]) for i in range(len(words) - 2)).items():
        d = int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")
        for b in range(64):
            ones[b] += n if d >> b & 1 else -n
    assert text.simhash_text(body) & (2**64 - 1) == sum(1 << b for b in range(64) if ones[b] > 0)


def test_pages_and_bodies_of_the_tables(spark):
    """Registered page texts and clean bodies equal a plain loop over the rows."""
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables aren't here")
    from mailweave.plans import registry

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in registry.queries()["page_texts"](spark, data).collect():
        assert r["text"] == text.html_text(pages[r["page_id"]])
        assert "<script" not in r["text"] and "\n\n\n" not in r["text"]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in registry.queries()["body_clean"](spark, data).collect():
        assert r["body_clean"] == text.clean_text(docs[r["id"]])
        assert not any(x.lstrip().startswith(">") for x in r["body_clean"].split("\n"))


def test_text_functions(spark):
    row = spark.createDataFrame([("WG: AW: Re[2]: [ABC-123]  Budget UTF-8 #4711 () plan", " <Ann@X.Example> ")], "s string, a string").select(
        text.normalise_subject(F.col("s")).alias("s"), text.extract_refs(F.col("s")).alias("r"), text.normalise_address(F.col("a")).alias("a"),
        text.participant_key(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("k"), text.hamming(F.lit(-1), F.lit(0)).alias("h"),
    ).first()
    assert row["s"] == "budget utf-8 plan" and row["r"] == ["#4711", "ABC-123"] and row["a"] == "ann@x.example" and row["h"] == 64
    import hashlib

    assert row["k"] == hashlib.sha256(b"a|b").hexdigest()
    assert text.simhash_text("") == 0 and text.simhash_text("a b c d") == text.simhash_text("A b  C d")
    assert text.slug("Größe & Maß") == "tag:groesse-mass" and text.slug("!!!").startswith("tag:")
    assert text.html_text("<head><title>x</title></head><p>a&amp;b</p><script>y</script><p>c</p>") == "a&b\n\nc"
    assert text.clean_text("Hello\n\nOn Monday Ann wrote:\n> old") == "Hello"


def test_templates_and_topics(spark):
    body = "the monthly report of the harbour office lists cranes quays ships crews and cargo in the order of arrival for the board " * 2
    rows = [(i, f"2024-{i:02d}-01 00:00:00", body, True) for i in range(1, 13)] + [(i, "2024-01-01 00:00:00", f"other words {i} here and there {i * 7}", True) for i in range(20, 24)]
    facts = spark.createDataFrame(rows, "id long, at string, body_clean string, outbound boolean").withColumn("sent_at", F.to_timestamp("at")).withColumn("simhash", text.simhash("body_clean"))
    found, members = derived.templates(facts)
    (one,) = found.collect()
    assert one["occurrences"] == 12 and one["id"].endswith(":sent") and one["automation_score"] > 0.5
    assert {r["id"] for r in members.collect()} == set(range(1, 13)) and all(r["distance"] == 0 for r in members.collect())
    topic = spark.createDataFrame(
        [(1, ["P-1"], "t1", "s", ["x"], "k1"), (2, ["P-1"], "t2", "s2", ["y"], "k2"), (3, [], "t3", "s3", ["z"], "k3"), (4, [], "t4", "s4", ["z"], "k3"), (5, [], "t5", "s5", ["z"], "k5")],
        "id long, refs array<string>, thread_id string, subject_norm string, attachments array<string>, participant_key string",
    ).withColumn("sent_at", F.lit(None).cast("timestamp"))
    topics, of = derived.topics(topic)
    assert {frozenset(r["ids"]) for r in of.groupBy("topic_id").agg(F.collect_set("id").alias("ids")).collect()} == {frozenset((1, 2)), frozenset((3, 4))}
    assert {r["method"] for r in topics.collect()} == {"ref", "attachment"}


def test_rebuild_twice_is_the_same(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables aren't here")
    from mailweave.plans.rebuild import rebuild
    from mailweave.tables import driver_archive

    def no_vectors():
        raise SemanticError("nothing is embedded")

    one, two = (rebuild(driver_archive(spark, "/root/testdata/sf0.001"), similar=no_vectors) for _ in range(2))
    assert one.counts == two.counts and one.counts["similar_skipped"] == 1
    for name in ("topics", "message_importance", "communities"):
        assert sorted(map(str, one.tables[name].collect())) == sorted(map(str, two.tables[name].collect()))


def test_questions(spark):
    directory = spark.createDataFrame([("info@santak.example", "Santak Verwaltung"), ("no-reply@cloud.example", "Cloud"), ("ann@x.example", "Ann")], "id string, name string")
    assert questions.resolve_addresses(directory, "meine Hausverwaltung Santak") == ["info@santak.example"]
    assert questions.resolve_addresses(directory, "the") == []
    day = date(2024, 5, 15)
    assert questions.window_of("last_quarter", day) == (date(2024, 1, 1), date(2024, 3, 31))
    assert questions.window_of("last_month", day) == (date(2024, 4, 1), date(2024, 4, 30))
    got = questions.resolve(questions.Intent(text="invoice", from_mentions=("Santak", "Nobody"), period="this_year", after="0202-03-01"), directory, {}, day)
    assert got.filters == Filters(text="invoice Nobody", senders=["info@santak.example"], sent_from="2024-01-01", sent_until="2024-05-15")
    assert got.unresolved == ("Nobody",) and len(got.notes) == 1
    newest = questions.resolve(questions.Intent(text="invoice", from_mentions=("Santak",), newest=True), directory, {}, day)
    assert newest.filters.text == "" and newest.notes


def test_explicit_failures(spark):
    vectors = spark.createDataFrame([(1, "m", [1.0, 0.0])], "id long, model string, vector array<float>")
    for query, model in ((None, "m"), ([1.0], "m"), ([1.0, 0.0], "other")):
        with pytest.raises(SemanticError):
            search_checked(vectors, query, model)
    with pytest.raises(NothingToSearch):
        full_text(postings(spark.createDataFrame([(1, "a")], "id long, text string")), "!!", 5)
    with pytest.raises(ValueError):
        tags.writable("messages")
    made = embed(spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string"), hashing_embedder(8), "m", 8).collect()
    assert all(len(r["vector"]) == 8 for r in made)
    bad = embed(spark.createDataFrame([(1, "a b")], "id long, text string"), hashing_embedder(4), "m", 8).collect()
    assert bad[0]["vector"] is None
