"""The mailbox as a data source, and archiving each message once by the stream's state."""

import os
import random

import pytest

from mailweave.plans.listing import full_text, postings
from mailweave.plans.postings import PostingsIndex
from mailweave.sources import mail
from mailweave.sources.mailbox import MailboxReader, MailboxStreamReader, between, mailbox, mark
from mailweave.streaming.once import archive_once, archived_messages


def put(box, name, key, body="Crane notes.", head=""):
    os.makedirs(box, exist_ok=True)
    text = f"Message-ID: <{key}@x.org>\r\n" if key else ""
    with open(box / f".{name}", "wb") as f:
        f.write(f"{text}From: ann@x.org\r\nTo: bob@x.org\r\nDate: Tue, 02 Jan 2024 09:00:00 +0100\r\nSubject: Quay\r\n{head}\r\n{body}".encode())
    os.rename(box / f".{name}", box / f"{name}.eml")  # finished files are moved into place


def test_marks(tmp_path):
    box = tmp_path / "box"
    put(box, "b", "1")
    put(box / "deep", "a", "2")
    reader = MailboxStreamReader({"path": str(box), "filesPerTask": "1"})
    zero, first = reader.initialOffset(), reader.latestOffset()
    put(box, "a", "3")  # arrives during the walk, its name is before the others
    os.utime(box / "a.eml", (1, 1))  # and its date is old
    walk = [p for part in reader.partitions(zero, first) for p in part.paths]
    assert walk == ["b.eml", "deep/a.eml"]
    second = reader.latestOffset()
    assert between(str(box), first, second) == ["a.eml"] and reader.latestOffset() == second
    os.remove(box / "a.eml")  # the newest goes: the mark doesn't go back, and what is gone is skipped
    third = reader.latestOffset()
    assert third["at"] >= second["at"] and reader.partitions(second, third) == []
    assert [x[0] for part in reader.partitions(zero, second) for x in reader.read(part)] == [str(box / "b.eml"), str(box / "deep/a.eml")]
    assert mark(str(tmp_path / "none")) == {"at": 0, "names": "[]"}
    with pytest.raises(ValueError):
        MailboxReader({"path": str(tmp_path / "none")})


def test_mail_of_one_moment(tmp_path, monkeypatch):
    """Files of the same time of change are told apart by name."""
    from mailweave.sources import mailbox as source

    listing = [(5, None), (5, "a.eml"), (5, "b.eml")]
    monkeypatch.setattr(source, "_walk", lambda folder: iter(listing))
    first = mark("x")
    listing += [(5, "late.eml"), (6, "new.eml")]
    second = mark("x")
    assert between("x", {"at": 0, "names": "[]"}, first) == ["a.eml", "b.eml"]
    assert between("x", first, second) == ["late.eml", "new.eml"]


def test_batch_and_stream(spark, tmp_path):
    box = tmp_path / "box"
    for k in range(5):
        put(box, f"m{k}", f"id{k}")
    (box / "note.txt").write_text("no mail")
    whole = mailbox(spark, str(box), files_per_task=2)
    assert sorted(os.path.basename(r["path"]) for r in whole.collect()) == [f"m{k}.eml" for k in range(5)]
    assert whole.rdd.getNumPartitions() == 3 and mail.parsed_messages(whole).filter("error is null").count() == 5
    empty = tmp_path / "empty"
    empty.mkdir()
    assert mailbox(spark, str(empty)).count() == 0
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        raw = mailbox(spark, str(box), stream=True)
        raw.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(os.path.basename(r["path"]) for r in spark.read.parquet(out).collect())

    assert run() == [f"m{k}.eml" for k in range(5)]
    put(box, "a", "id9")
    assert run() == sorted(["a.eml", *(f"m{k}.eml" for k in range(5))])
    assert len(run()) == 6  # nothing new, nothing twice


def test_each_message_once(spark, tmp_path):
    """Copies in one batch, in later ones and after a restart; mail without an id; letters that can't be read."""
    box, out, state = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "state")
    index, seen = PostingsIndex(spark, str(tmp_path / "index")), []

    def after(fresh, number):
        seen.append(fresh.count())
        index.add(fresh.select("id", fresh["body_clean"].alias("text")), f"batch-{number}")

    def run(days=None):
        archive_once(spark, mailbox(spark, str(box), stream=True), out, state, days, after)
        return sorted(r["id"] for r in spark.read.parquet(f"{out}/messages").collect())

    keys = [f"k{i % 7}" for i in range(20)]
    random.Random(4).shuffle(keys)
    for n, key in enumerate(keys[:12]):
        put(box, f"m{n}", key, body=f"Body of {key}")
    put(box, "bare1", None, body="no id")
    put(box, "bare2", None, body="no id")
    (box / "broken.eml").write_bytes(b"\n")
    first = run()
    assert len(first) == len(set(first)) == len(set(keys[:12])) + 1
    for n, key in enumerate(keys[12:]):
        put(box, f"n{n}", key, body=f"Body of {key}")
    put(box, "bare3", None, body="no id")
    again = run()
    assert len(again) == len(set(again)) == 8 and sum(seen) == 8
    assert run() == again and sum(seen) == 8
    assert archived_messages(spark, out).count() == 8 and spark.read.parquet(f"{out}/dead_letters").count() == 1
    texts = archived_messages(spark, out).selectExpr("id", "body_clean AS text")
    assert [tuple(r) for r in index.search("body").collect()] == [tuple(r) for r in full_text(postings(texts), "body").collect()]


def test_arrivals_are_forgotten(spark, tmp_path):
    """With an expiry the state holds a time to live; within it nothing comes twice."""
    box, out, state = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "state")
    put(box, "a", "1")
    for _ in range(2):
        archive_once(spark, mailbox(spark, str(box), stream=True), out, state, days=30)
        put(box, "b", "1")
    assert spark.read.parquet(f"{out}/messages").count() == 1
