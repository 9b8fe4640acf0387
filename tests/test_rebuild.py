"""The derived layer: published whole or not at all, and only what reads a change runs again."""

from dataclasses import replace
from datetime import datetime

import pytest

from mailweave import snapshots
from mailweave.plans import rebuild as r
from mailweave.tables import Archive


@pytest.fixture(scope="module")
def archive(spark):
    make = spark.createDataFrame
    people = ["ann@x.org", "bob@x.org", "cyd@y.org", "dee@y.org"]
    day = [datetime(2024, 1, 1 + k) for k in range(12)]
    return Archive(
        messages=make([(k, f"subject {k % 4}", day[k], 10, "text") for k in range(12)], "id long, subject_norm string, sent_at timestamp, size_bytes long, body_text string"),
        recipients=make([(k, people[k % 4], "FROM") for k in range(12)] + [(k, p, "TO") for k in range(12) for p in people if p != people[k % 4]], "message_id long, address_id string, role string"),
        addresses=make([(p, p.split("@")[1], p) for p in people], "id string, domain string, name string"),
        accounts=make([("ann@x.org",)], "address string"),
        message_threads=make([(k, f"t{k // 3}") for k in range(12)], "message_id long, thread_id string"),
        replies=make([(k, k - 1) for k in range(1, 12, 2)], "child long, parent long"),
        message_labels=make([(1, "INBOX")], "message_id long, name string"),
        message_attachments=make([(2, "f1", "a.pdf", "application/pdf", None), (7, "f1", "a.pdf", "application/pdf", None)], "message_id long, sha string, filename string, content_type string, content_id string"),
        copies=make([], "message_id long, account long, archived_at timestamp, size_bytes long"),
        message_tags=make([(0, "tag:a", "manual"), (1, "tag:a", "manual")], "message_id long, tag_id string, source string"),
        vectors=make([(k, "m", [1.0, float(k)]) for k in range(12)], "id long, model string, vector array<float>"),
    )


@pytest.fixture(scope="module")
def bodies(spark):
    return spark.createDataFrame([(k, f"the crane {k % 3} stands", f"the crane {k % 3} stands", 1 << (k % 3)) for k in range(12)], "id long, text string, body_clean string, simhash long")


def rows(tables):
    return {t: sorted(map(str, df.collect())) for t, df in tables.items()}


def test_only_what_changed_runs(spark, archive, bodies, tmp_path):
    path = str(tmp_path / "derived")
    assert r.read_derived(spark, path) == {}
    first = r.refresh(spark, path, archive, bodies)
    assert first.ran == [s.name for s in r.STAGES]
    whole = r.rebuild(archive, bodies)
    assert rows(first.tables) == rows(whole.tables) and first.counts == whole.counts and whole.seconds.keys() == first.seconds.keys()
    again = r.refresh(spark, path, archive, bodies)
    assert again.ran == [] and again.counts == first.counts and rows(again.tables) == rows(first.tables)
    assert snapshots.versions(spark, path) == [1]
    labelled = replace(archive, message_labels=archive.message_labels.union(spark.createDataFrame([(3, "STARRED")], "message_id long, name string")))
    third = r.refresh(spark, path, labelled, bodies.repartition(5))  # the order of rows is no change
    assert third.ran == ["importance"] and rows(third.tables) == rows(r.rebuild(labelled, bodies).tables)
    tagged = replace(labelled, message_tags=archive.message_tags.limit(1))
    assert r.refresh(spark, path, tagged, bodies).ran == ["suggestions"]
    assert r.refresh(spark, path, tagged, None).ran == ["keywords", "templates", "importance"]


def test_a_layer_is_published_whole(spark, archive, bodies, tmp_path, monkeypatch):
    path = str(tmp_path / "derived")
    r.refresh(spark, path, archive, bodies)
    before = rows(r.read_derived(spark, path))
    save, written = r._save, []

    def fails(df, at, name):
        if len(written) == 5:
            raise OSError("lost between two tables")
        written.append(name)
        return save(df, at, name)

    monkeypatch.setattr(r, "_save", fails)
    less = replace(archive, messages=archive.messages.filter("id < 6"))
    with pytest.raises(OSError):
        r.refresh(spark, path, less, bodies)
    assert len(written) == 5 and rows(r.read_derived(spark, path)) == before
    monkeypatch.setattr(r, "_save", save)
    r.refresh(spark, path, less, bodies)
    r.refresh(spark, path, archive, bodies)  # the manifest of the first is forgotten, its folders go
    assert rows(r.read_derived(spark, path)) == before
    assert len(list((tmp_path / "derived" / "topics").iterdir())) == 2
    other = r.rebuild(archive)
    other.write(spark, path)
    assert rows(r.read_derived(spark, path)) == rows(other.tables)
