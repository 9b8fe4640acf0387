"""The persisted index: the scores of a scan, blocks of other terms unread, batches added and repeated, cells skipped."""

import random
from pathlib import Path

import pytest

from mailweave import snapshots
from mailweave.plans import postings as kept
from mailweave.plans.listing import NothingToSearch, full_text, postings
from mailweave.plans.postings import PostingsIndex

WORDS = [f"word{i}" for i in range(60)]


def made(n, seed):
    r = random.Random(seed)
    return [(seed * 100_000 + i, " ".join(r.choices(["crane", "quay", *WORDS], weights=[8, 4, *[1] * 60], k=r.choice([4, 9, 30, 200])))) for i in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return [spark.createDataFrame(made(300, k), "id long, text string") for k in range(3)]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_search_equals_the_scan(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "CELL", 16)
    monkeypatch.setattr(kept, "FIRST", 4)
    index = PostingsIndex(spark, str(tmp_path / "index"))
    assert rows(index.search("crane")) == []
    for k, t in enumerate(texts):
        index.add(t, f"batch-{k}")
    scan = postings(texts[0].union(texts[1]).union(texts[2])).cache()
    for query, limit in (("crane quay", 5), ("Quay", 10), ("word3 crane", 7), ("crane word1 word2", 50), ("absent crane", 5), ("crane", None)):
        got, want = rows(index.search(query, limit)), rows(full_text(scan, query, limit))
        assert (got if limit else sorted(got)) == (want if limit else sorted(want)), query
    found, seen = index.plan("crane quay", 5)
    assert 0 < seen["scored"] < seen["cells"] and found.count() == 5
    index.merge("all")
    assert list(index.segments()) == ["all"] and rows(index.search("crane quay", 5)) == rows(full_text(scan, "crane quay", 5))
    with pytest.raises(NothingToSearch):
        index.search("--")


def test_other_postings_are_not_read(spark, texts, tmp_path):
    index = PostingsIndex(spark, str(tmp_path / "index"))
    index.add(texts[0], "batch-0")
    plan = index.blocks_of(["crane", "quay"]).select("term", "top_tf")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term, [crane,quay])]" in plan and "ids" not in plan


def test_a_batch_leaves_the_others_alone(spark, texts, tmp_path, monkeypatch):
    folder = tmp_path / "index"
    index = PostingsIndex(spark, str(folder))
    files = lambda: {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    index.add(texts[0], "batch-0")
    before = files()
    index.add(texts[1], "batch-1")
    assert before.items() <= files().items()
    index.add(texts[1], "batch-1")  # the batch again
    want = rows(full_text(postings(texts[0].union(texts[1])), "crane", 9))
    assert rows(index.search("crane", 9)) == want
    monkeypatch.setattr(snapshots, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost before the manifest")))
    with pytest.raises(OSError):
        index.add(texts[2], "batch-2")
    assert rows(index.search("crane", 9)) == want and set(index.segments()) == {"batch-0", "batch-1"}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    assert snapshots.current(spark, path) is None and snapshots.versions(spark, path) == []
    for k in range(1, 4):
        assert snapshots.publish(spark, path, {"k": k}, after=k - 1) == k
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, path, {}, after=2)
    assert snapshots.current(spark, path) == {"k": 3} and snapshots.current(spark, path, 1) == {"k": 1}
    assert snapshots.forget(spark, path, 1) == [{"k": 1}, {"k": 2}] and snapshots.versions(spark, path) == [3]
    assert not list(Path(path).rglob(".*[0-9a-f]")) or snapshots.current(spark, path) == {"k": 3}
