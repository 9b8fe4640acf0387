"""Topics against joining all pairs in plain Python, with a value that very many messages share."""

import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from mailweave.plans import derived

SCHEMA = "id long, thread_id string, subject_norm string, attachments array<string>, participant_key string, refs array<string>, sent_at timestamp"
WEIGHTS = {"ref": 1.0, "thread": 0.8, "subject": 0.5, "attachment": 0.4, "participants": 0.2}


def made(n, hot):
    r = random.Random(6)
    rows = []
    for i in range(n):
        some = lambda p, kinds: f"v{r.randrange(kinds)}" if r.random() < p else None
        files = [f"f{r.randrange(n // 3)}" for _ in range(r.randrange(3))]
        rows.append((i, some(0.2, n), some(0.1, n), files, some(0.9, 12), [], None))
    rows += [(n + i, None, None, ["hot"], "hot", [], None) for i in range(hot)]  # only together are they enough
    rows += [(n + hot, None, None, ["hot"], "other", [], None), (n + hot + 1, None, None, None, "hot", None, None)]
    return rows


def expected(rows, cap):
    """(messages left out, groups of joined messages): every pair's signals summed."""
    shared, size = defaultdict(list), {}
    for i, thread, subject, files, people, refs, _ in rows:
        for s, vs in (("ref", refs), ("thread", [thread]), ("subject", [subject]), ("attachment", files), ("participants", [people])):
            for v in set(vs or []):
                if v:
                    shared[s, v].append(i)
    dropped = [k for k, ids in shared.items() if cap and len(ids) > cap]
    weights = defaultdict(dict)
    for (s, v), ids in shared.items():
        if (s, v) not in dropped:
            for a, b in combinations(ids, 2):
                weights[a, b][s] = WEIGHTS[s]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, b), w in weights.items():
        if sum(w.values()) >= 0.5 - 1e-9:
            root[find(a)] = find(b)
    groups = defaultdict(set)
    for x in root:
        groups[find(x)].add(x)
    return len(dropped), {frozenset(g) for g in groups.values() if len(g) > 1}


def found(spark, rows, cap):
    counts: dict = {}
    _, members = derived.topics(spark.createDataFrame(rows, SCHEMA).repartition(4), cap=cap, counts=counts)
    groups = defaultdict(set)
    for r in members.collect():
        groups[r["topic_id"]].add(r["id"])
    return counts, {frozenset(g) for g in groups.values()}, members


def test_all_pairs(spark):
    rows = made(300, 40)
    for cap in (None, 30):
        dropped, want = expected(rows, cap)
        counts, got, _ = found(spark, rows, cap)
        assert got == want and counts["dropped_buckets"] == dropped
        assert (dropped > 0) == (cap is not None)


def test_a_value_of_ten_thousand(spark):
    """The links of a large bucket are as many as its messages, and none is left out."""
    rows = made(60, 10_000)
    counts, got, members = found(spark, rows, None)
    hot = next(g for g in got if 60 in g)
    assert hot == set(range(60, 10_060)) and counts == {"dropped_buckets": 0, "dropped_bucket_members": 0}
    assert members.filter("id >= 60").select("method", F.round("score", 3)).distinct().collect() == [("attachment", 0.6)]
    assert derived.weak_edges(derived.signal_buckets(spark.createDataFrame(rows, SCHEMA), None)).count() < 10_100
    counts, got, _ = found(spark, rows, 200)
    assert not any(60 in g for g in got) and counts["dropped_buckets"] == 2 and counts["dropped_bucket_members"] == 20_002
