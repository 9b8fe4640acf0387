"""Links of topics: stars of shared values merge at once, hot hubs too, and only what is asked for is made."""

import random
from collections import defaultdict

import pytest

from mailweave.operators import graph
from mailweave.plans import derived

SCHEMA = "id long, thread_id string, subject_norm string, attachments array<string>, participant_key string, sent_at timestamp"


def smallest(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def components(spark, pairs):
    rows = graph.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]: r["component"] for r in rows}


def test_stars_are_merged_at_once(spark, monkeypatch):
    """Threads of 20 with answers inside of them and between neighbours: all tables together hold few times the edges."""
    r = random.Random(3)
    pairs = [(20 * t, 20 * t + k) for t in range(300) for k in range(1, 20)]
    pairs += [(20 * t + k - 1, 20 * t + k) for t in range(300) for k in range(2, 20) if r.random() < 0.5]
    pairs += [(20 * t + r.randrange(20), 20 * t + 20 + r.randrange(20)) for t in range(299) if t % 3]
    r.shuffle(pairs)
    rows, kept = [], graph.measured

    def measured(df, *a, **k):
        out, seen = kept(df, *a, **k)
        rows.append(out.count())
        return out, seen

    monkeypatch.setattr(graph, "measured", measured)
    monkeypatch.setattr(graph, "cut", lambda df: measured(df)[0])
    assert components(spark, pairs) == smallest(pairs)
    assert sum(rows) < 3 * len(pairs)


@pytest.mark.parametrize("few", [0, graph.FEW_VERTICES])
def test_any_graph_with_hot_hubs(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "HOT_EDGES", 20)
    monkeypatch.setattr(graph, "FEW_VERTICES", few)
    r = random.Random(1)
    hubs = [r.randrange(3000) for _ in range(4)]
    pairs = [(hubs[k % 4], r.randrange(3000)) for k in range(600)] + [(r.randrange(3000), r.randrange(3000)) for _ in range(300)]
    pairs += [(k, k + 1) for k in range(4000, 4006)] + [(5000, 5000), (5001, 5001)]
    assert components(spark, pairs) == smallest(pairs)


def test_nothing_to_join(spark):
    assert components(spark, []) == {} and components(spark, [(4, 4)]) == {4: 4}


def test_members_carry_the_smallest_id(spark):
    r = random.Random(8)
    rows = [(i, f"t{r.randrange(60)}" if i % 4 else None, f"s{r.randrange(90)}" if i % 5 == 0 else "", [], None, None) for i in range(200)]
    facts = spark.createDataFrame(rows, SCHEMA)
    links = derived.topic_links(facts)
    found, members = derived.topics(facts)
    groups = defaultdict(set)
    for m in members.collect():
        groups[m["topic_id"]].add((m["id"], m["method"], m["score"]))
    got = defaultdict(set)
    for m in links.collect():
        got[m["component"]].add((m["id"], m["method"], m["score"]))
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values()}
    assert all(c == min(x for x, *_ in g) for c, g in got.items())
    assert {f["component"]: f["message_count"] for f in derived.topic_facts(links, facts).collect()} == {c: len(g) for c, g in got.items()}
    assert found.columns == ["id", "label", "method", "score", "message_count", "first_seen", "last_seen"]
