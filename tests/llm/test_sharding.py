"""Histogram-sort shards against sorting all rows in plain Python; hot groups, odd rows, any table layout."""

import hashlib
import random
import zlib

from mailweave.llm import queries, sharding

SCHEMA = "doc_id long, text string, size string, k1 string, n string"


def made():
    r = random.Random(3)
    rows = [(i, "w" * r.randint(0, 300) + str(i)) for i in range(900)]
    rows += [(1000 + i, "the same text, a third of all rows " * 4) for i in range(450)]  # a hot group
    rows += [(2000, "repeated row " * 9)] * 120 + [(None, "no id")] * 3
    rows += [(3000 + i, t) for i, t in enumerate([None, "", None, "x" * 20_000, "été 中文 \U0001f600"])]
    return rows


def key(value):
    return int(hashlib.md5(("" if value is None else str(value)).encode()).hexdigest()[:15], 16)


def expected(rows, shards=40):
    """Splitters of all rows in order: the nearest boundary of groups if near enough, else of rows."""
    size = lambda t: len((t or "").encode()) + 16
    order = sorted(rows, key=lambda r: (key(r[1]), key(r[0])))
    total, largest, at, groups, places = sum(size(t) for _, t in rows), max((size(t) for _, t in rows), default=0), 0, [0], [0]
    for k, (_, t) in enumerate(order):
        at += size(t)
        places.append(at)
        if k + 1 == len(order) or key(order[k + 1][1]) != key(t):
            groups.append(at)
    cuts = []
    for i in range(1, shards):
        near = lambda some: min(some, key=lambda b: (abs(b * shards - i * total), b))  # noqa: E731, B023
        g = near(groups)
        enough = abs(g - i * total / shards) <= max(largest / 2, total / shards / 400)
        cuts.append(max(g if enough else near(places), cuts[-1] if cuts else 0))
    out, slots = [], {}
    for before, (i, t) in zip(places, order):
        s = sum(c <= before for c in cuts)
        out.append((i, size(t), zlib.crc32((t or "").encode()), "bytes", s, slots.setdefault(s, 0), None))
        slots[s] += 1
    return sorted(out, key=repr)


def sharded(spark, rows, folder, parts=3):
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = queries.op12_histogram_sort(spark, folder)
    return sorted((tuple(r) for r in got.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()), key=repr)


def test_sorted_rows(spark, tmp_path):
    rows = made()
    got = sharded(spark, rows, str(tmp_path))
    assert got == expected(rows)
    assert sharded(spark, rows, str(tmp_path), 7) == got
    total, largest = sum(r[1] for r in got), max(r[1] for r in got)
    for s in range(40):
        mine = [r for r in got if r[4] == s]
        assert abs(sum(r[1] for r in mine) - total / 40) <= max(largest, total / 8000)
        assert sorted(r[5] for r in mine) == list(range(len(mine)))


def test_groups_stay_together(spark, tmp_path):
    rows = [(i, f"text {i // 4} " * 5) for i in range(2000)]
    got = sharded(spark, rows, str(tmp_path))
    text = {i: t for i, t in rows}
    homes: dict = {}
    for r in got:
        homes.setdefault(text[r[0]], set()).add(r[4])
    # four equal rows are more than the largest row, so a target in their midst may cut them
    assert sum(len(h) > 1 for h in homes.values()) <= 39
    assert got == expected(rows)


def test_few_rows(spark, tmp_path):
    assert sharded(spark, [], str(tmp_path)) == []
    for rows in ([(1, "a")], [(1, None), (1, None), (None, "")], [(i, "same") for i in range(50)]):
        assert sharded(spark, rows, str(tmp_path)) == expected(rows)


def test_all_columns_pass(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "k", "n"), (2, None, None, None, None)], SCHEMA)
    got = sharding.shard_by_bytes(docs, 2)
    assert got.columns == [*docs.columns, "__size", "__crc", "__shard", "__slot"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(tuple(r) for r in docs.collect())


def test_no_python(spark, tmp_path):
    sharded(spark, made()[:50], str(tmp_path))
    plan = queries.op12_histogram_sort(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
