"""The Merkle manifest against hashing in plain Python; proofs hold for every row and fail for tampered ones."""

import hashlib
import random
import zlib

from mailweave.llm import merkle_manifest, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, i long, g string, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root of a list of digests, and the siblings (left, right) of each, level by level."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(at):
            run = leaves[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        leaves, at = [sha(*leaves[i : i + 3]) for i in range(0, len(leaves), 3)], [i // 3 for i in at]
    return leaves[0], paths


def expected(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    kept = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    trees = {s: tree([leaf(r) for r in kept[s]]) for s in order}
    if not order:
        return []
    root, over = tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, over):
        for r, path in zip(kept[s], trees[s][1]):
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = (*r[:4], r[4].replace("\n", ""))
            h = leaf(now)
            for a, b in path + above:
                h = sha(a, h, b)
            out.append((r[0], leaf(r), trees[s][0], root, sha(*(a + b for a, b in path + above)), h, h == root))
    return sorted(out, key=repr)


def built(spark, rows, folder):
    spark.createDataFrame([(*r, 7, "g", "p") for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, folder)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def made():
    r = random.Random(9)
    rows = [(i, ["hot", "hot", "b", None, "é", "中"][i % 6], r.choice(["en", None]), i, "line\n" * r.randint(0, 3) + str(i)) for i in range(200)]
    rows += [(500, "lone", None, None, None), (500, "hot", "en", 1, "same id\n"), (500, "hot", "en", 2, "same id"), (None, None, None, None, None)]
    return [*rows, rows[3], rows[3], (None, "hot", "fr", 5, ""), (501, "", "en", 3, "x" * 50_000)]


def test_plain_hashing(spark, tmp_path):
    rows = made()
    got = built(spark, rows, str(tmp_path))
    assert got == expected(rows)
    assert {r[6] for r in got} == {True, False}


def test_few_rows(spark, tmp_path):
    assert built(spark, [], str(tmp_path)) == []
    for n in (1, 2, 3, 4, 9, 10):
        rows = [(i, "s", "en", 1, "a\nb") for i in range(n)]
        assert built(spark, rows, str(tmp_path)) == expected(rows)
    lone = [(i, f"s{i}", "en", 1, "a") for i in range(5)]
    assert built(spark, lone, str(tmp_path)) == expected(lone)


def test_joins_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "BROADCAST_NODES", 0)
    rows = made()[:60]
    assert built(spark, rows, str(tmp_path)) == expected(rows)
