"""Repeated windows of long texts that repeat themselves: work grows with the text, not with its square."""

import hashlib
import random
import time

import pytest

from mailweave.llm.substring_dedup import LENGTH, remove_repeats


def expected(texts):
    """Kept bytes of each text by the definition, for texts whose windows can be listed."""
    places: dict = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - LENGTH + 1):
            places.setdefault(t[i : i + LENGTH], []).append((k, i))
    out = []
    for k, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if len(places[t[i : i + LENGTH]]) > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        out.append(bytes(c for c, g in zip(t, gone) if not g))
    return out


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(docs).collect()}


def test_periods_by_definition(spark):
    r = random.Random(2)
    noise = "".join(r.choice("abcdefgh ") for _ in range(900))
    texts = ["a" * 150, "a" * 200, "b" * 201, "c" * 700, "abcdefg" * 90, noise + "abcdefg" * 60, noise[:450] + "c" * 230 + noise[450:], "éö" * 300, "x" * 199 + noise[300:620]]
    got = kept(spark, texts)
    assert [got[k] for k in range(len(texts))] == expected([t.encode() for t in texts])


@pytest.mark.parametrize("unit", ["a", "abcdefg"])
def test_four_megabytes(spark, unit):
    text = unit * (4_000_000 // len(unit))
    began = time.time()
    got = kept(spark, [text, "short", "unlike " * 40])
    assert time.time() - began < 60
    assert got[0] == b"" and got[1] == b"short"
    assert hashlib.sha256(got[2]).hexdigest() == hashlib.sha256(expected([("unlike " * 40).encode()])[0]).hexdigest()
