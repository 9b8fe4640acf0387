"""What the stages of the pipeline keep, against brute force."""

import random

from mailweave.llm import near_dedup

SCHEMA = "doc_id long, text string"


def test_near_stage_links_five_words_at_080(spark):
    r = random.Random(11)
    texts = []
    for k in range(12):
        base = [f"b{k}w{i}" for i in range(204)]
        block = [f"b{k}x{i}" for i in range(r.choice([43, 45, 47, 55]))]
        at = r.randrange(204)
        texts += [base, base + block, base[:at] + block + base[at:], base[: r.choice([165, 168, 172])]]
    sets = [frozenset(zip(*(t[i:] for i in range(5)))) for t in texts]
    up = near_dedup.Union(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * len(sets[i] | sets[j]):
                up.join(i, j)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = {x["doc_id"] for x in near_dedup.keep_one_of_near(docs).collect()}
    assert kept == {i for i in range(len(texts)) if up.root(i) == i}
    assert len(kept) < len({x["component_id"] for x in near_dedup.near_components(docs).collect()})
