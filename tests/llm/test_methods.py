"""The methods' own parts against brute force and exact round trips."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailweave.llm import exact_dedup, language_id, license_scan, mixing, near_dedup, packing, quality_model, secret_scan, substring_dedup
from mailweave.llm.common import encoded


@given(st.lists(st.integers(0, 2**58 - 1), max_size=300), st.lists(st.integers(0, 2**58 - 1), max_size=300))
@settings(max_examples=50, deadline=None)
def test_filters_merge_without_loss(a, b):
    def build(x):
        v, c = np.unique(np.array(x, np.uint64), return_counts=True)
        return exact_dedup.build_filter(v, c, 58)

    for x in (a, b):
        v, c = exact_dedup.read_filter(build(x))
        assert dict(zip(v.tolist(), c.tolist())) == {k: x.count(k) for k in set(x)}
    v, c = exact_dedup.merge_filters([build(a), build(b)])
    both = a + b
    assert dict(zip(v.tolist(), c.tolist())) == {k: both.count(k) for k in set(both)} and (np.diff(v.astype(object)) > 0).all()


@given(st.lists(st.integers(1, 3), max_size=60), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_suffix_array(text, repeat):
    t = text * (1 + repeat) + [0]
    assert substring_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("shard", [3, 4000])
def test_repeated_strings_against_brute_force(spark, shard):
    """Also with cores that many shards share."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    passage = " ".join(word() for _ in range(80))
    texts = []
    for i in range(60):
        t = " ".join(word() for _ in range(r.randint(0, 60)))
        if i % 2:
            a = r.randint(0, 100)
            cut = passage[a : a + r.randint(150, len(passage))]
            t += cut[: r.randint(100, 250)] + word() + cut if i % 4 == 1 else cut + t
        texts.append((i, t if i % 10 else texts[i - 1][1] if i else ""))
    got = {x["doc_id"]: x for x in substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), shard).collect()}
    seen: dict = {}
    for _, t in texts:
        b = t.encode()
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    for i, t in texts:
        b = t.encode()
        gone = {p for k in range(len(b) - 199) if seen[b[k : k + 200]] > 1 for p in range(k, k + 200)}
        assert got[i]["kept"] == bytes(x for p, x in enumerate(b) if p not in gone), i


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(0, 1000, 500)
    p = np.full(500, 0.3)
    out = mixing.fly(size, p, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(150) and (out * size).sum() == pytest.approx((p * size).sum())
    assert set(mixing.land(size, out).tolist()) <= {0.0, 1.0}


def hard_lengths(name, n, seed):
    """Lengths of which best fit by decreasing length leaves a gap: nothing small fills what is left over."""
    r = np.random.default_rng(seed)
    if name == "triplets":
        a = r.integers(780, 1004, n // 3)
        b = np.array([r.integers(512, (2048 - x) // 2 + 1) for x in a])
        return np.concatenate([a, b, 2048 - a - b])
    return r.integers(*{"middling": (400, 1000), "wide": (300, 1400)}[name], n)


@pytest.mark.parametrize("name", ["triplets", "middling", "wide"])
def test_search_saves_bins(name):
    """On every shard with a gap the search needs fewer sequences than best fit by decreasing length, by at least half of the gap."""
    improved = 0
    for seed in range(3):
        length = hard_lengths(name, 1200, seed)
        least, plain = packing.lower_bound(length, 2048), packing.by_decreasing_length(length, 2048).max() + 1
        assert plain >= least + 5
        first = [packing.evolve(length, [], 2048, [0, seed, i]) for i in range(2)]
        best = min((packing.evolve(length, [first[i], first[1 - i]], 2048, [1, seed, i]) for i in range(2)), key=lambda x: packing.fitness(x, length))
        assert np.bincount(best, length).max() <= 2048 and len(best) == len(length) and (best >= 0).all()
        improved += 2 * (best.max() + 1 - least) <= plain - least
    assert improved == 3


def test_search_ends_at_the_bound():
    """Where best fit by decreasing length meets the lower bound nothing is left to search."""
    length = np.random.default_rng(5).integers(1, 400, 900)
    plain = packing.by_decreasing_length(length, 2048)
    assert packing.lower_bound(length, 2048) == plain.max() + 1
    assert (packing.evolve(length, [], 2048, [1]) == plain).all()
    for some in ([2047] * 5, [1024] * 4 + [1025] * 3, [1500, 600, 600, 600], [1]):
        bound = packing.lower_bound(np.array(some), 2048)
        assert bound == packing.evolve(np.array(some), [], 2048, [1]).max() + 1


def test_fullest_and_crossover():
    r = np.random.default_rng(6)
    for _ in range(40):
        sizes = sorted(r.integers(1, 60, 9).tolist())
        room = int(r.integers(0, 150))
        taken = packing.fullest(sizes, room)
        sums = {sum(sizes[k] for k in range(9) if m >> k & 1) for m in range(512)}
        assert len(set(taken)) == len(taken) and sum(sizes[k] for k in taken) == max(x for x in sums if x <= room)
    length = hard_lengths("middling", 700, 1)
    a, b = packing.by_decreasing_length(length, 2048), packing.evolve(length, [], 2048, [3])
    child = packing.crossover(a, b, length, 2048, r)
    assert np.bincount(child, length).max() <= 2048 and (child >= 0).all() and len(child) == 700


def test_word_tokenizer_equals_tokenizer():
    coder = packing.WordTokenizer(packing.default_tokenizer())
    texts = ["It's Élan x y İstanbul áb 12 3.4 \x1c z 中文  ab <|x|> ΣΑΣ'S", "", " ", "word, word! (word)", "a\x0bb\x0cc"]
    for t, ids in zip(texts, coder.batch(encoded(texts)), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids + [0]


def test_language_held_out_accuracy():
    en, fr = "the of and that with for be this have from", "le la et que les des dans pour est une"
    r = random.Random(3)
    make = lambda w: " ".join(r.choice(w.split()) for _ in range(12)).encode()
    texts = [make(en if i % 2 else fr) for i in range(200)]
    model = language_id.train([language_id.subword_counts(t) for t in texts], ["en" if i % 2 else "fr" for i in range(200)])
    best, score, rejected = model.predict([make(en if i % 2 else fr) for i in range(100)])
    assert not rejected.any()  # of two languages none can be left out
    assert np.mean([model.languages[b] == ("en" if i % 2 else "fr") for i, b in enumerate(best)]) > 0.95
    assert (score <= 1).all() and (score >= 0.5).all()


def test_language_that_was_never_learned_is_rejected():
    """Known texts stay, short ones and such in two languages too; texts of a language that training didn't see go."""
    r = random.Random(5)
    sounds = {"aa": "ka lo mi tu re", "bb": "sche ung ver tz ö", "cc": "eau oi que è ç", "dd": "ción ado llo ñ ez", "ee": "szcz owa ł prz ie"}
    words = {k: ["".join(r.choice(v.split()) for _ in range(r.randint(1, 4))) for _ in range(400)] for k, v in sounds.items()}
    make = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n)).encode()
    learned = ["aa", "bb", "cc", "dd"]
    rows = [(make(k, r.choice([3, 10, 40, 200])), k) for _ in range(100) for k in learned]
    model = language_id.train([language_id.subword_counts(t) for t, _ in rows], [k for _, k in rows])
    known = [make(k, n) for k in learned for n in (1, 5, 60, 300) for _ in range(20)]
    mixed = [make("aa", 150) + b" " + make("cc", 150) for _ in range(20)]
    assert not model.predict(known)[2].any() and not model.predict(mixed)[2].any()
    foreign = [make("ee", n) for n in (60, 300) for _ in range(50)]
    assert model.predict(foreign)[2].mean() > 0.9


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (0.5, 0.85, 1.0):
        k = int(400 * share)
        errors = []
        for s in range(20):
            other = np.concatenate([base[:k], rng.integers(0, 2**63, 400 - k).astype(np.uint64)])
            regs = near_dedup.sketch([base, other])
            want = k / (800 - k)
            got = near_dedup.likely_similarity(regs[:1], regs[1:], np.array([400.0]), np.array([400.0]))[0]
            errors.append(got - want)
            base = rng.permutation(rng.integers(0, 2**63, 400).astype(np.uint64)) if s % 5 == 4 else base
        assert abs(np.mean(errors)) < 0.05


def test_sketches_merge():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (100, 300))
    ra, rb, both = near_dedup.sketch([a, b, np.concatenate([a, b])])
    assert (np.maximum(ra, rb) == both).all()


def test_links_against_brute_force():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**40, 60).astype(np.uint64)
    sets = []
    for _ in range(80):
        keep = base[rng.random(60) > rng.uniform(0, 0.2)]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**40, rng.integers(0, 6)).astype(np.uint64)])))
    whole = near_dedup.Union(80)
    for i in range(80):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                whole.join(i, j)
    found = near_dedup.Union(80)
    for i, j in near_dedup.linked(sets):
        found.join(i, j)
    assert [whole.root(i) for i in range(80)] == [found.root(i) for i in range(80)]


def test_wide_clusters_are_linked_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 6)
    r = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(150)] = f"x{r.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in texts]
    up = near_dedup.Union(60)
    for i in range(60):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 85 * len(sets[i] | sets[j]):
                up.join(i, j)
    assert got == {i: up.root(i) for i in range(60)}


def test_viterbi_cut_is_exact():
    rng = np.random.default_rng(8)
    field = secret_scan.Field(np.zeros((4, 3), np.float32), rng.normal(size=(3, 3)))
    for _ in range(30):
        score = rng.normal(size=(40, 3)) * 4
        score[:, 0] += rng.choice([0, 30], 40)
        upto = np.array([0, 13, 13, 40])
        want = np.concatenate([field.viterbi(score[a:b]) for a, b in ((0, 13), (13, 40))])
        assert (field.decode(score, upto) == want).all()


def test_patience_alignment():
    assert license_scan.longest_increasing([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5]
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    text = "Some words here. Licensed under the very Apache License, Version 2.0. More words."
    (hit,) = scanner.scan(text)
    assert hit[0] == "apache-2.0" and text[hit[2] : hit[3]].startswith("Licensed") and hit[1] == 1.0
    assert not scanner.scan("The license of the apache version.")


def test_kneser_ney_sums_to_one(spark):
    texts = [("the cat sat on the mat.",), ("a cat sat on a hat!",), ("the hat sat.",)]
    model = quality_model.KneserNey(spark.createDataFrame(texts, "text string"))
    codes = np.arange(1 << quality_model.BITS, dtype=np.int64)
    grams, _ = quality_model.ngrams(["the ca"])
    context = int(grams[-1]) >> quality_model.BITS
    all_next = spark.createDataFrame([((context << quality_model.BITS) | int(c),) for c in codes], "gram long")
    total = sum(r["p"] for r in model.probabilities(all_next).collect())
    assert total == pytest.approx(1, abs=1e-3)


@given(st.binary(max_size=400))
@settings(max_examples=50, deadline=None)
def test_packed_subword_counts(text):
    counts = language_id.subword_counts(text)
    again = language_id.unpacked_counts(language_id.packed_counts(counts))
    assert all((a == b).all() for a, b in zip(counts, again, strict=True))
