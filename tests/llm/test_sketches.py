"""Close fingerprints of texts that are not similar enough cost no check of their texts."""

import random

import numpy as np

from threatloom.llm import simhash


def shingles(text):
    words = text.split()
    return {tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def family(n):
    """Texts some 0.6 alike, each fifth with a copy that differs in one word."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(5000)}" for _ in range(130)]
    texts = []
    for k in range(n):
        words = list(base)
        for at in draw.sample(range(10, 120), 3):
            words[at] = f"x{k}at{at}"
        texts.append(" ".join(words))
        if k % 5 == 0:
            texts.append(" ".join([*words[:60], f"y{k}", *words[61:]]))
    return texts


def test_a_family_below_the_similarity_is_not_checked_pair_by_pair(spark, monkeypatch):
    texts, seen, plain = family(60), [], simhash.written

    def counted(df, name):
        frame = plain(df, name)
        if name == "pairs":
            seen.append(frame.count())
        return frame

    monkeypatch.setattr(simhash, "written", counted)
    found = dict(map(tuple, simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    sets = list(map(shingles, texts))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= simhash.SIMILARITY:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert found == dict(enumerate(root))
    assert len(set(root)) == 60
    assert sum(seen) < 2 * len(texts)


def test_sketches_never_part_sets_that_reach_the_similarity():
    draw = np.random.default_rng(5)
    parted = 0
    for n in (0, 1, 2, 9, 130, 1500):
        for share in (0.3, 0.75, 0.8, 0.81, 0.9, 1.0):
            same = draw.integers(-1 << 63, 1 << 63, int(n * share))
            x, y = (np.unique(np.r_[same, draw.integers(-1 << 63, 1 << 63, int(round((n - len(same)) * w)))]) for w in (1, 0.5))
            rows = [np.r_[len(s), simhash.parity_sketch(s)].view(np.uint64)[None, :] for s in (x, y)]
            apart = simhash._surely_apart(*rows, np.array([0]), np.array([0]), 0.8)[0]
            shared, total = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            assert not (apart and shared >= 0.8 * total)
            parted += apart
    assert parted
