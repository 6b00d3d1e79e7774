"""Ranked lexical search against scoring every document, ties and limits of accumulators included."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from threatloom.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_scan(docs, items, top):
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(terms(text))
    out = []
    for item_id, own in wanted.items():
        scored = []
        for doc_id, tf in counts:
            m = 50 + 50 * sum(tf.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if tf[t])
            if score > 0:
                scored.append((score, doc_id))
        scored.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item_id, k + 1, doc_id, score) for k, (score, doc_id) in enumerate(scored[:top])]
    return out


def items_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, doc_id string, score long")


@given(st.binary(max_size=50))
def test_terms(data):
    text = data.decode("latin-1")
    assert [t.decode() for t in ranked.terms_of(text.encode())] == terms(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 5), st.integers(0, 60))
def test_search_is_exact_under_the_limit(seed, top, floor):
    rng = np.random.default_rng(seed)
    size, n_terms = int(rng.integers(1, 60)), int(rng.integers(1, 9))
    table = np.where(rng.random((n_terms, size)) < rng.random((n_terms, 1)), rng.integers(0, 1 + rng.integers(1, 40, (n_terms, 1)), (n_terms, size)), 0) * (1 + 3 * (np.arange(n_terms) == 0))[:, None]
    docs = [np.flatnonzero(rng.random(size) < 0.6) for _ in range(n_terms)]
    starts = np.cumsum([0, *map(len, docs)])
    gains = np.concatenate([table[t, d] for t, d in enumerate(docs)])
    most = np.array([table[t, d].max(initial=0) for t, d in enumerate(docs)])
    order = np.argsort(-most, kind="stable")
    found, scores = ranked.search(order, starts, np.concatenate(docs), gains, most, size, floor, top)
    full = np.zeros(size, np.int64)
    for t, d in enumerate(docs):
        full[d] += table[t, d]
    assert (full[found] == scores).all() and len(set(found.tolist())) == len(found)
    kth = max(floor, 1, np.sort(full)[::-1][min(top, size) - 1] if size >= top else 0)
    assert set(np.flatnonzero(full >= kth).tolist()) <= set(found.tolist())


def test_accumulators_are_limited():
    """Rare heavy term first: documents that only hold the common one get no accumulator."""
    docs = np.r_[np.arange(3), np.arange(1000)]
    gains = np.r_[np.full(3, 100), np.full(1000, 5)]
    found, scores = ranked.search(np.array([0, 1]), np.array([0, 3, 1003]), docs, gains, np.array([100, 5]), 1000, 1, top=2)
    assert found.tolist() == [0, 1, 2] and scores.tolist() == [105] * 3


@pytest.mark.parametrize("postings, block", [(2_000_000, 200_000), (30, 5)])
def test_ranks(spark, make_docs, monkeypatch, postings, block):
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranked, "COUNTED_TERMS", postings)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(40)] + ["Über", "naïve", "x9"]
    docs = [(k, " ".join(rng.choice(vocabulary, rng.integers(1, 30)))) for k in range(200)]
    docs += [(k, docs[k - 300][1].upper()) for k in range(300, 330)] + [(5, docs[5][1]), (None, docs[7][1]), (None, "w1"), (400, None), (401, ""), (402, "?!-"), (403, "w1 " * 50_000)]
    items = [(1, "w1 w2, w3"), (2, "ÜBER w5 w5"), (3, None), (4, "?"), (5, "absent"), (1, "W4"), (None, "w6 w7"), (6, " ".join(vocabulary)), (7, "w1")]
    found = ranked.ranked(make_docs(docs), items_frame(spark, items), top=7).collect()
    assert sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in found], key=str) == sorted(by_scan(docs, items, 7), key=str)


def test_empty_tables(spark, make_docs):
    items = items_frame(spark, [(1, "w1")])
    assert ranked.ranked(make_docs([]), items).collect() == []
    assert ranked.ranked(make_docs([(1, "w1")]), items_frame(spark, [])).collect() == []
