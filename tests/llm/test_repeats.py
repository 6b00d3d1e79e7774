"""Repeated passages against a table of all windows; suffix arrays and intervals against counting."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from threatloom.llm import repeats


def key(doc_id):
    return (doc_id is None, doc_id or 0)


def by_windows(docs, least):
    """(doc_id, kept bytes, n_bytes, n_removed, n_spans) from the least document of every window."""
    first = {}
    for doc_id, text in docs:
        text = (text or "").encode()
        for p in range(len(text) - least + 1):
            s = text[p: p + least]
            first[s] = min(first.get(s, key(doc_id)), key(doc_id))
    out = []
    for doc_id, text in docs:
        text = (text or "").encode()
        gone = np.zeros(len(text) + 1, bool)
        for p in range(len(text) - least + 1):
            if first[text[p: p + least]] < key(doc_id):
                gone[p: p + least] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((doc_id, bytes(b for b, g in zip(text, gone) if not g), len(text), int(gone.sum()), spans))
    return out


def check(docs_frame, docs, least):
    found = repeats.without_repeats(docs_frame, least).collect()
    assert sorted(((r.doc_id, bytes(r.text), r.n_bytes, r.n_removed, r.n_spans) for r in found), key=str) == sorted(by_windows(docs, least), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(2, 5))
def test_intervals_are_the_maximal_repeats(bodies, least):
    body, place, common, left = repeats.suffix_array(bodies, least)
    suffixes = [bodies[b][p:] for b, p in zip(body.tolist(), place.tolist())]
    assert sorted(suffixes) == suffixes and len(suffixes) == sum(max(0, len(b) - least + 1) for b in bodies)
    for x, y, n in zip(suffixes, suffixes[1:], common.tolist()):
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])
    found = {}
    for length, first, last in repeats.maximal_repeats(common, left, least):
        members = list(zip(body[first: last + 1].tolist(), place[first: last + 1].tolist()))
        string = bodies[members[0][0]][members[0][1]: members[0][1] + length]
        assert string not in found
        found[string] = set(members)
    expected = {}
    for b, text in enumerate(bodies):
        for p in range(len(text)):
            for n in range(least, len(text) - p + 1):
                expected.setdefault(text[p: p + n], set()).add((b, p))

    def maximal(string, members):
        if len(members) < 2:
            return False
        after = {bodies[b][p + len(string): p + len(string) + 1] or (b, p) for b, p in members}
        before = {bodies[b][p - 1: p] if p else (b, p) for b, p in members}
        return len(after) > 1 and len(before) > 1

    assert found == {s: m for s, m in expected.items() if maximal(s, m)}


@pytest.mark.parametrize("sizes", [{}, {"CHUNK_BYTES": 300, "BUCKET_BYTES": 100, "SLOT_BYTES": 100, "SUFFIXES": 20, "BLOCK": 200}, {"CHUNK_BYTES": 500, "BUCKET_BYTES": 100, "HOT": 1, "STRETCH": 3, "BLOCK": 100}])
def test_small_alphabet(make_docs, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(repeats, name, value)
    rng = np.random.default_rng(7)
    common = ["".join(rng.choice(list("abc "), 40)) for _ in range(4)]
    docs = []
    for k in range(60):
        parts = ["".join(rng.choice(list("abcdé "), rng.integers(0, 30))), common[rng.integers(4)][rng.integers(5):], "".join(rng.choice(list("ab"), rng.integers(0, 20)))]
        docs.append((int(rng.integers(0, 45)), "".join(rng.permutation(parts))))
    docs += [(100, None), (101, ""), (102, "short"), (None, docs[3][1]), (None, common[0]), (3, "a" * 200), (2, "a" * 100), (103, "ab" * 150), (104, docs[5][1]), (104, docs[5][1]), (1, common[1] * 3)]
    check(make_docs(docs).repartition(3), docs, 8)


def test_whole_passages_and_edges(make_docs):
    rng = np.random.default_rng(1)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n))

    passage, other = prose(60), prose(2000)
    docs = [(5, prose(30) + passage + prose(10)), (2, passage), (9, prose(5) + passage[7:] + passage[:100]), (7, other), (8, other[:3000] + "x" + other[3001:]), (11, other), (12, other[:49]), (13, other[:50]),
            (1, other[100:149]), (14, passage[-50:] + other[:50]), (15, "\0" * 120), (16, "\0" * 60), (17, "é" * 50)]
    check(make_docs(docs).repartition(4), docs, 50)


def test_groups_hold_all_occurrences(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 150)
    docs = [(k, f"{chr(97 + k)}{k}unique head {k * k} THE SHARED PASSAGE {k * 7} tail {chr(110 + k)}") for k in range(8)]
    rows = repeats.repeat_groups(make_docs(docs).repartition(2), 12).collect()
    texts = dict(docs)
    groups = {}
    for r in rows:
        groups.setdefault((r.group_id, r.length), set()).add((r.doc_id, r.start))
    for (_, length), members in groups.items():
        assert len({texts[d][s: s + length] for d, s in members}) == 1
    whole = {frozenset(d for d, _ in m) for m in groups.values()}
    assert frozenset(range(8)) in whole


def test_empty_table(make_docs):
    assert repeats.without_repeats(make_docs([])).collect() == []
