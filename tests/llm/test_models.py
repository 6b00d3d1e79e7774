"""Language-model scores, language identification and the weak-label classifier: brute force, gradients, held-out accuracy, edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from threatloom.llm import langid, ppm, weak_quality

LANGS = {"aa": "ka ro ti men sul".split(), "bb": "zyx qui voe plo gra".split(), "cc": "öng äsch ütz ßer eik".split()}


def text_in(lang, seed, n=60):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(LANGS[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n)) + "."


def slow_ppm(training, text, order=ppm.ORDER):
    """log10 probability by method C with exclusion, from a dictionary of contexts."""
    table = {}
    for t in training:
        symbols = [ppm.START] * order + list(t) + [ppm.END]
        for i in range(order, len(symbols)):
            for k in range(order + 1):
                table.setdefault(tuple(symbols[i - k: i]), Counter())[symbols[i]] += 1
    symbols, total = [ppm.START] * order + list(text) + [ppm.END], 0.0
    for i in range(order, len(symbols)):
        refused = set()
        for k in range(order, -1, -1):
            seen = {s: n for s, n in table.get(tuple(symbols[i - k: i]), {}).items() if s not in refused}
            if not seen:
                continue
            bottom = sum(seen.values()) + len(seen)
            if symbols[i] in seen:
                total += math.log10(seen[symbols[i]] / bottom)
                break
            total += math.log10(len(seen) / bottom)
            refused |= set(seen)
        else:
            total -= math.log10(255 - len(refused))
    return total


def test_ppm_against_brute_force(make_docs):
    texts = {k: text_in(["aa", "bb", "cc"][k % 3], k, 30) for k in range(40)}
    texts |= {50: None, 51: "", 52: " \n", 53: "NEW Words here ñ", 54: "x" * 3000, 55: "aaa\x00b"}
    rows = {r.doc_id: r for r in ppm.scored(make_docs([*texts.items(), (1, texts[1]), (None, "learned too")])).collect() if r.doc_id is not None}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    training = [(t or "").encode() for k, t in texts.items() if not held[k]] + [b"learned too"] + ([] if held[1] else [texts[1].encode()])
    counts = Counter(w for t in training for w in [*t.lower().split(), b""])
    n, bottom = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    for k, text in texts.items():
        words = [*(text or "").encode().lower().split(), b""]
        row = rows[k]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[k], len(words), sum(counts[w] > 0 for w in words), n)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / bottom) for w in words), rel=1e-9)
        assert row.score == pytest.approx(slow_ppm(training, (text or "").encode()), rel=1e-4, abs=1e-4)


def test_ppm_is_a_distribution():
    grams = []
    keys, _ = ppm.gram_keys([b"abracadabra", b"abba", "é".encode()])
    for order in range(ppm.ORDER + 1):
        grams.append(np.unique(keys & ppm._mask(order), return_counts=True))
    trie = ppm.Trie([(k, n.astype(np.int64)) for k, n in grams])
    trie.__setstate__(trie.__getstate__())
    for context in (b"\xfe" * 5, b"abrac", b"xabra", b"zzzzz", b"\xfe\xfe\xfeab"):
        head = int.from_bytes(context, "big") << 8
        every = np.array([head | s for s in range(256) if s != ppm.START], np.uint64)
        assert np.exp(trie.log_probability(every)).sum() == pytest.approx(1, abs=1e-4)


def test_ppm_edges(make_docs, monkeypatch):
    assert ppm.scored(make_docs([])).count() == 0
    only = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = ppm.scored(make_docs([(only, "ab")])).first()
    assert (row.n_known, row.train_tokens) == (0, 0) and row.score == pytest.approx(-3 * math.log10(255))
    assert row.base_score == pytest.approx(2 * math.log10(0.5 / 0.5))
    # Words of the tail are met in the join: the same base whatever the head.
    docs = make_docs([(k, text_in("aa", k)) for k in range(10)])
    full = {r.doc_id: (r.base_score, r.n_known) for r in ppm.scored(docs).collect()}
    monkeypatch.setattr(ppm, "HEAD_WORDS", 3)
    for r in ppm.scored(docs).collect():
        assert r.base_score == pytest.approx(full[r.doc_id][0], rel=1e-9) and r.n_known == full[r.doc_id][1]


def test_ppm_uses_the_whole_trie(make_docs, monkeypatch):
    """However few values are broadcast, the scores are those of all counts."""
    monkeypatch.setattr(ppm, "TRIE_ENTRIES", 20, raising=False)
    monkeypatch.setattr(ppm, "HEAD_GRAMS", 20, raising=False)
    texts = {k: text_in(["aa", "cc"][k % 2], k, 12) for k in range(12)} | {50: None, 51: "Ñ never seen", 52: "q" * 300}
    training = [(t or "").encode() for k, t in texts.items() if zlib.crc32(str(k).encode()) % 5 != 1]
    for row in ppm.scored(make_docs(list(texts.items()))).collect():
        assert row.score == pytest.approx(slow_ppm(training, (texts[row.doc_id] or "").encode()), rel=1e-6)


def test_gradients():
    model = langid.ByteTagger(["a", "b", "c"])
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rows, lengths, _ = langid.sequences([b"hello", b"x", b"thing"])
    labels = np.array([0, 1, 2])
    loss, gradients = model.gradients(rows, lengths, labels)
    for name, weights in model.w.items():
        flat, found = weights.reshape(-1), gradients[name].reshape(-1)
        for k in np.argsort(-np.abs(found))[:3]:
            kept = flat[k]
            flat[k] = kept + 1e-4
            up = model.gradients(rows, lengths, labels)[0]
            flat[k] = kept - 1e-4
            down = model.gradients(rows, lengths, labels)[0]
            flat[k] = kept
            assert found[k] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=2e-5)


def test_language_of_held_out_documents(make_docs, monkeypatch):
    monkeypatch.setattr(langid, "ROUNDS", 150)
    rows = [(k, text_in(lang := ["aa", "bb", "cc"][k % 3], k), lang) for k in range(150)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "aa"), (903, text_in("bb", 5), None), (904, "x" * 5000, "bb"), (905, text_in("cc", 1, 20000), "aa"), (None, text_in("aa", 7), "aa")]
    found = {r.doc_id: r for r in langid.identified(make_docs(rows + odd)).collect()}
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k in found if k is not None and found[k].held_out} >= set(held)
    assert np.mean([found[k].lang_pred == rows[k][2] for k in held]) >= 0.95
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (900, 901, 902))
    assert found[903].lang_pred == "bb" and found[905].lang_pred == "cc" and found[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.identified(make_docs([])).count() == 0
    assert langid.identified(make_docs([(1, "text", None)])).first().lang_pred == "und"


def test_label_model_recovers_accuracies():
    draw = np.random.default_rng(4)
    truth = draw.random(20000) < 0.8
    patterns = np.zeros(20000, np.int64)
    for k in range(len(weak_quality.LABELLERS)):
        vote = np.where(truth, np.where(draw.random(20000) < 0.005, 1, 2), np.where(draw.random(20000) < 0.5, 1, 2))
        patterns += 3 ** k * np.where(draw.random(20000) < 0.1, 0, vote)
    values, counts = np.unique(patterns, return_counts=True)
    model = weak_quality.expectation_maximisation(values, counts.astype(float))
    assert model.share_high == pytest.approx(0.8, abs=0.02)
    belief = dict(zip(values.tolist(), model.posterior(values)))
    assert np.mean([(belief[p] >= 0.5) == t for p, t in zip(patterns.tolist(), truth)]) > 0.97
    assert all(0.85 < a < 0.95 for a in model.accuracies().values())


def test_junk_is_scored_low_and_clean_text_high(make_docs):
    clean = [(k, ". ".join(text_in(["aa", "bb", "cc"][k % 3], f"{k}-{s}", 12).capitalize().rstrip(".") for s in range(12)) + ".") for k in range(160)]
    junk = [(1000 + k, " ".join(w + "###%%%" for w in text_in("aa", f"j{k}", 150).split())) for k in range(40)]
    odd = [(2000, None), (2001, ""), (2002, "one"), (None, clean[0][1])]
    found = {r.doc_id: r for r in weak_quality.scored(make_docs(clean + junk + odd)).collect()}
    assert np.mean([found[k].keep for k, _ in clean]) == 1 and np.mean([found[k].keep for k, _ in junk]) == 0
    assert found[2000].score == found[2001].score and 0 < found[2000].score < 1 and found[None].keep
    assert weak_quality.scored(make_docs([])).count() == 0
