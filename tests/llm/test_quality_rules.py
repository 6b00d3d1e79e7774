"""Quality rules: statistics against brute force, the robust estimate against numpy, outliers, edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from threatloom.llm import quality_rules as rules


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    counts = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if counts[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def prose(seed, n=120):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(n)]
    return ". ".join(" ".join(words[i: i + 12]).capitalize() for i in range(0, n, 12)) + "."


def test_statistics_and_verdicts(make_docs):
    rows = [(k, prose(k), "en", f"s{k % 2}") for k in range(500)]
    rows += [(1000 + k, " ".join(w + "##%" for w in prose(k).split()), "en", "s0") for k in range(20)]
    rows += [(2000, None), (2001, ""), (2002, " \t\x0b"), (2003, "a b a b a b a b " * 30), (2004, "one\n\none\none \n two"), (2005, "x y z\x85w v" * 30), (2006, prose(3, 30000), None, None),
             (2007, "\n".join(["line of words"] * 40 + ["end"])), (2008, "🙂ü " * 60), (5, prose(5), "en", "s1"), (None, prose(9), None, "s0")]
    found = rules.judged(make_docs(rows)).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1])
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_statistics(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in found if r.kept}
    assert set(range(500)) <= kept and not kept & set(range(1000, 1020)) and {2006, None} <= kept
    left = rules.keep_good(make_docs(rows))
    assert {r.doc_id for r in left.collect()} == kept and left.columns == make_docs(rows).columns


def test_texts_without_words_beside_a_fitted_group(make_docs):
    """A group with an estimate also holds texts without words: nothing is divided by their length."""
    found = {r.doc_id: r for r in rules.judged(make_docs([(k, prose(k), "en", "s0") for k in range(300)] + [
        (1000, "", "en", "s0"), (1001, None, "en", "s0"), (1002, " \n\t", "en", "s0"), (1003, "word", "en", "s0")])).collect()}
    assert len(found) == 304 and all(found[k].kept and found[k].d2 is not None for k in range(300))
    assert all(found[k].grp == found[0].grp and found[k].base_failed and not found[k].kept for k in range(1000, 1004))
    assert [found[k].d2 is None for k in range(1000, 1004)] == [True, True, True, False]


def test_estimate_ignores_a_minority(spark):
    draw = np.random.default_rng(1)
    axes = list(rules.AXES)
    spread = np.array([2.0, 1.0, 1.5, 0.8, 1.2, 1.0])
    good = draw.standard_normal((3000, 6)) * spread
    good[:, 1] += 0.6 * good[:, 0]
    bad = draw.standard_normal((500, 6)) * 0.3 + 25
    rows = spark.createDataFrame([("g", *map(float, r)) for r in np.vstack([good, bad])], "grp string, " + ", ".join(f"{a} double" for a in axes))
    r = rules.fit(rows).first()
    centre = np.array([r[f"m{i}"] for i in range(6)])
    root = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(6)] for i in range(6)])
    wanted = np.cov(good.T) + np.diag(np.array(list(rules.AXES.values())) ** 2)
    assert np.abs(centre - good.mean(axis=0)).max() < 0.2
    assert np.abs(root @ root.T - wanted).max() < 0.15 * wanted.max()


def test_edges(make_docs):
    assert rules.judged(make_docs([])).count() == 0
    assert rules.keep_good(make_docs([])).count() == 0
    few = rules.judged(make_docs([(k, prose(k)) for k in range(5)])).collect()
    assert all(r.kept and r.d2 is None for r in few)


@pytest.mark.parametrize("x, degrees, p", [(5.385, 4, 0.75), (5.348, 6, 0.5), (12.592, 6, 0.95)])
def test_chi_square(x, degrees, p):
    assert rules.chi_square_cdf(x, degrees) == pytest.approx(p, abs=1e-3)
    assert rules.chi_square_tail_point(1 - p, degrees) == pytest.approx(x, abs=1e-2)
