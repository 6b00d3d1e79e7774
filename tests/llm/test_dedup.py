"""SimHash groups, components, line dedup and decontamination against brute force, and their edge cases."""

import random

import numpy as np
import pytest
import xxhash

from threatloom.llm import decontaminate, line_dedup, simhash
from threatloom.llm.components import connected_components


def prose(seed, n, vocabulary=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def slow_fingerprint(text, width=4):
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    ids = sorted(prints)
    above = {i: i for i in ids}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                above[y] = x
    return {i: root(i) for i in ids}


def test_simhash_against_brute_force(make_docs):
    base = prose(1, 300)
    texts = {10: " ".join(base), 11: " ".join(base), 12: "  ".join(base).upper(), 13: " ".join(base[:-1]), 14: None, 15: "", 16: " \t\n", 17: "one two", 18: "Größe ÄÖ ñ one",
             19: " ".join(prose(2, 50000)), 20: " ".join(prose(3, 40))}
    for k in range(40):
        changed = list(base)
        changed[k * 7 % 300] = f"edit{k}"
        texts[100 + k] = " ".join(changed)
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    expected = slow_components(prints)
    found = {r.doc_id: r for r in simhash.near_duplicates(make_docs(list(texts.items()))).collect()}
    assert {i: r.fp % 2 ** 64 for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == expected
    assert found[16].component_id == 14


def test_simhash_edges(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.keep_one(make_docs([])).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (7, None), (8, "")]
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(make_docs(rows)).collect()), key=str)
    assert found == sorted([(5, 5), (5, 5), (None, 5), (None, None), (7, 7), (8, 7)], key=str)
    kept = simhash.keep_one(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [5, 7, None, None]


def test_every_pair_at_four_bits_meets():
    draw = np.random.default_rng(3)
    prints = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
    for x in prints:
        y = x
        for bit in draw.choice(64, 4, replace=False):
            y ^= np.uint64(1) << np.uint64(bit)
        pair = np.array([[x, 0], [y, 0]], np.uint64)
        keys, owners = simhash.anchors_of(pair, simhash.EXACT_4_OF_64)
        homes = {(int(k) >> 1, int(o)) for k, o in zip(keys, owners) if not int(k) & 1}
        everywhere = {(int(k) >> 1, int(o)) for k, o in zip(keys, owners)}
        assert len(homes) == 2 * len(simhash.EXACT_4_OF_64.segments)
        assert any((anchor, 1 - owner) in everywhere for anchor, owner in homes)


def test_similar_layout_finds_similar_texts(make_docs):
    rows = []
    for k in range(30):
        words = prose(50 + k, 400)
        rows.append((2 * k, " ".join(words)))
        for e in range(0, 400, 60):  # about 0.85 of the five-word shingles stay
            words[e] = f"edit{e}"
        rows.append((2 * k + 1, " ".join(words)))
    kept = {r.doc_id for r in simhash.keep_one(make_docs(rows)).collect()}
    assert kept == {2 * k for k in range(30)}


def test_kept_documents_have_no_partner_at_the_similarity(make_docs):
    """Pairs on both sides of 0.8, some with few differing bits, and a family: groups follow the exact shingle sets."""
    texts, draw = {}, random.Random(4)
    for k in range(40):  # one changed run of e words in 200 costs e + 4 of 196 shingles
        words = prose(900 + k, 200)
        at, e = draw.randrange(20, 60), [6, 12, 26, 30, 40, 60][k % 6]
        texts[2 * k] = " ".join(words)
        texts[2 * k + 1] = " ".join(words[:at] + prose(1900 + k, e) + words[at + e:])
    for k in range(60):
        words = prose(77, 300)
        words[5 * k] = f"edit{k}"
        texts[200 + k] = " ".join(words)
    texts |= {400: "a b c d e f g", 401: "a b c d e f h", 402: "x y " * 300 + "q r s t u v", 403: "x y " * 300 + "m n o p k l"}

    def shingles(text):
        words = text.split()
        return {" ".join(words[i: i + 5]) for i in range(len(words) - 4)}

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(make_docs(list(texts.items()))).collect()}
    assert found == root


def test_components_of_stars_chains_and_loops(spark):
    edges = [(1, k) for k in range(2, 300)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000), (299, 2000), (2000, 1100)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(found[k] == 1 for k in [*range(1, 300), *range(1000, 1101), 2000])
    assert found[5000] == 5000 and len(found) == 299 + 101 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


LONG = "This very common line has more than forty characters"


def slow_lines(rows, least_docs=5):
    docs = {}
    for i, text in rows:
        docs.setdefault(i, []).append((text or "").split("\n"))
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, many in docs.items():
        for lines in many:
            for line in lines:
                if len(key(line)) >= 40:
                    holders.setdefault(key(line), set()).add(i)
    drop = {k: max(h) for k, h in holders.items() if len(h) >= least_docs}
    return sorted((i, "\n".join(x for x in lines if drop.get(key(x), i) == i), len(lines)) for i, many in docs.items() for lines in many)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup_against_brute_force(make_docs, batches):
    rows = [(i, f"{LONG}\nown line {i} is long enough to count as one, being over forty\n\t{LONG.upper()} ") for i in range(12)]
    rows += [(20 + i, f"short\nÄÖ {'ü' * 37}\nÄÖ {'ü' * 36}{'x' * (i % 2)}") for i in range(9)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, f"a\n{LONG}\n" * 3), (44, f"{LONG}\n" * 20000), (43, f"{LONG}"), (50, f"{'ä' * 40}\r"), (51, f"{'ä' * 40}")]
    found = sorted((r.doc_id, r.text, r.n_lines) for r in line_dedup.without_repeats(make_docs(rows), batches=batches).collect())
    assert found == slow_lines(rows)


def test_line_dedup_edges(make_docs):
    assert line_dedup.without_repeats(make_docs([])).count() == 0
    rows = [(None, LONG), (None, LONG), *((i, LONG) for i in range(4))]
    found = sorted(((r.doc_id, r.n_dropped) for r in line_dedup.without_repeats(make_docs(rows)).collect()), key=str)
    assert found == sorted([(None, 1), (None, 1), (0, 1), (1, 1), (2, 1), (3, 0)], key=str)
    out = line_dedup.without_repeats(make_docs(rows))
    assert set(out.columns) == {*make_docs(rows).columns, "n_lines", "n_dropped"}


def test_runs_are_compacted(spark, make_docs):
    runs = line_dedup.LineRuns(spark, "test_runs")
    for k in range(7):
        runs.absorb(line_dedup.line_hashes(make_docs([(k, f"{LONG}\n{LONG} number {k}")])))
    assert [len(level) for level in runs.levels] == [1, 2]
    totals = {(r.n_docs, r.last_doc) for r in runs.totals().collect()}
    assert (7, 6) in totals and len(totals) == 8


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination_against_brute_force(spark, make_docs):
    items = {k: " ".join(prose(200 + k, n, 900)) for k, n in enumerate([5, 6, 9, 15, 20, 40, 80, 300, 3, 0, 8, 8])}
    items[11] = items[10]
    rows = []
    for k, item in items.items():
        words = item.split()
        before, after = prose(400 + k, 700, 900), prose(500 + k, 2000, 900)
        rows.append((10 * k, " ".join(before + words + after)))
        rows.append((10 * k + 1, " ".join(before + words[: len(words) * 9 // 10] + after)))
        rows.append((10 * k + 2, " ".join(before + words[: len(words) // 2] + after)))
        rows.append((10 * k + 3, " \n".join(words).upper()))
    rows += [(900, None), (901, ""), (902, " ".join(prose(1, 60000, 900) + items[6].split())), (None, items[5]), (0, items[7])]

    def shingles(text):
        words = (text or "").lower().split()
        return {" ".join(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    expected = sorted(((i, k, len(s & shingles(t)), len(s)) for i, t in rows for k, s in ((k, shingles(x)) for k, x in items.items()) if s and len(s & shingles(t)) >= 0.8 * len(s)), key=str)
    bench = benchmark(spark, list(items.items()) + [(77, None)])
    found = decontaminate.contained_items(make_docs(rows), bench)
    assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()), key=str) == expected
    kept = decontaminate.drop_contaminated(make_docs(rows), bench)
    bad = {e[0] for e in expected}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in rows if i not in bad), key=str)


def test_short_items_in_long_documents():
    """A short item meets each document that holds it, at every place of its windows."""
    items = [(k, " ".join(prose(3000 + k, 5 + k % 8)).encode()) for k in range(400)]
    index, known = decontaminate.ItemIndex(items), decontaminate._WordHashes()
    docs = [" ".join(prose(5000 + k, 300 + k) + item.decode().split() + prose(7000 + k, 500)).encode() for k, item in items]
    found = index.candidates([decontaminate.shingle_codes(d.split(), known) for d in docs])
    assert [k for k in range(400) if (k, k) not in found] == []


def test_decontamination_in_blocks(spark, make_docs, monkeypatch):
    items = [(k, " ".join(prose(600 + k, 30))) for k in range(9)]
    docs = make_docs([(k, " ".join(prose(700 + k, 100)) + " " + text) for k, text in items])
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 60)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, benchmark(spark, items)).collect()} == {(k, k) for k in range(9)}


def test_decontamination_of_empty_tables(spark, make_docs):
    assert decontaminate.contained_items(make_docs([]), benchmark(spark, [(1, "a b c d e f")])).count() == 0
    assert decontaminate.contained_items(make_docs([(1, "a")]), benchmark(spark, [])).count() == 0
