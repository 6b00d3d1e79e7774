"""Packing: tokens against the tokenizer itself, whole and gapless sequences, little padding, edge cases."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

from threatloom.llm import packing

PATH = corpus_pipeline.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(texts, rows, tokenizer):
    """Rows cover the ids of ``texts`` (by doc_id, one row each) exactly, and sequences have no gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == len(ids) and {r.doc_tokens for r in own} == {len(ids)}
        assert all(zlib.crc32(ids[r.start: r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        total = sum(r.length for r in own)
        assert total <= packing.SEQUENCE
        padding += 0 if total & (total - 1) == 0 else packing.SEQUENCE - total
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding


ODD = [None, "", " \n\t", "Hello, World!", "ÄÖ straße ΣΟΦΟΣ ΣΟΦΟΣ. ΑΣ, İstanbul", "<|endoftext|> x<|startoftext|>.", "A <|ENDOFTEXT|> B", "ÀB́ ΑΣ ÉÀ Ab́C", "don't I'LL we've' 'tis it's.", "a b c été, x́.", "日本語テキスト、漢字。",
       "12 3.14 1,000 x1! ...?!", "\x1c\x1d\x85 a\x1cb\x85c", "ﬁn ǅ ª º ² ½ Ⅷ", "🙂🙂! a🙂, ‼ “quoted”,", "“a”. …, —;", "x" * 9000, "ab " * 30000]


def test_ids_and_layout(make_docs, tokenizer):
    draw = random.Random(1)
    pool = "abcXYZéßΣςİ'.,!?<|>-  \n\t́  五1²".replace("", " ").split(" ")
    texts = dict(enumerate(ODD)) | {100 + k: "".join(draw.choice(pool + [" "]) for _ in range(draw.randrange(300))) for k in range(300)}
    texts |= {1000 + k: " ".join(draw.choice(["alpha", "beta,", "Gamma."]) for _ in range(draw.randrange(1, 3000))) for k in range(150)}
    rows = packing.pack(make_docs(list(texts.items())), PATH).collect()
    padding = check(texts, rows, tokenizer)
    assert padding < 0.05 * sum(r.length for r in rows)


def test_edges(make_docs):
    assert packing.pack(make_docs([]), PATH).count() == 0
    rows = packing.pack(make_docs([(1, "a b"), (1, "a b"), (None, "a"), (2, None)]), PATH).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert {(r.doc_id, r.length) for r in rows} == {(1, 3), (None, 2), (2, 1)}


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_every_length(seed):
    draw = random.Random(seed)
    counts = {draw.randrange(1, 2049): draw.randrange(1, 10 ** draw.randrange(1, 6)) for _ in range(draw.randrange(1, 400))}
    patterns = packing.shortest_pack_first(counts)
    held = {}
    for pattern, n in patterns.items():
        assert sum(pattern) <= 2048 and n > 0
        for length in pattern:
            held[length] = held.get(length, 0) + n
    assert held == counts
    layout = packing.Layout(patterns)
    for length, n in list(counts.items())[:20]:
        ranks = np.arange(min(n, 5000))
        where = list(zip(*(x.tolist() for x in layout.place(np.full(len(ranks), length), ranks))))
        assert len(set(where)) == len(ranks)


def test_many_documents_of_one_length_are_dealt_over_buckets(make_docs, monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "BUCKET", 50)
    texts = {k: "the same few words" for k in range(1000)}
    check(texts, packing.pack(make_docs(list(texts.items())), PATH).collect(), tokenizer)


def test_other_tokenizers_get_whole_texts(make_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.splits_at_spaces(PATH) and not packing.splits_at_spaces(path)
    text = "two  spaces\n\nand lines"
    row = packing.pack(make_docs([(1, text)]), path).first()
    ids = np.array([*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1], "<u4")
    assert (row.length, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
