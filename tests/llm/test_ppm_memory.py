"""What a task of the language model holds and hands on at once does not grow with its batch of documents."""

from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa

from threatloom.llm import ppm


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(range(len(texts)), pa.int64())], ["text", "doc_id"])


def test_pieces_keep_every_row_in_bounds(monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK", 10)
    monkeypatch.setattr(ppm, "DOCS", 3)
    texts = [b"abcd", None, b"", b"efgh", b"x" * 50, b"", b"yy", b"zzzzzzzzz", b"q", None, None, None, None]
    found = [p.column(0).to_pylist() for p in ppm.pieces(iter([batch(texts), batch([]), batch([b"w" * 30])]))]
    assert sum(found, []) == texts + [b"w" * 30]
    assert all(0 < len(p) <= 3 and (len(p) == 1 or sum(len(t or b"") for t in p) <= 10) for p in found)


def test_counts_leave_a_task_in_small_batches(monkeypatch):
    """The gram counts of a large batch are those of its documents one by one, and no batch of them is large."""
    made = []
    monkeypatch.setattr(ppm, "map_arrow", lambda df, rows, schema: made.append(rows) or MagicMock())
    monkeypatch.setattr(ppm, "text_bytes", lambda: None)
    monkeypatch.setattr(ppm, "F", MagicMock())
    ppm.gather(MagicMock())
    monkeypatch.setattr(ppm, "CHUNK", 500)
    monkeypatch.setattr(ppm, "OUT", 64)
    draw = np.random.default_rng(3)
    texts = [bytes(draw.integers(97, 123, int(n), dtype=np.uint8)) for n in draw.integers(0, 90, 200)] + [None, b""]
    grams, most = Counter(), 0
    for out in made[0](iter([batch(texts)])):
        rows = [(g, n) for g, n in zip(out.column(1).to_pylist(), out.column(2).to_pylist()) if g is not None]
        most = max(most, len(rows))
        for g, n in rows:
            grams[g] += n
    assert grams == Counter(k for t in texts for k in ppm.gram_keys([t or b""])[0].view(np.int64).tolist())
    assert most == 64
