"""A task that proposes pairs hands them on as it goes, however many members an anchor has."""

from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from threatloom.llm import simhash


@pytest.mark.parametrize("most", [0, 4, 512])
def test_pairs_leave_in_batches_of_bounded_size(monkeypatch, most):
    made, n = [], 300
    monkeypatch.setattr(simhash, "map_arrow", lambda df, rows, schema: made.append(rows) or MagicMock())
    monkeypatch.setattr(simhash, "F", MagicMock())
    monkeypatch.setattr(simhash, "TILE", 32)
    simhash._proposals(MagicMock(), simhash.SIMILAR_08, most)
    draw = np.random.default_rng(1)
    bits = draw.integers(0, 2, 128).astype(bool) ^ (draw.random((n, 128)) < 0.05)
    prints = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    columns = [np.zeros(n, np.int64), prints[:, 0].copy(), prints[:, 1].copy(), np.arange(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "fp_high", "label"])
    found = {}
    for out in (1 << 30, 200):
        monkeypatch.setattr(simhash, "OUT", out, raising=False)
        found[out] = list(made[0](iter([batch])))
    rows = {out: [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))] for out, batches in found.items()}
    assert rows[200] == rows[1 << 30] and len(rows[200]) >= n - 1
    # A tile's pairs are handed on together.
    assert max(b.num_rows for b in found[200]) < 200 + 32 * 32
