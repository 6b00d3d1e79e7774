"""Fill-in-middle: rotations, cuts, exact restoration, against slicing by code points."""

import hashlib

from hypothesis import given, settings, strategies as st

from threatloom.llm import infill


def by_slices(text, doc_id):
    """Output, form, and lengths, from str slices."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k: k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return text, n, "plain", None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", n, "spm", a, b - a
    return f"<P>{p}<S>{s}<M>{m}", n, "psm", a, b - a


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab<>PSM é😀́\n\0"), max_size=40), st.integers(-5, 5000))
def test_forms_and_restoration(text, doc_id):
    output, n, form, prefix, middle = infill.transform(text.encode(), doc_id)
    assert (output.decode(), n, form, prefix, middle) == by_slices(text, doc_id)
    assert infill.restore(bytes(output), form).decode() == text


@given(st.binary(max_size=60), st.data())
def test_rotation(data, draw):
    start = draw.draw(st.integers(0, len(data)))
    cut = draw.draw(st.integers(start, len(data)))
    end = draw.draw(st.integers(cut, len(data)))
    buffer = bytearray(data)
    infill.rotate(buffer, start, cut, end)
    assert buffer == data[:start] + data[cut:end] + data[start:cut] + data[end:]


def test_rows(spark, make_docs):
    long = "Wörter und 😀 mehr, " * 40_000
    rows = [(1, "plain words here"), (1, "plain words here"), (2, None), (3, ""), (4, "has <M> inside"), (5, long), (None, "no id"), (6, "é"), (7, "<P"), (8, "ends with <"), (9, "S> starts")]
    rows += [(k, f"document {k} with its text") for k in range(10, 80)]
    found = infill.restored(infill.infilled(make_docs(rows))).collect()
    got = sorted(((r.doc_id, r.text, r.output, r.n, r.form, r.prefix_chars, r.middle_chars) for r in found), key=str)
    assert got == sorted(((i, t or "", *by_slices(t or "", i)) for i, t in rows), key=str)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table(make_docs):
    assert infill.restored(infill.infilled(make_docs([]))).collect() == []
