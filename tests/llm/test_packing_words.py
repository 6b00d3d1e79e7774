"""Words are taken apart at their last letter by the same rule, however it is worked out."""

import sys
import unicodedata

import pytest

pytest.importorskip("tokenizers")
from threatloom.llm.packing import _ends_in_letter  # noqa: E402


def test_last_letters():
    for point in range(sys.maxunicode + 1):
        if 0xD800 <= point < 0xE000:
            continue
        word = "x1" + chr(point)
        assert _ends_in_letter(word.encode()) == unicodedata.normalize("NFC", word[-1:]).lower()[-1:].isalpha(), hex(point)
    for start, letter in ((b"", False), (b"a", True), (b"7", False), (b"a\xc3", False), (b"\xff", False)):
        assert _ends_in_letter(start) is letter
