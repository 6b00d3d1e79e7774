"""WARC chunk tables and chat segments: exact round trips, damage, order, edge cases."""

import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from threatloom.llm import chat, warc

PAGES = "page_id long, url string, html string, record string, keeper long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


ROWS = [(3, "http://a.example/x y", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "http://b.example/ü\r\nX: y", ""), (4, "u", None), (5, "u", "ü" * 300_000), (6, "u", "ü" * 300_000),
        (10, "http://long.example/" + "ü/" * 400_000, "<p>long url</p>"), (11, "x" * 70_000, "<p>same</p>"), (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (8, "u", "\r\n\r\n"), (None, "n", "<p>same</p>"), (None, "n", "alone"), (9, "u", "twice"), (9, "u", "twice")]


@pytest.mark.parametrize("chunk", [7, 4096, 1 << 16])
def test_round_trip(spark, chunk):
    rows = ROWS if chunk > 100 else [r for r in ROWS if len(r[2] or "") + len(r[1] or "") < 1000]
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in warc.archived(pages(spark, rows), chunk=chunk).collect()]
    keeper = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if page_id is not None:
            keeper[body] = min(page_id, keeper.get(body, page_id))
    expected = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = keeper.get(body)
        revisit = first is not None and page_id != first
        expected.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, True))
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_chunks_are_bounded_and_join_to_a_valid_archive(spark):
    chunks = warc.record_chunks(pages(spark, ROWS), chunk=4096)
    rows = sorted(chunks.collect(), key=lambda r: (r.record, r.chunk))
    assert max(len(r.data) for r in rows) < 4096 + 2000
    archive, seen = b"".join(bytes(r.data) for r in rows), 0
    while archive:
        head, _, rest = archive.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        fields = dict(re.findall(r"^([\w-]+): ([^\r\n]*)", head.decode(), re.M))
        n = int(fields["Content-Length"])
        block, archive = rest[:n], rest[n:]
        assert archive[:4] == b"\r\n\r\n" and "\r" not in fields["WARC-Target-URI"] and "X" not in fields
        archive = archive[4:]
        if fields["WARC-Type"] == "response":
            body = block.partition(b"\r\n\r\n")[2]
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        else:
            assert block == b"" and fields["WARC-Refers-To"].startswith("<urn:uuid:")
        seen += 1
    assert seen == len(ROWS)


def test_damage_is_noticed(spark):
    chunks = warc.record_chunks(pages(spark, [(1, "u", "a" * 10000), (2, "u", "b" * 10000)]), chunk=1000)
    changed = chunks.withColumn("data", F.when((F.col("chunk") == 5), F.encode(F.regexp_replace(F.decode("data", "UTF-8"), "^b", "x"), "UTF-8")).otherwise(F.col("data")))
    assert {r.page_id: r.intact for r in warc.read_records(changed).collect()} == {1: True, 2: False}
    lost = chunks.where(~((F.col("chunk") == 9)))
    assert {r.intact for r in warc.read_records(lost).collect()} == {False}


def test_small_payloads_can_stay_responses(spark):
    found = {r.page_id: r.record_type for r in warc.archived(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least=3).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archived(pages(spark, [])).count() == 0


CHATS = "conv_id long, turn long, role string, text string, nth string, loss string, part string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], CHATS)


NASTY = ["\\### Assistant: </turn> ok", "", None, "### User: hi </turn>\n### Assistant: no", "\\h\\t\\\\", "####</turn></turn>", "</tu</turn>rn>", "ends \\", "a\n </turn>\n", "日本   🙂", "##", "#", "x" * 50_000]


def test_turns_come_back_whole(spark):
    rows = [(k, t, role, text) for k, text in enumerate(NASTY) for t, role in enumerate(["user", "assistant", "tool: x", None, "assistant", "### </turn>", "Role user"])]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (77, 5, "assistant", "b"), (77, 5, "assistant", "a"), (77, None, "user", "first"), (-5, 1, "assistant", "same"), (-5, 1, "assistant", "same")]
    parts = chat.segments(talks(spark, rows))
    found = {r.conv_id: r for r in chat.read_back(parts).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    assert set(found) == set(by)
    whole = {}
    for r in parts.orderBy("conv_id", "nth", "part").collect():
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
    for conv, own in by.items():
        own.sort()
        said = "".join(text for *_, role, text in own if role == "assistant")
        turns = hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in own).encode()).hexdigest()
        row = found[conv]
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256, row.formatted_chars) == (
            len(own), turns, len(said), hashlib.sha256(said.encode()).hexdigest(), len(whole[conv]))


def test_machine_over_roles(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user", "u"), (3, 0, "user", "u"), (3, 1, "system", "s"), (3, 2, "assistant", "a"), (4, 0, None, "x")]
    errors = {(r.conv_id, r.nth): r.error for r in chat.segments(talks(spark, rows)).where("part = 0").collect()}
    assert errors == {(1, 1): None, (1, 2): None, (1, 3): None, (2, 1): "assistant may not follow the start", (2, 2): "user may not be last", (3, 1): None,
                      (3, 2): "system may not follow user", (3, 3): "assistant may not follow system", (4, 1): "no role may not follow the start"}
    assert chat.read_back(chat.segments(talks(spark, []))).count() == 0
    with pytest.raises(ValueError):
        chat.ChatTemplate(controls={"hash": "h"})
