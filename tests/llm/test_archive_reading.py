"""Records of one chunk are read where they lie; only longer ones are shuffled."""

import pytest

pytest.importorskip("pyarrow")
from threatloom.llm import warc  # noqa: E402


def test_short_records_are_not_shuffled(spark):
    rows = [(1, "u", "a"), (2, "u", "b" * 150_000), (3, "v", "a"), (4, "v", "b" * 150_000), (5, "w" * 70_000, "a"), (6, "w", None), (7, "w", "c" * (1 << 16))]
    chunks = warc.record_chunks(spark.createDataFrame(rows, "page_id long, url string, html string")).localCheckpoint()
    assert {r.record for r in chunks.where("last").collect()} == {r.record for r in chunks.where("chunk = 0").collect()}
    found = warc.read_records(chunks)
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.intact) for r in found.collect()) == [
        (1, 1, "response", None, True), (2, 150_000, "response", None, True), (3, 1, "revisit", 1, True), (4, 150_000, "revisit", 2, True),
        (5, 1, "revisit", 1, True), (6, 0, "response", None, True), (7, 1 << 16, "response", None, True)]
    before = found._jdf.queryExecution().optimizedPlan().toString().partition("RepartitionByExpression")[0]
    assert before.count("MapInArrow") == 2, before


def test_a_long_record_that_lost_its_end_is_not_intact(spark):
    chunks = warc.record_chunks(spark.createDataFrame([(1, "u", "b" * 150_000), (2, "u", "short")], "page_id long, url string, html string")).localCheckpoint()
    found = warc.read_records(chunks.where("not (last and chunk > 0)"))
    assert {r.page_id: r.intact for r in found.collect()} == {1: False, 2: True}
