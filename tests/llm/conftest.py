import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, nth string, row string, key string, leads string, dedup_id string, n string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), *["x"] * 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
