"""The registered queries against their SQL, and the pipeline stage by stage on planted cases."""

import os
import random

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from threatloom.llm import queries

SF = "/root/testdata/sf0.001"
PLANTED = {f"op{n}_" for n in range(1, 14)}


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n in queries.QUERIES]
    assert {n.split("_")[0] + "_" for n in names if n != "pipeline"} == PLANTED and len(names) == 14
    assert set(queries.ORACLES) == {"op3_decontaminate", "op6_line_dedup", "op7_chat", "op10_warc", "op11_ranked", "op12_repeats", "op13_infill"}


def prose(seed, n):
    draw = random.Random(seed)
    words = ["".join(draw.choice(["ba", "to", "ri", "men", "sul", "ka"]) for _ in range(draw.randrange(1, 5))) for _ in range(n)]
    return "\n".join(" ".join(words[i: i + 14]) + "." for i in range(0, n, 14))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, prose(f"item{k}", 40).replace("\n", " ")) for k in range(3)]
    common = "this footer is found under very many documents of the corpus"
    clean = {k: f"{prose(k, 200)}\n{common if k % 4 == 0 else ''}" for k in range(60)}
    rows = [(k, t) for k, t in clean.items()]
    rows += [(100 + k, clean[k]) for k in range(5)] + [(110 + k, clean[k].replace("men", "nem", 1)) for k in range(5, 8)]
    rows += [(120 + k, prose(f"long{k}", 900) + "\n" + items[k][1] + "\n" + prose(f"more{k}", 300)) for k in range(3)]
    rows += [(130, "too short"), (131, None), (132, "over and over again " * 60)]
    documents = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, clean, common


def test_stages_catch_what_is_planted(spark, planted):
    folder, clean, common = planted
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = docs.cache()
        after[name] = {r.doc_id: r for r in docs.collect()}
    assert set(after["quality_rules"]) == {*clean, *range(100, 105), *range(115, 118), 120, 121, 122}
    assert set(after["line_dedup"]) == set(after["quality_rules"])
    assert sum(common in (r.text or "") for r in after["line_dedup"].values()) == 1
    assert all(r.n_chars == len(r.text) for r in after["line_dedup"].values())
    assert set(after["simhash_near_dedup"]) == {*clean, 120, 121, 122}
    assert set(after["decontamination"]) == set(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(clean)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(whole, key=str) == sorted(packed, key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")
def test_pipeline_over_the_shared_tables(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
