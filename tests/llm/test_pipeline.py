"""The pipeline and its registration."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from ledgerline.llm import containment, pii_crf, robust_rules, segment_bpe, simhash
from ledgerline.llm.shipping import ship
from llm_frames import collected, documents, odd_rows

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_all_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{n}" for n in range(1, 11)}
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = [docs]
    for _, function in corpus_pipeline.STAGES[:-1]:
        steps.append(function(spark, steps[-1], FOLDER).cache())
        assert steps[-1].columns == docs.columns
    good = {r["doc_id"] for r in robust_rules.rule_verdicts(docs).where("kept").collect()}
    assert {r["doc_id"] for r in steps[1].select("doc_id").collect()} == good
    groups = simhash.near_duplicates(steps[1]).collect()
    assert {r["doc_id"] for r in steps[2].select("doc_id").collect()} == {r["component_id"] for r in groups}
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    leaks = {r["doc_id"] for r in containment.contained_items(steps[2], items).collect()}
    assert leaks and {r["doc_id"] for r in steps[3].select("doc_id").collect()} \
        == {r["doc_id"] for r in steps[2].select("doc_id").collect()} - leaks
    assert all(not pii_crf.pattern_spans(r["text"]) for r in steps[4].select("text").collect())
    last = corpus_pipeline.STAGES[-1][1](spark, steps[4], FOLDER)
    assert collected(last) == collected(corpus_pipeline.run(spark, FOLDER))
    assert last.count() == steps[4].count()


def test_odd_documents_pass_all_stages(spark):
    docs = documents(spark, odd_rows())
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == len(odd_rows())
    assert segment_bpe.token_digests(docs.where("false"), "unused").count() == 0
