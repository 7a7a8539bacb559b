"""The pipeline and the contract of its queries, on the smallest tables."""

import collections
import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import connect, difference
from wellspring.llm import decontamination, simhash, toxicity
from wellspring.llm.queries import QUERIES, SQL
from wellspring.llm.shared import benchmark, documents, labels, materialise

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_operator_is_registered():
    assert {int(n.split("_")[0][2:]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


@needs_tables
def test_each_stage_keeps_what_its_operator_decides(spark):
    docs = documents(spark, SF_DIR)
    names = docs.columns
    ids = lambda frame: collections.Counter(r[0] for r in frame.select("doc_id").collect())

    kept = materialise(corpus_pipeline.drop_toxic(spark, docs, SF_DIR), "test")
    report = toxicity.toxicity_report(docs, labels(spark, SF_DIR))
    assert ids(kept) == ids(report.where("predicted = 0")) and kept.columns == names

    once = materialise(corpus_pipeline.drop_near_duplicates(spark, kept, SF_DIR), "test")
    classes = simhash.near_duplicate_report(kept)
    assert ids(once) == ids(classes.where("doc_id = component_id")) and once.columns == names

    clean = materialise(corpus_pipeline.drop_contaminated(spark, once, SF_DIR), "test")
    report = decontamination.decontamination_report(once, benchmark(spark, SF_DIR))
    assert ids(clean) == ids(report.where("NOT contaminated")) and clean.columns == names

    mixed = materialise(corpus_pipeline.mix_sources(spark, clean, SF_DIR), "test")
    assert mixed.columns == names and max(ids(mixed).values()) <= 2

    tokens = corpus_pipeline.write_tokens(spark, mixed, SF_DIR).orderBy("start").collect()
    assert collections.Counter(r.doc_id for r in tokens) == ids(mixed)
    assert [r.doc_id for r in tokens] == sorted(r.doc_id for r in tokens)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(tokens, tokens[1:]))


@needs_tables
def test_stages_take_empty_tables(spark):
    docs = documents(spark, SF_DIR).where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.count() == 0
