"""The stored index: extended, repeated and broken-off batches against a fresh fit."""

import pytest
from pyspark.sql import functions as F

from wellspring.operators import retrieval
from wellspring.operators.index_store import COUNTS, IndexStore

SCHEMA = "chunk_id string, doc_name string, doc_title string, section_no int, section_title string, event_id int, content string"


def rows(texts, first=0):
    return [(f"c{i}", f"d{i}", "t", i, "s", i % 3, text) for i, text in enumerate(texts, first)]


def weights(index):
    return {(r.chunk_id, r.term): r.weight for r in index.postings.collect()}


@pytest.fixture(scope="module")
def batches(spark):
    one = rows(["worn seals drip oil", "clogged filters starve burners", None, "", "the of and"])
    two = rows(["seals of oil pumps", "brown filters and worn seals", "zebra"], 5)
    return [spark.createDataFrame(b, SCHEMA) for b in (one, two)]


def filled(spark, batches, path):
    store = IndexStore.create(spark, str(path), 4)
    store.extend(batches[0], "one")
    store.extend(batches[1], "two")
    return store


@pytest.fixture(scope="module")
def store(spark, batches, tmp_path_factory):
    return filled(spark, batches, tmp_path_factory.mktemp("store") / "it's an index")


def test_extended_and_reopened_equal_a_fresh_fit(spark, store, batches):
    fresh = weights(retrieval.fit_index(batches[0].union(batches[1])))
    assert weights(store.index()) == pytest.approx(fresh, abs=1e-12)
    spark.sql(f"DROP TABLE {store._bucketed('counts', COUNTS)}")  # as for a session that never saw it
    again = IndexStore.open(spark, store.path)
    assert again.buckets == 4 and weights(again.index()) == pytest.approx(fresh, abs=1e-12)
    with pytest.raises(Exception):
        IndexStore.create(spark, store.path)
    with pytest.raises(Exception):
        IndexStore.open(spark, store.path + "-missing")


def test_repeated_and_broken_batches_change_nothing(spark, batches, tmp_path, monkeypatch):
    store = filled(spark, batches, tmp_path / "index")
    before = weights(store.index())
    store.extend(spark.createDataFrame(rows(["other words"], 90), SCHEMA), "two")
    store.extend(batches[0].limit(0), "empty")
    store.extend(batches[0].withColumn("content", F.lit("known ids stay as they are")), "known")
    assert weights(store.index()) == pytest.approx(before, abs=1e-12)
    late = spark.createDataFrame(rows(["late seals", "late oil"], 50) + rows(["late twin"], 51) + [(None,) * 7], SCHEMA)

    def lost(self, *_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(IndexStore, "_weighed", lost)
        with pytest.raises(OSError):
            store.extend(late, "late")
    assert weights(store.index()) == pytest.approx(before, abs=1e-12)
    store.extend(late, "late")
    store.extend(late, "later")
    chunks = [b.select("*") for b in batches] + [spark.createDataFrame(rows(["late seals", "late oil"], 50), SCHEMA)]
    fresh = retrieval.fit_index(chunks[0].union(chunks[1]).union(chunks[2]))
    assert weights(store.index()) == pytest.approx(weights(fresh), abs=1e-12)
    assert [r.chunks for r in store.batches().orderBy("number").collect()] == [5, 3, 0, 0, 2, 0]


def test_no_exchange_by_term(store):
    for part in (store._weighed(store.batches()), store.index().idf):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "hashpartitioning" not in plan


def test_search_in_a_store_equals_search_in_an_index(spark, store, batches):
    queries = spark.createDataFrame([(1, "worn seals", 0), (2, "zebra filters", 1), (3, "nothing", 2)], "query_id long, query string, event int")
    fresh = retrieval.fit_index(batches[0].union(batches[1]))
    for event in (None, "event"):
        found = [
            [(r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in retrieval.search(queries, i, 3, event).orderBy("query_id", "rank").collect()]
            for i in (store.index(), fresh)
        ]
        assert found[0] == found[1] and len(found[0]) == 9


def test_a_store_without_batches(spark, tmp_path):
    store = IndexStore.create(spark, str(tmp_path / "bare"))
    with pytest.raises(ValueError):
        store.index()


def test_postings_meet_their_lengths_without_a_sort_by_chunk(store):
    plan = store.index().postings._jdf.queryExecution().executedPlan().toString()
    assert "Sort [chunk_id" not in plan and "ShuffledHashJoin [chunk_id" in plan
