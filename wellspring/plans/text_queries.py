"""Queries over documents, retrieval and diagnosis texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.functions.values import col
from wellspring.operators import diagnosis, evidence, retrieval
from wellspring.operators import telemetry as views
from wellspring.operators.index_store import IndexStore
from wellspring.plans.registry import query, rounded
from wellspring.session import materialise, scratch_path
from wellspring.sources import documents as docs
from wellspring.sources.testtables import dossiers, predictions, table, telemetry


def chunks(spark, sf_dir):
    return docs.chunk_sections(dossiers(spark, sf_dir))


def index(spark, sf_dir, store=True):
    return retrieval.fit_index(chunks(spark, sf_dir), store)


def index_for_one_search(spark, sf_dir):
    """An index whose weights are derived when the search reads them, which it does once."""
    return index(spark, sf_dir, False)


@query
def document_event_ids(spark, sf_dir):
    names = dossiers(spark, sf_dir).select("doc_name")
    other = names.select(F.regexp_replace("doc_name", "event_", "note ").alias("doc_name"))
    return names.union(other).select("doc_name", docs.event_id(F.col("doc_name")).alias("event_id"))


@query
def chunk_sections(spark, sf_dir):
    return chunks(spark, sf_dir).withColumn("content", F.md5("content"))


@query
def tfidf_vocabulary(spark, sf_dir):
    return rounded(index(spark, sf_dir, False).idf, 8)


@query
def tfidf_vectors(spark, sf_dir):
    """Every weight of the index."""
    return rounded(index(spark, sf_dir, False).postings.select("chunk_id", "term", "weight"), 8)


@query
def extended_index(spark, sf_dir):
    """Every weight of a stored index after the documents came in two batches, one of them twice."""
    store = IndexStore.create(spark, scratch_path(spark, "index-store"), retrieval.task_count(spark))
    second = F.pmod(F.xxhash64("doc_name"), F.lit(2)) == 1
    for batch, some in (("first", ~second), ("second", second), ("first", ~second)):
        store.extend(chunks(spark, sf_dir).filter(some), batch)
    return rounded(store.index().postings, 8)


@query
def free_query(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = retrieval.search(asked, index_for_one_search(spark, sf_dir), 3)
    return rounded(found.select("query_id", "rank", "chunk_id", "score"), 6)


@query
def boosted_search(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), (F.col("item_id") % 10).cast("int").alias("event"))
    found = retrieval.search(asked, index_for_one_search(spark, sf_dir), 4, "event")
    return rounded(found.select("query_id", "rank", "chunk_id", "score"), 6)


def incidents(spark, sf_dir):
    """All stored faults with their evidence and a confidence."""
    faults = telemetry(spark, sf_dir).filter(F.col("fault").isNotNull())
    found = evidence.with_evidence(views.parse_payload(faults))
    number = F.when(F.col("fault") == "Severe Slugging", 3).otherwise(4)
    return found.select(
        "id", F.col("device_id").alias("well_id"), F.lit("ANOMALY").alias("status"), F.lit("FAULT").alias("binary_status"),
        number.alias("event_id"), F.col("fault").alias("event_name"),
        F.bround(F.expr(views.number_sql("T-JUS-CKGL")) / 100, 4).alias("confidence"), "evidence")


def stored_incidents(spark, sf_dir):
    return materialise(incidents(spark, sf_dir), "incidents")


@query
def retrieval_queries(spark, sf_dir):
    text = retrieval.build_query(F.col("event_id"), F.col("event_name"), F.col("evidence"))
    return incidents(spark, sf_dir).select("id", text.alias("query"))


@query
def retrieve_fault_knowledge(spark, sf_dir):
    found = retrieval.retrieve_fault_knowledge(stored_incidents(spark, sf_dir), index_for_one_search(spark, sf_dir), 3)
    return rounded(found.select("id", "rank", "chunk_id", "score"), 6)


@query
def knowledge_sections(spark, sf_dir):
    found = diagnosis.extract_sections(chunks(spark, sf_dir))
    return found.select("chunk_id", F.md5(F.array_join("causes", "|")).alias("causes"),
                        F.md5(F.array_join("checks", "|")).alias("checks"), F.md5("safety").alias("safety"))


@query
def diagnosis_reports(spark, sf_dir):
    found = diagnosis.diagnose(stored_incidents(spark, sf_dir), index_for_one_search(spark, sf_dir))
    return found.select("id", F.md5("raw_diagnosis").alias("raw_diagnosis"), F.md5("prompt").alias("prompt"),
                        F.array_join("retrieved_sources", ", ").alias("sources"))


@query
def confidence_bands(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.select("event_id", diagnosis.confidence_band(F.col("multi_confidence")).alias("band"),
                       diagnosis.percent(F.col("multi_confidence")).alias("shown"))


@query
def evidence_texts(spark, sf_dir):
    found = evidence.with_evidence(views.parse_payload(telemetry(spark, sf_dir)))
    return found.select("id", diagnosis.report_evidence(F.col("evidence")).alias("report"),
                        diagnosis.prompt_evidence(F.col("evidence")).alias("prompt"))


@query
def fallback_dossiers(spark, sf_dir):
    faults = views.flatten_telemetry(telemetry(spark, sf_dir)).filter(F.col("fault").isNotNull())
    return evidence.localize(faults).select("id", diagnosis.fallback_dossier().alias("dossier"))


@query
def snapshot_dossiers(spark, sf_dir):
    faults = views.flatten_telemetry(telemetry(spark, sf_dir)).filter(F.col("fault").isNotNull())
    scaled = faults.withColumn("P-ANULAR", col("P-ANULAR") / 1000)
    return views.round_view(scaled, 2).select("id", diagnosis.snapshot_dossier().alias("dossier"))


@query
def dense_topk(spark, sf_dir):
    """Vectors closest to the mean vector of each label (one query per label)."""
    vectors = table(spark, sf_dir, "embeddings")
    entries = vectors.select("label", F.posexplode_outer("embedding").alias("place", "x"))
    means = entries.groupBy("label", "place").agg(F.avg("x").alias("x")).groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("place", "x"))).alias("mean"))
    asked = means.select(F.col("label").alias("query_id"), F.transform("mean", lambda e: e["x"]).alias("vector"))
    return rounded(retrieval.dense_topk(vectors, asked, 4), 4)
