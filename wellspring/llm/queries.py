"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wellspring.llm import (
    chunk_fingerprints,
    decontamination,
    filter_audit,
    kneser_ney,
    language,
    merkle,
    mixing,
    oracles,
    pii,
    quality,
    simhash,
    token_counts,
    token_files,
    toxicity,
)
from wellspring.llm.shared import benchmark, documents, labels, materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL = oracles.SQL


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_personal_data(spark, sf_dir):
    return pii.personal_data_report(documents(spark, sf_dir))


@query
def op2_language(spark, sf_dir):
    return language.language_report(documents(spark, sf_dir))


@query
def op3_token_files(spark, sf_dir):
    return token_files.token_file_report(documents(spark, sf_dir))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op5_decontamination(spark, sf_dir):
    return decontamination.decontamination_report(documents(spark, sf_dir), benchmark(spark, sf_dir))


@query
def op5_proximity(spark, sf_dir):
    return decontamination.proximity_report(documents(spark, sf_dir), benchmark(spark, sf_dir))


@query
def op6_near_duplicates(spark, sf_dir):
    return simhash.near_duplicate_report(documents(spark, sf_dir))


@query
def op7_chunk_fingerprints(spark, sf_dir):
    return chunk_fingerprints.fingerprint_report(documents(spark, sf_dir))


@query
def op8_mixing(spark, sf_dir):
    return mixing.mixing_report(documents(spark, sf_dir))


@query
def op9_language_model(spark, sf_dir):
    return kneser_ney.language_model_report(documents(spark, sf_dir))


@query
def op10_token_counts(spark, sf_dir):
    counts = materialise(token_counts.length_counts(documents(spark, sf_dir)), "length-counts")
    return token_counts.with_suffix_sums(counts)


@query
def op11_quality(spark, sf_dir):
    return quality.quality_report(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest_report(documents(spark, sf_dir))


@query
def op13_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(documents(spark, sf_dir), labels(spark, sf_dir))
