"""From raw documents to token files: five stages, each on all that the one before it kept.

Defined results: nulls, empty and blank texts, ties and further columns pass as the operators define
them: a null or empty text is not toxic (unless such texts are by their labels), has the fingerprint
zero and so stays once, holds no benchmark window, has no words to mix and is not shown. Repeated rows
are one near-duplicate group. All stages but the last return the columns of their input, also those
whose names the operators use themselves. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm import decontamination, mixing, simhash, token_files, toxicity
from wellspring.llm.shared import benchmark, documents, labels, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the cut-off."""
    model = toxicity.fit(toxicity.labelled(docs, labels(spark, sf_dir)))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontamination.without_contaminated(docs, benchmark(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix shows, as documents, once for each pass that shows them."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; their documents as read back.

    The workers serve all stages, so they remember less here.
    """
    return token_files.token_file_report(docs, kept=30 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
#: SQL cannot express the first two stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
