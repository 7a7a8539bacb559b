"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.session import materialise, scratch_path  # noqa: F401  (used by the operators)

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: White space that ends a word, and the rest of a word, as Java and RE2 both read it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def fold(folds: int, name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % F.lit(folds)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Only A-Z change, unlike ``lower``."""
    return F.translate(column, UPPER, LOWER)


def utf8_words(text: str | None) -> list[bytes]:
    """Words between the six ASCII spaces, A-Z in lower case, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is the definition.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


ROW_KEY = ["_known", "_id", "_text_key"]


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds plain, non-null columns that name a row by its id and text, for joins by equality."""
    return docs.withColumns(
        {
            "_known": F.col("doc_id").isNotNull(),
            "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")),
            "_text_key": F.xxhash64(whole_text()),
        }
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this library on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remembered(owner: str, make: Callable):
    """What ``owner`` keeps in this worker process from task to task.

    Workers serve one stage after the other, so there is one such table: when another owner
    asks, the former one's is released. ``make`` builds it.
    """
    held = sys.__dict__.setdefault("_wellspring_memory", {})
    if owner not in held:
        held.clear()
        held[owner] = make()
    return held[owner]
