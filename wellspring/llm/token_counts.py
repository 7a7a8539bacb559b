"""Exact histogram of encoded lengths, whose suffix sums answer every context limit.

Texts are encoded where they lie and only lengths leave the tasks, already counted, so the
shuffle is one row per task and distinct length. The suffix sums run within ranges of
``SPAN`` lengths and over the totals of the ranges, never over all lengths in one task.

Defined results: null and empty texts have no tokens (length 0); repeated rows count each
time; an empty table gives an empty histogram; other columns are ignored. A limit that no
document reaches keeps every token.
"""

from __future__ import annotations

import base64
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.shared import TOKENIZERS

SPAN = 4096


def encoder(path: str):
    """Byte-pair encoder of a rank file, kept in the worker process."""
    import tiktoken
    from public_tokenizers import PATTERN

    kept = sys.__dict__.setdefault("_wellspring_encoders", {})
    if path not in kept:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        kept[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def length_counts(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """``n_tokens`` and ``n_docs``: how many documents have each encoded length."""
    path = ranks or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(path).encode_ordinary, Counter()
        for batch in batches:
            lengths.update(len(encode(t)) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict(
            {"n_tokens": pa.array(lengths.keys(), pa.int64()), "n_docs": pa.array(lengths.values(), pa.int64())}
        )

    partial = docs.select("text").mapInArrow(counted, "n_tokens long, n_docs long")
    return partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """Adds, per length, the documents and tokens of that length or more, and of all lengths.

    ``truncated_tokens`` is what remains of the whole table when every document is cut to
    ``n_tokens``; ``share_fitting`` is the share of documents that need no cut.
    """
    spans = counts.withColumn("_span", F.floor(F.col("n_tokens") / SPAN)).withColumn(
        "_tokens", F.col("n_docs") * F.col("n_tokens")
    )
    totals = spans.groupBy("_span").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    above = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_span",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_d").over(whole).alias("total_docs"),
        F.sum("_t").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("_span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = spans.withColumn("_docs", F.sum("n_docs").over(inside)).withColumn(
        "_longer", F.sum("_tokens").over(inside)
    )
    docs, tokens = F.col("_docs") + F.col("_docs_above"), F.col("_longer") + F.col("_tokens_above")
    return summed.join(totals, "_span").select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - tokens + F.col("n_tokens") * docs).alias("truncated_tokens"),
        ((F.col("total_docs") - docs + F.col("n_docs")) / F.col("total_docs")).alias("share_fitting"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: documents that exceed it and the tokens that remain when cut to it."""
    picked = F.when(F.col("n_tokens") > F.col("context_limit"), F.struct("n_tokens", "docs_at_least", "tokens_at_least"))
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    found = histogram.withColumn("context_limit", asked).groupBy("context_limit").agg(
        F.min(picked).alias("s"), F.max("total_tokens").alias("total_tokens")
    )
    longer = F.coalesce(F.col("s.docs_at_least"), F.lit(0))
    cut = F.coalesce(F.col("s.tokens_at_least"), F.lit(0)) - F.col("context_limit") * longer
    return found.select("context_limit", longer.alias("docs_longer"), (F.col("total_tokens") - cut).alias("tokens_kept"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """Per share: the smallest length that at least this share of the documents does not exceed."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares]))
    fits = F.when(F.col("share_fitting") >= F.col("share"), F.col("n_tokens"))
    return histogram.withColumn("share", asked).groupBy("share").agg(F.min(fits).alias("n_tokens"))
