"""Quality scores: labelled neighbours vote in a latent-semantic space.

Terms. A text's terms are its lower-case words and its shapes: runs of two and four sign
classes (lower and upper letters, digits, blanks, line ends, each ASCII sign for itself, other
signs), where a class repeated more than twice counts twice. Both fall into hash buckets. A term
weighs (1 + ln count) times its inverse document frequency, counted over all texts. Words and
shapes are scaled to length 1 each, and the share of words that repeat the word before them is
one more feature, so neither the vocabulary nor the look of a text can hide the other.

Space. The leading ``DIMENSIONS`` right singular vectors of the features of a labelled sample, by
subspace iteration: Spark multiplies the sample with the current basis, the driver only
orthogonalises a matrix of buckets x dimensions.

Vote. The sample's vectors, at most 2 ``ROWS_PER_LABEL``, are broadcast. For blocks of documents
the cosines with all of them are one matrix product; the ``NEIGHBOURS`` nearest, and all that tie
with the last of them, vote with their cosine raised to ``POWER``. Both labels have like numbers
of voters, so the score is that of the text, not of the labels' frequency.

Defined results: null and empty texts, texts without any term that the space knows, and all texts
when nothing is labelled, get the labels' overall share of 1 (0.5 without labels); equal texts
of one label have one voter, repeated rows each get a row; an id with contradicting labels is not
learned from, nor is a null id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.shared import fold, materialise

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 14, 1 << 12
FEATURES = WORD_BUCKETS + SHAPE_BUCKETS + 1
SHAPE_ORDERS = (2, 4)
#: Bound of the fit: labelled rows of each label that span the space and vote.
ROWS_PER_LABEL = 2000
DIMENSIONS, ROUNDS, SHARDS = 32, 4, 4
NEIGHBOURS, POWER, CUTOFF = 25, 8, 0.3
SIGNS_AT_ONCE, TEXTS_AT_ONCE = 1 << 20, 256


@dataclass
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray  # features x dimensions
    vectors: np.ndarray  # voters x dimensions, of length 1
    labels: np.ndarray
    share: float  # of label 1 among all rows to learn from


@lru_cache(maxsize=1)
def sign_classes() -> np.ndarray:
    """Class of every code point of the first plane; those beyond are of class 6."""
    kinds = {"Ll": 1, "Lu": 2, "Lt": 2, "Lm": 1, "Lo": 1, "Nd": 3}
    table = np.array([kinds.get(unicodedata.category(chr(c)), 6) for c in range(0x10000)], np.uint32)
    table[32], table[9:14] = 4, 5
    for c in range(33, 127):
        if table[c] == 6:
            table[c] = 7 + c
    return table


def shapes(text: str) -> np.ndarray:
    """Occurrences of each shape bucket."""
    table, counts, before = sign_classes(), np.zeros(SHAPE_BUCKETS, np.int64), np.empty(0, np.uint32)
    for start in range(0, len(text), SIGNS_AT_ONCE):
        signs = np.frombuffer(text[start : start + SIGNS_AT_ONCE].encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.concatenate([before, np.where(signs < 0x10000, table[np.minimum(signs, 0xFFFF)], np.uint32(6))])
        skip = len(before)
        kept = np.ones(len(kinds), bool)
        kept[2:] = (kinds[2:] != kinds[1:-1]) | (kinds[1:-1] != kinds[:-2])
        kinds = kinds[kept]
        skip = int(kept[:skip].sum())
        for order in SHAPE_ORDERS:
            if len(kinds) >= order:
                gram = np.zeros(len(kinds) - order + 1, np.uint32)
                for k in range(order):
                    gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B) + kinds[k : k + len(gram)] + np.uint32(order)
                gram = gram[max(0, skip - order + 1) :]
                at = ((gram ^ (gram >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(20)
                counts += np.bincount(at, minlength=SHAPE_BUCKETS)
        before = kinds[-(max(SHAPE_ORDERS) - 1) :]
    return counts


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their counts and the share of words that repeat the one before."""
    text = text or ""
    words = text.lower().split()
    found = Counter(words)
    keys = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in found), np.int64, len(found))
    at, inverse = np.unique(keys, return_inverse=True)
    counts = np.bincount(inverse, np.fromiter(found.values(), np.float64, len(found)), len(at)) if len(at) else np.empty(0)
    shape = shapes(text)
    seen = np.nonzero(shape)[0]
    repeated = sum(map(eq, words, words[1:])) / max(1, len(words) - 1)
    return np.concatenate([at, seen + WORD_BUCKETS]), np.concatenate([counts, shape[seen]]), repeated


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that are not zero: their numbers and values."""
    at, counts, repeated = term_counts(text)
    x = (1 + np.log(counts)) * idf[at]
    for family in (at < WORD_BUCKETS, at >= WORD_BUCKETS):
        length = np.sqrt(np.square(x[family]).sum())
        if length:
            x[family] /= length
    if repeated:
        at, x = np.append(at, FEATURES - 1), np.append(x, repeated)
    return at, x


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[term_counts(text)[0]] += 1
                n += 1
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES + 1, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out[:FEATURES], int(out[-1])


def _sample(docs: DataFrame, known: DataFrame, most: int) -> tuple[DataFrame, float]:
    """Texts of about ``most`` ids of each label at most, by a hash of the id, and the share of label 1.

    The ids are chosen before texts are read: they are few and go to where the texts lie.
    """
    counts = {r["quality"]: r["count"] for r in docs.select("doc_id").join(known, "doc_id").groupBy("quality").count().collect()}
    limit = F.lit(0)
    for label, n in counts.items():
        limit = F.when(F.col("quality") == label, F.lit(int(1_000_000 * min(1.0, most / n)))).otherwise(limit)
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), share


def _basis(table: DataFrame, dimensions: int) -> np.ndarray:
    """Leading right singular vectors of the sample's features, signs fixed."""
    basis = np.random.default_rng(0).standard_normal((FEATURES, dimensions), "f4")

    def times(pdf: pd.DataFrame) -> pd.DataFrame:
        basis, out = shared.value, np.zeros((FEATURES, dimensions))
        pdf = pdf.sort_values(["doc_id", "at"])
        for at, x in zip(pdf["at"], pdf["x"]):
            at, x = np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4").astype(np.float64)
            out[at] += np.outer(x, x @ basis[at])
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "product": [out.astype("<f4").tobytes()]})

    for _ in range(ROUNDS):
        shared = table.sparkSession.sparkContext.broadcast(basis)
        parts = table.groupBy("shard").applyInPandas(times, "shard long, product binary").collect()  # SHARDS rows
        product = np.zeros((FEATURES, dimensions))
        for row in sorted(parts, key=lambda r: r["shard"]):
            product += np.frombuffer(row["product"], "<f4").reshape(FEATURES, dimensions)
        shared.destroy()
        basis = np.linalg.qr(product)[0].astype("<f4")
    return basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(dimensions)])


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 1e-6)


def fit(docs: DataFrame, known: DataFrame, most: int = ROWS_PER_LABEL, dimensions: int = DIMENSIONS) -> QualityModel | None:
    """``docs``: all texts; ``known``: the ids to learn from, each once, with their ``quality`` (0 or 1)."""
    sample, share = _sample(docs, known, most)
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, idf) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([i % SHARDS for i in batch.column(0).to_pylist()], pa.int64()),
                 pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in rows], pa.binary())],
                ["doc_id", "label", "shard", "at", "x"],
            )

    rows = sample.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("long"))
    table = materialise(rows.mapInArrow(described, "doc_id long, label long, shard long, at binary, x binary"), "quality-features")
    basis = _basis(table, dimensions)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            found = [np.frombuffer(x, "<f4") @ basis[np.frombuffer(at, "<i4")] for at, x in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype("<f4").tobytes() for v in found], pa.binary())], ["label", "v"])

    found = table.select("label", "at", "x").mapInArrow(projected, "label long, v binary").distinct()
    voters = sorted((r["label"], bytes(r["v"])) for r in found.collect())  # at most about 2 * most rows
    if not voters:
        return None
    vectors = _unit(np.frombuffer(b"".join(v for _, v in voters), "<f4").reshape(-1, dimensions).astype(np.float32))
    known = np.abs(vectors).sum(axis=1) > 0
    return QualityModel(idf.astype(np.float32), basis, vectors[known], np.array([y for y, _ in voters], np.float32)[known], share)


def votes(vectors: np.ndarray, model: QualityModel, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Score of each row of ``vectors``, which have length 1 or are zero."""
    out = np.full(len(vectors), model.share)
    some = np.abs(vectors).sum(axis=1) > 0
    if not some.any() or not len(model.vectors):
        return out
    near = vectors[some] @ model.vectors.T
    k = min(neighbours, near.shape[1])
    last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    weight = np.where(near >= last[:, None], np.maximum(near, 0), 0).astype(np.float64) ** POWER
    total = weight.sum(axis=1)
    out[some] = np.where(total > 0, weight @ model.labels / np.maximum(total, 1e-300), model.share)
    return np.clip(out, 0.0, 1.0)


def scored(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``doc_id``, ``held_out`` (passed through) and the ``score`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(start, TEXTS_AT_ONCE)
                if model is None:
                    scores = np.full(some.num_rows, 0.5)
                else:
                    found = [features(t, model.idf) for t in some.column(2).to_pylist()]
                    vectors = np.array([x.astype(np.float32) @ model.basis[at] for at, x in found], np.float32)
                    scores = votes(_unit(vectors), model)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(judged, "doc_id long, held_out boolean, score double")


def quality_report(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Learns from the labels outside the held fold and scores every text."""
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_max"))
    known = known.where((F.col("quality") == F.col("_max")) & (fold(folds) != held)).select("doc_id", "quality")
    model = fit(docs, known)
    found = scored(docs.select("doc_id", "text", (fold(folds) == held).alias("held_out")), model)
    return found.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
