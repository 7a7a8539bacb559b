"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Grams of one to three lower-case letters and signs fall into ``BUCKETS`` hash buckets; a
feature is a bucket's share of the text's grams times its inverse document frequency, which
Spark counts over all texts to learn from. The regression is fitted by follow-the-regularised-
leader with elastic-net penalties, on at most about ``ROWS_PER_LANGUAGE`` whole texts of each
language, in ``SHARDS`` parts whose weights are averaged, and a temperature is calibrated on
texts the fit has not seen. The sample is chosen by a hash of the id, so a fit repeats.

Defined results: texts that are null or without a letter, and all texts when there is nothing
to learn from, get ``und`` and score 0; repeated rows each get a row; rows of null id or null
language are never learned from; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.shared import fold, materialise

BITS = 16
BUCKETS = 1 << BITS
ORDERS = 3
CHARS_AT_ONCE = 1 << 20
#: Bounds of the fit; everything else covers all rows.
ROWS_PER_LANGUAGE, SHARDS, EPOCHS, CALIBRATION_SHARE = 2000, 4, 2, 0.2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
SCALE = 20.0


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: weight times inverse document frequency
    bias: np.ndarray
    temperature: float


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket of each gram, for stretches of the text."""
    signs = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(signs), CHARS_AT_ONCE):
        one = signs[max(0, start - ORDERS + 1) : start + CHARS_AT_ONCE] * np.uint32(0x9E3779B1)
        skip = min(start, ORDERS - 1)
        gram, out = one, [one[skip:]]
        for order in range(1, ORDERS):
            gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[order:]
            out.append(gram[max(0, skip - order) :])
        grams = np.concatenate(out)
        yield (((grams ^ (grams >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, stamp, texts_read = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts_read += 1
                found = [f for f in buckets(text or "")]
                if len(found) > 1:
                    hit = np.unique(np.concatenate([np.unique(f) for f in found]))
                else:  # the last write wins, so each bucket keeps one place
                    order = np.arange(len(found[0]))
                    stamp[found[0]] = order
                    hit = found[0][stamp[found[0]] == order]
                total[hit] += 1
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([texts_read])], ["bucket", "n"])

    partial = texts.select("text").mapInArrow(counted, "bucket long, n long")
    sums = partial.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    out = np.zeros(BUCKETS + 1, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out[:BUCKETS], int(out[-1])


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(BUCKETS, np.int64)
    for found in buckets(text):
        counts += np.bincount(found, minlength=BUCKETS)
    at = np.nonzero(counts)[0]
    return at, counts[at] * idf[at] * (SCALE / counts.sum())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (bucket x class, bias in the last row); a weight stays 0 until its gradient sum exceeds L1."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    weights = lambda z, n: np.where(
        np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    )
    for _ in range(EPOCHS):
        for at, x, label in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(z[at], n[at])
            off = _softmax(x @ w)
            off[label] -= 1.0
            g = x[:, None] * off
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(z, n)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    if not len(logits):
        return 1.0
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()
    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(train: DataFrame) -> LanguageModel | None:
    """``train``: doc_id, text, lang, without nulls in doc_id and lang."""
    per_language = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    languages = sorted(per_language)
    if not languages:
        return None
    df, texts = document_frequencies(train)
    idf = np.log((1 + texts) / (1 + df)) + 1
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    limit, label = F.lit(0), F.lit(0)
    for i, name in enumerate(languages):
        share = min(1.0, ROWS_PER_LANGUAGE / per_language[name])
        limit = F.when(F.col("lang") == name, F.lit(int(share * 1_000_000))).otherwise(limit)
        label = F.when(F.col("lang") == name, F.lit(i)).otherwise(label)
    turn = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(1_000_000))
    calibrates = turn < int(CALIBRATION_SHARE * 1_000_000)
    sample = train.where(draw < limit).select(
        "doc_id", "text", label.alias("label"), F.when(calibrates, F.lit(-1)).otherwise(turn % SHARDS).alias("shard")
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "label", "shard", "at", "x"]
        for batch in batches:
            rows = []
            for doc_id, text, label, shard in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if has_letter(text):
                    at, x = _features(text, idf)
                    rows.append((doc_id, label, shard, at.astype("<i4").tobytes(), x.astype("<f4").tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    table = materialise(
        sample.mapInArrow(features, "doc_id long, label long, shard long, at binary, x binary"), "language-features"
    )

    def unpacked(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
        return [
            (np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64), int(y))
            for a, x, y in zip(pdf["at"], pdf["x"], pdf["label"])
        ]

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label", "at"])
        order = np.random.default_rng(0).permutation(len(pdf))
        weights = _follow_the_leader(unpacked(pdf.iloc[order]), len(languages))
        return pd.DataFrame({"n": [len(pdf)], "weights": [weights.astype("<f4").tobytes()]})

    parts = table.where("shard >= 0").groupBy("shard").applyInPandas(fitted, "n long, weights binary").collect()
    mean = np.zeros((BUCKETS + 1, len(languages)))
    for row in sorted(parts, key=lambda r: (r["n"], bytes(r["weights"]))):
        mean += row["n"] * np.frombuffer(row["weights"], "<f4").reshape(mean.shape)
    mean /= max(1, sum(row["n"] for row in parts))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x @ mean[at] + mean[-1] for at, x, _ in unpacked(batch.to_pandas())]
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), batch.column(1)], ["logits", "label"])

    held = table.where("shard < 0").select("doc_id", "label", "shard", "at", "x").mapInArrow(judged, "logits array<double>, label long")
    held = sorted(map(tuple, held.collect()))  # at most CALIBRATION_SHARE of the sample
    logits = np.array([r[0] for r in held]).reshape(len(held), len(languages))
    temperature = _temperature(logits, np.array([r[1] for r in held], np.int64))
    return LanguageModel(languages, (mean[:-1] * idf[:, None] * SCALE).astype(np.float32), mean[-1], temperature)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id``, ``held_out`` (passed through), ``lang_pred`` and the calibrated probability ``score``."""

    def one(text: str | None) -> tuple[str, float]:
        if model is None or not has_letter(text):
            return "und", 0.0
        total, n = np.zeros(len(model.languages)), 0
        for found in buckets(text):
            total += model.table[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        chances = _softmax((total / n + model.bias) / model.temperature)
        best = int(chances.argmax())
        return model.languages[best], float(chances[best])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(judged, "doc_id long, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the folds other than 0 and predicts every text."""
    rows = docs.select("doc_id", "text", "lang", (fold(folds) == 0).alias("held_out"))
    train = rows.where(~F.col("held_out") & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    return predict(rows.select("doc_id", "text", "held_out"), fit(train))
