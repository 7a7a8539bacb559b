"""Toxic passages: maximum-scoring segments over token log-odds.

Learning. Words are counted in the contexts of a labelled sample (a context is a word with its
two neighbours; equal contexts of one label count once, so copies of a text carry no extra
weight). The chance of the toxic label given a word has a Dirichlet prior whose mean is that of
the word's stem: the first letters, ``STEMS`` of them in turn, and at last the rate of all
words. A word's score is its log-odds against that rate, less one standard error, less
``DRIFT``; words and stems without positive score or stem are neutral and cost ``DRIFT``.

Scanning. All maximal scoring segments of a text are found in one pass (Ruzzo and Tompa); only
words of positive score need a step, the stretch between them is one number.

Calibration. In clean texts the number of segments of score s or more in n words is close to
K n exp(-lambda s). Both are estimated on clean texts held out of the counts; the extreme-value
chance of a text's best segment, and the count of significant ones, then go through a logistic
fit on the same held-out texts, which gives the score.

Defined results: null and empty texts, and texts without words, have no segment and get the
score of such texts; repeated rows each get a row; a label belongs to an id, and if an id has
several, it is not learned from; with no labels the score is the prior's. Empty tables give
empty tables; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.shared import fold, materialise, remembered

#: Bounds of the fit: rows of each label that are counted, and that calibrate.
ROWS_PER_LABEL, CALIBRATION_ROWS = 10_000, 3_000
STEMS, PRIOR_WEIGHT, DRIFT = (4, 5, 6), 10.0, 1.0
SIGNIFICANT, CUTOFF = 0.01, 0.3
KEPT_WORDS = 100_000  # scores that a task remembers
WORDS = re.compile(r"\w+")


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)  # words as they are, stems with a "*" behind
    rate: float = 0.0  # clean segments a word
    decay: float = 1.0
    weights: tuple[float, float, float] = (-2.0, 0.0, 0.0)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def word_score(word: str, scores: dict[str, float]) -> float:
    """Score of the word itself or of its longest known stem, else that of a neutral word."""
    found = scores.get(word)
    for length in reversed(STEMS):
        if found is not None:
            return found
        if len(word) >= length:
            found = scores.get(word[:length] + "*")
    return -DRIFT if found is None else found


def segments(words: list[str], scores: dict[str, float], cache: dict[str, float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, behind the last word) of positive score.

    Keeps, per open segment, the total left of it and up to its end; each new one is merged back
    to the nearest segment that begins lower, as long as that one ends lower too. A segment
    remembers where that nearest one stands, so what a search has passed is not passed again
    and the work is linear in the number of words.
    """
    total, kept = 0.0, []  # kept: (left, right, start, stop, nearest earlier one that begins lower)
    for i, word in enumerate(words):
        s = cache.get(word)
        if s is None:
            s = cache[word] = word_score(word, scores)
        if s <= 0:
            total += s
            continue
        left, right, start = total, total + s, i
        total = right
        j = len(kept) - 1
        while j >= 0 and kept[j][0] >= left:
            j = kept[j][4]
        while j >= 0 and kept[j][1] < right:
            left, _, start, _, before = kept[j]
            del kept[j:]
            j = before
        kept.append((left, right, start, i + 1, j))
    return [(right - left, start, stop) for left, right, start, stop, _ in kept]


def _balanced(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows of each label, chosen by a hash of the id."""
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    limit = F.lit(0)
    for label, n in counts.items():
        limit = F.when(F.col("toxic") == label, F.lit(int(1_000_000 * min(1.0, most / n)))).otherwise(limit)
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(key)), F.lit(1_000_000)) < limit)


def _context_counts(sample: DataFrame) -> DataFrame:
    """``word``, ``toxic``, ``clean``: distinct contexts of each word by label."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                around = ["", *words, ""]
                seen = {
                    xxh64_intdigest(f"{a} {b} {c}") >> 1: b for a, b, c in zip(around, around[1:], around[2:])
                }
                if seen:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.string()),
                         pa.array([label] * len(seen), pa.int64())],
                        ["context", "word", "label"],
                    )

    found = sample.select("text", F.col("toxic").cast("long")).mapInArrow(contexts, "context long, word string, label long")
    once = found.select("context", "label", "word").distinct()
    toxic = F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("toxic")
    return once.groupBy("word").agg(toxic, F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("clean"))


def _log_odds(counts: DataFrame) -> dict[str, float]:
    """Scores of the words and stems that are not neutral.

    Bounded by the sample: a word or stem with positive score needs several toxic contexts.
    """
    total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not total[0] or not total[1]:
        return {}
    overall = total[0] / (total[0] + total[1])
    words = counts.select("word", "toxic", "clean")
    level = words
    chain = None
    for length in STEMS:
        stem = F.substring("word", 1, length)
        at = level.where(F.length("word") >= length).groupBy(stem.alias("stem")).agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
        )
        if chain is None:
            at = at.withColumn("mean", F.lit(overall)).withColumn("above", F.lit(False))
        else:
            shorter = chain.select(F.col("stem").alias("_s"), F.col("chance").alias("mean"), "above", "score")
            at = at.join(shorter, F.substring("stem", 1, length - 1) == F.col("_s"))
            at = at.withColumn("above", F.col("above") | (F.col("score") > 0)).drop("_s", "score")
        chain = _scored(at, overall)
        listed = chain.where(F.col("above") | (F.col("score") > 0)).select(F.concat("stem", F.lit("*")).alias("name"), "score")
        found = listed if length == STEMS[0] else found.union(listed)
    longest = chain.select(F.col("stem").alias("_s"), F.col("chance").alias("_m"), F.col("above").alias("_a"), F.col("score").alias("_p"))
    whole = words.join(longest, F.substring("word", 1, STEMS[-1]) == F.col("_s"), "left")
    shorter_words = F.length("word") < STEMS[-1]
    # a word shorter than the longest stem leans on the overall rate, any other on its longest stem
    whole = whole.withColumn("mean", F.when(shorter_words | F.col("_m").isNull(), F.lit(overall)).otherwise(F.col("_m")))
    whole = whole.withColumn("above", F.coalesce(F.col("_a") | (F.col("_p") > 0), F.lit(False)) & ~shorter_words)
    whole = _scored(whole, overall)
    lists = found.union(
        whole.where(F.col("above") | shorter_words | (F.col("score") > 0))
        .where((F.col("score") > 0) | F.col("above") | (F.length("word") >= STEMS[0]))
        .select(F.col("word").alias("name"), "score")
    )
    return {r["name"]: r["score"] for r in lists.collect()}


def _scored(rows: DataFrame, overall: float) -> DataFrame:
    """Adds the ``chance`` of the toxic label under the prior ``mean``, and the ``score``.

    The standard error comes from the counts and the overall rate alone: a sharp prior of the
    stem must not make a well-known word look uncertain.
    """
    toxic = F.col("toxic") + PRIOR_WEIGHT * F.col("mean")
    clean = F.col("clean") + PRIOR_WEIGHT * (1 - F.col("mean"))
    error = F.sqrt(1 / (F.col("toxic") + PRIOR_WEIGHT * overall) + 1 / (F.col("clean") + PRIOR_WEIGHT * (1 - overall)))
    score = F.log(toxic / clean) - float(np.log(overall / (1 - overall))) - error - DRIFT
    return rows.withColumn("chance", toxic / (toxic + clean)).withColumn("score", score)


def _evidence(found: list[tuple[float, int, int]], n: int, model: ToxicityModel) -> tuple[float, float]:
    """-log10 of the chance that clean text of n words has so good a best segment; significant segments."""
    if not found:
        return 0.0, 0.0
    expected = [model.rate * max(n, 1) * float(np.exp(-model.decay * s)) for s, _, _ in found]
    best = -np.expm1(-min(expected))
    return float(min(-np.log10(max(best, 1e-30)), 30.0)), float(np.log1p(sum(e < SIGNIFICANT for e in expected)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small ridge; weights of evidence are not negative."""
    design = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.array([-2.0, 0.0, 0.0]), np.array([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + ridge * w
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(ridge), gradient)
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(max(w[1], 0.0)), float(max(w[2], 0.0))


def fit(train: DataFrame) -> ToxicityModel:
    """``train``: doc_id, text and toxic (0 or 1) of the rows to learn from, without nulls in doc_id and toxic."""
    train = train.withColumn("_turn", F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(4)))
    counted = _balanced(train.where("_turn > 0"), "count", ROWS_PER_LABEL)
    model = ToxicityModel(_log_odds(materialise(_context_counts(counted), "toxicity-counts")))
    held = _balanced(train.where("_turn = 0"), "calibrate", CALIBRATION_ROWS)
    scores = model.scores

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = remembered("word scores", dict)
        cache.clear()
        for batch in batches:
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            found = [[s for s, _, _ in segments(w, scores, cache)] for w in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array(found, pa.list_(pa.float64()))],
                ["label", "n", "found"],
            )

    rows = held.select(F.col("toxic").cast("long").alias("label"), "text").mapInArrow(scanned, "label long, n long, found array<double>")
    rows = sorted(map(tuple, rows.collect()))  # about 2 * CALIBRATION_ROWS at most
    clean = [(n, found) for label, n, found in rows if label == 0]
    excess = [s for _, found in clean for s in found]
    model.rate = (len(excess) + 0.5) / max(sum(n for n, _ in clean), 1)
    model.decay = (len(excess) + 1.0) / (sum(excess) + 1.0)
    if rows:
        x = np.array([_evidence([(s, 0, 0) for s in found], n, model) for _, n, found in rows])
        model.weights = _logistic(x, np.array([label for label, _, _ in rows], float))
    return model


def _chance(text, scores, cache, model, w):
    """Score of a text, its segments and the number of its words."""
    words = words_of(text)
    if len(cache) > KEPT_WORDS:
        cache.clear()
    found = segments(words, scores, cache)
    x = _evidence(found, len(words), model)
    return float(1 / (1 + np.exp(-(w[0] + w[1] * x[0] + w[2] * x[1])))), found, len(words)


def find_passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and ``passages``: array<struct<first_word, behind_last, score>>, significant ones."""
    scores, fields = model.scores, "doc_id long, score double, predicted int, passages array<struct<first_word:int,behind_last:int,score:double>>"
    passage = pa.struct([("first_word", pa.int32()), ("behind_last", pa.int32()), ("score", pa.float64())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = remembered("word scores", dict)
        cache.clear()
        w = model.weights
        for batch in batches:
            chances, passages = [], []
            for text in batch.column(1).to_pylist():
                chance, found, n = _chance(text, scores, cache, model, w)
                chances.append(chance)
                sure = [f for f in found if model.rate * n * np.exp(-model.decay * f[0]) < SIGNIFICANT]
                passages.append([{"first_word": a, "behind_last": b, "score": s} for s, a, b in sure])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chances, pa.float64()), pa.array([int(c >= CUTOFF) for c in chances], pa.int32()),
                 pa.array(passages, pa.list_(passage))],
                ["doc_id", "score", "predicted", "passages"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judged, fields)


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` whose score stays below the cut-off; all columns, in place."""
    at, w, scores = docs.columns.index("text"), model.weights, model.scores

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = remembered("word scores", dict)
        cache.clear()
        for batch in batches:
            chances = [_chance(t, scores, cache, model, w)[0] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([c < CUTOFF for c in chances], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def labelled(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Texts to learn from: outside the held fold, with one known label."""
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_max"))
    known = known.where((F.col("toxic") == F.col("_max")) & (fold(folds) != held)).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(known, "doc_id")


def toxicity_report(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from the labels outside the held fold and scores every text."""
    found = find_passages(docs, fit(labelled(docs, labels, folds, held)))
    held_out = F.coalesce(fold(folds) == held, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", "predicted", F.size("passages").alias("n_passages"))
