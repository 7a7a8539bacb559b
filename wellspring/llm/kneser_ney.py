"""Interpolated modified Kneser-Ney bigram model, counted in Spark, searched in mapped files.

Words are 64-bit hashes. Tasks count what they read and send sorted arrays, cut by hash range,
to one task per range; the range's words become a sorted array in the shared folder, and a
word's place in it its number. Pairs of numbers are counted the same way. A context that holds
more than its share of all tokens has its pairs dealt over all ranges by the second word, so
no task gets a frequent word's pairs alone. Workers map the arrays into memory and look up a
few million tokens at a time, in order.

Defined results: a null or empty text is its end token alone; null ids are neither learned from
nor held out; repeated rows count and are scored each time; an empty table gives an empty
table; with nothing to learn from every token has probability 1 (an alphabet of the unknown
word only). Other columns are ignored.
"""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.shared import discard, fold, materialise, scratch_path, utf8_words

#: No word of a text can hold a space, so this stands for the end (and for what lies before a text).
END = b" "
CHARS_PER_RANGE = 4_000_000
TOKENS_AT_ONCE = 1_000_000
WORDS_AT_ONCE = 1_000_000


# -- files of the shared folder ------------------------------------------------------------


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def save_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """Writes arrays one behind the other; a reader sees the whole file or none."""
    store, path = _filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).data if len(a) else b"")
            out.write(b"\0" * (-a.nbytes % 8))
    store.move(part, path)


def mapped_arrays(uri: str, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of a file, mapped and not read. A store that cannot be mapped is copied once a worker."""
    known = sys.__dict__.setdefault("_wellspring_mapped", {})
    if uri not in known:
        from pyarrow import fs

        store, path = _filesystem(uri)
        if not isinstance(store, fs.LocalFileSystem):
            folder = known.get("") or known.setdefault("", tempfile.mkdtemp(prefix="mapped-"))
            atexit.register(shutil.rmtree, folder, True)
            local = f"{folder}/{uuid.uuid4().hex}"
            fs.copy_files(path, local, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            path = local
        if len(known) > 4096:  # maps of models that are no longer asked
            known.clear()
        known[uri] = np.memmap(path, np.uint8, "r")
    raw, out = known[uri], []
    sizes = raw[: 8 * (1 + len(kinds))].view("<i8")[1:]
    at = 8 * (1 + len(kinds))
    for kind, n in zip(kinds, sizes):
        width = np.dtype(kind).itemsize * int(n)
        out.append(raw[at : at + width].view(kind))
        at += width + -width % 8
    return out


# -- counting ------------------------------------------------------------------------------


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
    return keys[first], np.add.reduceat(counts, first)


def _by_range(ranges: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows (range, bytes of each column) of arrays that are sorted by range."""
    ends = np.nonzero(np.append(ranges[1:] != ranges[:-1], True))[0] + 1 if len(ranges) else []
    start = 0
    for end in ends:
        yield (int(ranges[start]), *(c[start:end].tobytes() for c in columns))
        start = end


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] + [pa.binary()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _joined(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and more, from how many things were counted 1, 2, 3 and 4 times."""
    if not (n[0] and n[1]):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    more = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i * 0.5 for i in (1, 2, 3)]
    return [min(max(d, 0.01), i) for i, d in enumerate(more, 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Model:
    """Where the arrays lie and the few numbers that hold for the whole model."""

    WORD = ["<u8", "<i8"]  # hash, count
    STATS = ["<i8", "<f8", "<i8"]  # tokens behind the word as a context, weight of the lower order, continuations
    PAIR = ["<i8", "<u4", "<u4"]  # first << 32 | second, places of counts above 1, those counts

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.offsets = np.zeros(2**bits + 1, np.int64)  # number of the first word of each range
        self.tokens = self.types = 0
        self.hot = np.empty(0, np.int64)  # contexts whose pairs lie in all ranges
        self.pair_discounts = self.word_discounts = [0.5] * 3
        self.continuations = 0
        self.lower_weight = 1.0
        self.pair_ranges: set[int] = set()

    def word_range(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def pair_range(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        spread = np.where(np.isin(first, self.hot), _mix(second + 1), np.uint64(0))
        return ((_mix(first) >> np.uint64(8)) + spread).astype(np.uint64).view(np.int64) & (2**self.bits - 1)

    def numbers(self, words: list[bytes], with_stats: bool = False):
        """Number of each word (-1: unknown), its count and, if asked, its statistics."""
        hashes = _hashes(words)
        order = np.argsort(hashes)
        ranges = self.word_range(hashes[order])
        ids, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        stats = [np.zeros(len(words), k) for k in self.STATS] if with_stats else []
        for r in np.unique(ranges):
            if self.offsets[r] == self.offsets[r + 1]:
                continue
            mine = order[np.searchsorted(ranges, r) : np.searchsorted(ranges, r, "right")]
            known, count = mapped_arrays(f"{self.folder}/words/{r}", self.WORD)
            at = np.minimum(np.searchsorted(known, hashes[mine]), len(known) - 1)
            hit = known[at] == hashes[mine]
            mine, at = mine[hit], at[hit]
            ids[mine], counts[mine] = self.offsets[r] + at, count[at]
            if with_stats:
                for out, column in zip(stats, mapped_arrays(f"{self.folder}/stats/{r}", self.STATS)):
                    out[mine] = column[at]
        return (ids, counts, *stats)

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys, counts = first << 32 | second, np.zeros(len(first))
        ranges = self.pair_range(first, second)
        order = np.argsort(keys)
        order = order[np.argsort(ranges[order].astype(np.uint16 if self.bits <= 16 else np.int64), kind="stable")]
        ranges = ranges[order]
        for r in np.unique(ranges):
            if int(r) not in self.pair_ranges:
                continue
            mine = order[np.searchsorted(ranges, r) : np.searchsorted(ranges, r, "right")]
            known, places, more = mapped_arrays(f"{self.folder}/pairs/{r}", self.PAIR)
            at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
            hit = known[at] == keys[mine]
            mine, at = mine[hit], at[hit]
            counts[mine] = 1
            if len(places):
                where = np.minimum(np.searchsorted(places, at), len(places) - 1)
                several = places[where] == at
                counts[mine[several]] = more[where[several]]
        return counts


def _encoded(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    """Row slices of at most about ``TOKENS_AT_ONCE`` tokens: (rows, distinct words, word of each token, tokens per row)."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        known: dict[bytes, int] = {}
        flat, sizes, start = [], [], 0
        for i, text in enumerate(texts):
            words = utf8_words(text)
            words.append(END)
            flat += [known.setdefault(w, len(known)) for w in words]
            sizes.append(len(words))
            if len(flat) >= TOKENS_AT_ONCE or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), list(known), np.array(flat, np.int64), np.array(sizes)
                known, flat, sizes, start = {}, [], [], i + 1


def _contexts(tokens: np.ndarray, sizes: np.ndarray, end) -> np.ndarray:
    """What stands before each token; the end mark before the first one of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before


def _count_words(train: DataFrame, model: Model) -> None:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()

        def cut() -> Iterator[pa.RecordBatch]:
            keys, counts = _summed(_hashes(list(counted)), np.fromiter(counted.values(), np.int64, len(counted)))
            rows = list(_by_range(model.word_range(keys), keys, counts.astype("<u4")))
            if rows:
                yield _batch(rows, ["range", "keys", "counts"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counted.update(utf8_words(text))
                counted[END] += 1
                if len(counted) > WORDS_AT_ONCE:
                    yield from cut()
                    counted.clear()
        yield from cut()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _summed(_joined(pdf["keys"], "<u8"), _joined(pdf["counts"], "<u4").astype(np.int64))
        r = int(pdf["range"].iloc[0])
        save_arrays(f"{model.folder}/words/{r}", [keys, counts])
        hot = np.nonzero(counts > least_hot)[0]
        return pd.DataFrame({"range": [r], "types": [len(keys)], "tokens": [int(counts.sum())], "hot": [hot.tolist()]})

    counted = train.select("text").mapInArrow(partial, "range long, keys binary, counts binary")
    # twice the even share of one range, by the least number of tokens the ranges were made for
    least_hot = max(1, CHARS_PER_RANGE // 16)
    found = counted.groupBy("range").applyInPandas(whole, "range long, types long, tokens long, hot array<long>")
    rows = {row["range"]: row for row in found.collect()}  # one row a range
    sizes = [rows[r]["types"] if r in rows else 0 for r in range(2**model.bits)]
    model.offsets[1:] = np.cumsum(sizes)
    model.types, model.tokens = int(model.offsets[-1]), sum(row["tokens"] for row in rows.values())
    model.hot = np.array(sorted(model.offsets[r] + at for r, row in rows.items() for at in row["hot"]), np.int64)


def _count_pairs(train: DataFrame, model: Model) -> DataFrame:
    """Stores the pairs; returns their totals by word, cut by word range, with the counts of counts."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def cut() -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate(kept))
            first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
            counts = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            ranges = model.pair_range(keys >> 32, keys & 0xFFFFFFFF)
            order = np.argsort(ranges, kind="stable")
            keys, counts = keys[order], counts[order]
            columns = ((keys >> 32).astype("<u4"), (keys & 0xFFFFFFFF).astype("<u4"), counts.astype("<u4"))
            yield _batch(list(_by_range(ranges[order], *columns)), ["range", "first", "second", "counts"])

        for _, words, flat, sizes in _encoded(batches, 0):
            ids = model.numbers(words)[0]
            end = ids[words.index(END)]
            tokens = ids[flat]
            kept.append(_contexts(tokens, sizes, end) << 32 | tokens)
            if sum(map(len, kept)) >= 4 * TOKENS_AT_ONCE:
                yield from cut()
                kept = []
        if kept:
            yield from cut()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = _joined(pdf["first"], "<u4").astype(np.int64) << 32 | _joined(pdf["second"], "<u4").astype(np.int64)
        keys, counts = _summed(keys, _joined(pdf["counts"], "<u4").astype(np.int64))
        r = int(pdf["range"].iloc[0])
        several = np.nonzero(counts > 1)[0]
        save_arrays(f"{model.folder}/pairs/{r}", [keys, several.astype("<u4"), counts[several].astype("<u4")])
        first, second = keys >> 32, keys & 0xFFFFFFFF
        starts = np.nonzero(np.append(True, first[1:] != first[:-1]))[0]
        contexts = first[starts]
        sums = [np.add.reduceat(x, starts) for x in (counts, counts == 1, counts == 2, counts > 2)]
        seconds, continued = np.unique(second, return_counts=True)
        totals = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        out = []
        for ids, columns in ((contexts, sums), (seconds, [continued])):
            ranges = np.searchsorted(model.offsets, ids, "right") - 1
            local = (ids - model.offsets[ranges]).astype("<u4")
            for row in _by_range(ranges, local, *(np.asarray(c).astype("<u4") for c in columns)):
                out.append((row[0], len(columns) == 4, row[1], b"".join(row[2:]), None, r))
        out.append((-1, False, b"", b"", totals, r))
        return pd.DataFrame(out, columns=["range", "contexts", "ids", "sums", "totals", "pair_range"])

    sent = train.select("text").mapInArrow(partial, "range long, first binary, second binary, counts binary")
    made = sent.groupBy("range").applyInPandas(
        whole, "range long, contexts boolean, ids binary, sums binary, totals array<long>, pair_range long"
    )
    return materialise(made, "pair-totals")


def _word_stats(made: DataFrame, model: Model) -> None:
    """Stores per word what stands behind it, its weight of the lower order and its continuations."""
    totals = made.where("range < 0").select("totals", "pair_range").collect()  # one row a range
    model.pair_ranges = {row["pair_range"] for row in totals}
    model.pair_discounts = _discounts([sum(row["totals"][i] for row in totals) for i in range(4)])
    discounts = np.array(model.pair_discounts)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["range"].iloc[0])
        n = int(model.offsets[r + 1] - model.offsets[r])
        behind, kinds, continued = np.zeros(n, np.int64), np.zeros((3, n)), np.zeros(n, np.int64)
        for contexts, raw, sums in zip(pdf["contexts"], pdf["ids"], pdf["sums"]):
            ids = np.frombuffer(raw, "<u4")
            if contexts:
                values = np.frombuffer(sums, "<u4").reshape(4, len(ids))
                behind[ids] += values[0]
                kinds[:, ids] += values[1:]
            else:
                continued[ids] += np.frombuffer(sums, "<u4")
        weight = discounts @ kinds / np.maximum(behind, 1)
        save_arrays(f"{model.folder}/stats/{r}", [behind, weight, continued])
        of = [int((continued == i).sum()) for i in (1, 2, 3, 4)] + [int((continued > 2).sum()), int(continued.sum())]
        return pd.DataFrame({"of": [of]})

    found = made.where("range >= 0").groupBy("range").applyInPandas(whole, "of array<long>").collect()
    n = [sum(row["of"][i] for row in found) for i in range(6)]
    model.word_discounts, model.continuations = _discounts(n[:4]), n[5]
    if n[5]:
        model.lower_weight = float(np.dot(model.word_discounts, [n[0], n[1], n[4]])) / n[5]


def fit(train: DataFrame) -> Model:
    """Counts all texts of ``train`` and stores the model in the shared folder."""
    spark = train.sparkSession
    size = train.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    model = Model(scratch_path(spark, "kneser-ney"), max(4, int(np.ceil(np.log2(1 + size / CHARS_PER_RANGE)))))
    _count_words(train, model)
    if model.types:
        made = _count_pairs(train, model)
        _word_stats(made, model)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: id, fold, tokens, known tokens, add-one unigram score and the model's score (log10)."""
    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, word = (np.append(0.0, d) for d in (model.pair_discounts, model.word_discounts))
        unseen = 1.0 / (model.types + 1)
        for rows, words, flat, sizes in _encoded(batches, 2):
            ids, counts, behind, weight, continued = model.numbers(words, with_stats=True)
            base = np.log10((counts + 1) / (model.tokens + model.types + 1))
            over = np.maximum(continued - word[np.minimum(continued, 3)], 0) / max(model.continuations, 1)
            lower = over + model.lower_weight * unseen
            end = words.index(END)
            before = _contexts(flat, sizes, end)
            chance = lower[flat]
            usable = behind[before] > 0
            first, second = ids[before], ids[flat]
            asked = np.nonzero(usable & (second >= 0))[0]
            pairs = np.zeros(len(flat))
            pairs[asked] = model.pair_counts(first[asked], second[asked])
            top = np.maximum(pairs - pair[np.minimum(pairs, 3).astype(np.int64)], 0)
            context = before[usable]
            chance[usable] = top[usable] / behind[context] + weight[context] * chance[usable]
            row = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda x: np.bincount(row, x, len(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(add(counts[flat] > 0).astype(np.int64)),
                    pa.array(add(base[flat])),
                    pa.array(add(np.log10(np.minimum(chance, 1.0)))),
                ],
                [f.split()[0] for f in fields.split(", ")],
            )

    held = F.coalesce(F.col("held_out"), F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, "text").mapInArrow(scored, fields)


def language_model_report(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Learns from all folds but ``held`` and scores every text."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (fold(folds) == held).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")))
    found = materialise(score(rows, model), "language-model-scores")
    discard(spark, model.folder)
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
