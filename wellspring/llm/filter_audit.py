"""How filters interact, from a sparse document-term matrix.

Tasks cut their documents into shards of about ``SHARD_BYTES`` of text or ``SHARD_ROWS`` rows. A shard holds its part
of the matrix in compressed sparse rows (row starts, columns, counts) over a local dictionary of
its words, and lists its distinct texts by digest with the least id of each. Words are then
encoded globally: they are dealt by hash, and a word's number is its rank in its hash bucket,
so a word has one number in all shards. Local numbers are exchanged for global ones shard by
shard, which gives the rows of the matrix: a row's sum is its number of words, its nonzero
entries the distinct ones. Digests are met the same way: the least id over all shards tells
whether a text was seen under a smaller id.

A shard carries at most one row per word and per text into these exchanges, so neither a word
in every document nor a text that is a third of the table gathers its documents in one task.
What the filters do in all orders then follows from the counts of each set of failed filters,
at most 32 a part.

Defined results: a null text is empty (no words; fails A only, and E if an empty text has a
smaller id); a null source is the part with the empty name; a null id is smaller than none and
has none smaller, and no label; repeated rows are documents of their own, equal ids are not smaller than each
other; an id with several labels counts as good (or toxic) if any of them says so; an empty
table has no parts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.shared import scratch_path

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5  # words; per cent of the words; per cent of the signs
SYMBOLS = b"#$%&*|"
CAPITALS, FOLLOWING = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0x80, 0xC0))
SHARD_BYTES, SHARD_ROWS = 16 << 20, 1 << 16
WORD_BUCKETS = 1 << 20  # a bucket holds few words, so sorting by bucket orders nearly all
MATRIX, WORD, TEXT = 0, 1, 2
SHARDS = (
    "shard long, kind int, local int, key binary, first long, ids array<long>, parts array<string>, "
    "flags binary, texts binary, starts binary, columns binary, counts binary"
)


def compressed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes apart, since most high bytes are zero."""
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(values.view("u1").reshape(-1, 4).T.tobytes())


def decompressed(data: bytes) -> np.ndarray:
    from zstandard import ZstdDecompressor

    planes = np.frombuffer(ZstdDecompressor().decompress(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _Shard:
    """Rows of the matrix under a local dictionary."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.texts: dict[bytes, int] = {}
        self.firsts: list[int | None] = []
        self.ids, self.parts, self.flags, self.text_of = [], [], [], []
        self.lengths, self.columns, self.counts = [], [], []
        self.size = 0

    def add(self, doc_id: int | None, part: str, text: bytes) -> None:
        found = Counter(text.split())  # bytes know the six ASCII spaces only
        columns = np.fromiter(map(self.words.__getitem__, found), np.uint32, len(found))
        order = columns.argsort()
        self.columns.append(np.diff(columns[order], prepend=np.uint32(0)))  # gaps of a row, which compress well
        self.counts.append(np.fromiter(found.values(), np.uint32, len(found))[order])
        self.lengths.append(len(found))
        points = len(text.translate(None, FOLLOWING))
        capitals = len(text) - len(text.translate(None, CAPITALS))
        symbols = len(text) > len(text.translate(None, SYMBOLS))
        self.flags.append((100 * capitals > MOST_CAPITALS * points) << 2 | symbols << 3)
        at = self.texts.setdefault(hashlib.sha256(text).digest(), len(self.texts))
        if at == len(self.firsts):
            self.firsts.append(doc_id)
        elif doc_id is not None:
            self.firsts[at] = doc_id if self.firsts[at] is None else min(doc_id, self.firsts[at])
        self.ids.append(doc_id)
        self.parts.append(part)
        self.text_of.append(at)
        self.size += len(text)

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        """One row with the matrix, one for each word and one for each text."""
        empty = lambda n: [None] * n
        packed = lambda parts, kind: compressed(np.concatenate(parts or [np.empty(0, kind)]).astype(kind))
        starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype("<i8")
        yield self._batch(
            [number], [MATRIX], [None], [None], [None], [self.ids], [self.parts], [bytes(self.flags)],
            [np.array(self.text_of, "<u4").tobytes()], [starts.tobytes()], [packed(self.columns, "<u4")], [packed(self.counts, "<u4")],
        )
        for kind, keys, firsts in ((WORD, list(self.words), None), (TEXT, list(self.texts), self.firsts)):
            for i in range(0, len(keys), 1 << 16):
                some = keys[i : i + (1 << 16)]
                n = len(some)
                yield self._batch(
                    [number] * n, [kind] * n, range(i, i + n), some, firsts[i : i + n] if firsts else empty(n), *(empty(n) for _ in range(7))
                )

    @staticmethod
    def _batch(*columns) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 5]
        names = [field.split()[0] for field in SHARDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def write_shards(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stores the shards of ``docs`` (doc_id, source, text) with their local dictionaries."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                for row in zip(*(some.column(i).to_pylist() for i in range(3))):
                    shard.add(*row)
                    if shard.size >= shard_bytes or len(shard.ids) >= SHARD_ROWS:
                        yield from shard.batches(part << 32 | seq)
                        shard, seq = _Shard(), seq + 1
        if shard.ids:
            yield from shard.batches(part << 32 | seq)

    none = F.lit("")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), none).alias("part"),
        F.coalesce("text", none).cast("binary").alias("text"),
    )
    rows.mapInArrow(cut, SHARDS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(SHARDS).parquet(path)


def global_numbers(shards: DataFrame) -> DataFrame:
    """``shard``, ``kind``, ``local`` and the ``value`` that it stands for.

    For a word that is its number, the same in all shards; for a text the least id it has anywhere.
    """
    words = shards.where(F.col("kind") == WORD).select("shard", "local", "key")
    words = words.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(WORD_BUCKETS)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("key"))
    words = words.withColumn("value", (rank - 1).cast("long") * WORD_BUCKETS + F.col("bucket"))
    texts = shards.where(F.col("kind") == TEXT).select("shard", "local", "key", "first")
    texts = texts.withColumn("value", F.min("first").over(Window.partitionBy("key")))
    columns = lambda rows, kind: rows.select("shard", F.lit(kind).alias("kind"), "local", "value")
    return columns(words, WORD).union(columns(texts, TEXT))


def _nonzero(columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of distinct columns of each row. A shard has at most ``SHARD_ROWS`` rows, so row and column fit 63 bits."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    entries = np.sort(rows << 46 | columns)
    first = np.ones(len(entries), bool)
    first[1:] = entries[1:] != entries[:-1]
    return np.bincount(entries[first] >> 46, minlength=len(starts) - 1)


def matrix_rows(shards: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``part``, ``n_words``, ``n_distinct`` and the bits of its failed filters, ``mask``."""

    def encoded(matrix: pa.Table, numbers: pa.Table) -> pa.Table:
        row = {name: matrix.column(name)[0] for name in ("ids", "parts", "flags", "texts", "starts", "columns", "counts")}
        kind, local = (numbers.column(c).to_numpy() for c in ("kind", "local"))
        value, null = numbers.column("value").fill_null(0).to_numpy(), numbers.column("value").is_null().to_numpy()
        words, texts = kind == WORD, kind == TEXT
        number = np.zeros(int(words.sum()), np.int64)
        number[local[words]] = value[words]
        first, unknown = np.zeros(int(texts.sum()), np.int64), np.ones(int(texts.sum()), bool)
        first[local[texts]], unknown[local[texts]] = value[texts], null[texts]
        read = lambda name, kind: np.frombuffer(row[name].as_py(), kind)
        starts, counts = read("starts", "<i8"), decompressed(row["counts"].as_py()).astype(np.int64)
        passed = np.concatenate([[0], np.cumsum(decompressed(row["columns"].as_py()), dtype=np.int64)])
        local_columns = passed[1:] - np.repeat(passed[starts[:-1]], np.diff(starts))
        columns = number[local_columns]  # of the global matrix
        total = np.concatenate([[0], np.cumsum(counts)])
        sums = total[starts[1:]] - total[starts[:-1]]
        nonzero = _nonzero(columns, starts)
        ids = row["ids"].values
        known, doc_id = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        text = read("texts", "<u4")
        seen = known & ~unknown[text] & (first[text] < doc_id)
        mask = (sums < LEAST_WORDS) | (100 * nonzero < LEAST_DISTINCT * sums) << 1 | read("flags", "u1") | seen.astype(np.int64) << 4
        return pa.table(
            {"doc_id": ids, "part": row["parts"].values, "n_words": pa.array(sums, pa.int64()),
             "n_distinct": pa.array(nonzero, pa.int64()), "mask": pa.array(mask, pa.int32())}
        )

    matrix = shards.where(F.col("kind") == MATRIX).select("shard", "ids", "parts", "flags", "texts", "starts", "columns", "counts")
    paired = matrix.groupBy("shard").cogroup(global_numbers(shards).groupBy("shard"))
    return paired.applyInArrow(encoded, "doc_id long, part string, n_words long, n_distinct long, mask int")


def failures(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``matrix_rows`` of ``docs``: which filters each document fails, whatever the order."""
    return matrix_rows(write_shards(docs, scratch_path(docs.sparkSession, "term-shards"), shard_bytes))


def _steps() -> str:
    """Every order and step: the bit of its filter and those of the filters before it, as JSON."""
    rows = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(letter) for letter in order]
        rows += [{"o": "".join(order), "s": i + 1, "b": b, "e": sum(bits[:i])} for i, b in enumerate(bits)]
    return json.dumps(rows)


def interactions(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: what the step keeps and removes, and what of it other filters remove too."""
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = failed.join(marked, failed["doc_id"] == marked["_id"], "left")
    sets = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    sets = sets.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))
    steps = F.from_json(F.lit(_steps()), "array<struct<o:string,s:int,b:int,e:int>>")
    steps = sets.withColumn("at", F.explode(steps)).select("part", "sets", "at.*")

    def total(chosen, name: str = "n"):
        picked = F.transform(F.filter("sets", chosen), lambda x: F.coalesce(x[name], F.lit(0).cast("long")))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)

    has = lambda x, bits: x["mask"].bitwiseAND(bits) != 0
    bit, earlier = F.col("b"), F.col("e")
    removed = lambda x: has(x, bit) & ~has(x, earlier)
    counted = steps.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), "b",
        total(lambda x: ~has(x, bit.bitwiseOR(earlier))).alias("kept"),
        total(removed).alias("removed"),
        total(lambda x: has(x, bit) & has(x, earlier)).alias("redundant"),
        total(lambda x: x["mask"] == bit).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "b"))  # 120 rows each
    return counted.withColumn("shapley", shapley).drop("b")


def filter_audit(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The interactions of the five filters over all of ``docs``, for each source."""
    return interactions(failures(docs, shard_bytes), labels)
