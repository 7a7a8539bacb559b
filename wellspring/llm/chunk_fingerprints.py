"""Document fingerprints from content-defined chunks.

A gear hash over the UTF-8 bytes marks cut places by content, so text that moves keeps its
chunks. Normalised cutting asks for more zero bits before the usual length than after it,
within a shortest and a longest chunk. The fingerprint is the sorted set of chunk digests, each
with its length; likeness is containment, the share of a document's chunk bytes that the other
one has too.

Defined results: a null text counts as empty; two empty fingerprints are alike (1), an empty
and another are not (0); rows with equal ids follow each other by text; null ids come after all
others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.shared import let

SHORTEST, USUAL, LONGEST = 16, 64, 256
STRICT_BITS, LOOSE_BITS, WINDOW = 7, 5, 32
AT_ONCE = 1 << 20
CHARS_PER_PART = 8_000_000


def _gear() -> np.ndarray:
    """One pseudorandom 32-bit number for each byte, by a fixed rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(2**64 - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def _candidates(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Places behind which the strict and the loose condition hold."""
    strict, loose = [], []
    for start in range(0, len(data), AT_ONCE):
        before = min(start, WINDOW)
        h = GEAR[data[start - before : start + AT_ONCE]]
        span = 1
        while span < WINDOW:  # sum of gear numbers, each shifted by its distance, over 2 * span bytes
            h[span:] += h[:-span] << np.uint32(span)
            span *= 2
        at = np.nonzero((h >> np.uint32(32 - LOOSE_BITS)) == 0)[0]
        at = at[at >= before]
        tight = at[(h[at] >> np.uint32(32 - STRICT_BITS)) == 0]
        loose += (at + (start - before + 1)).tolist()
        strict += (tight + (start - before + 1)).tolist()
    return strict, loose


def chunk_ends(data: bytes) -> list[int]:
    strict, loose = _candidates(np.frombuffer(data, np.uint8))
    ends, start, n = [], 0, len(data)
    i = j = 0
    while start < n:
        end = min(start + LONGEST, n)
        i = bisect_left(strict, start + SHORTEST, i)
        if i < len(strict) and strict[i] < start + USUAL:
            end = min(end, strict[i])
        else:
            j = bisect_left(loose, start + USUAL, j)
            if j < len(loose):
                end = min(end, loose[j])
        ends.append(end)
        start = end
    return ends


def fingerprint(text: str) -> np.ndarray:
    """Sorted distinct chunks: 48 bits of digest, then 16 bits of length."""
    from xxhash import xxh3_64_intdigest

    data = text.encode("utf-8", "surrogatepass")
    found, start = set(), 0
    for end in chunk_ends(data):
        found.add((xxh3_64_intdigest(data[start:end]) & 0xFFFFFFFFFFFF) << 16 | (end - start))
        start = end
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the bytes of a's chunks that b has too."""
    if not len(a):
        return float(not len(b))
    low = np.uint64(0xFFFF)
    return float((np.intersect1d(a, b, assume_unique=True) & low).sum() / (a & low).sum())


def as_text(found: np.ndarray) -> str:
    return base64.b64encode(found.astype(">u8").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The second half replaced by the start of the following text."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def _part_of(doc_id: Column, cuts: list[int]) -> tuple[Column, Column]:
    """Place of the last of the descending cuts that is not below the id, and whether it is the id.

    The cuts are literals in groups of about their square root, so a row looks at two short arrays.
    """
    size = isqrt(len(cuts)) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    listed = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")"
    heads, all_groups = F.expr(listed(g[0] for g in groups)), F.expr("array(" + ", ".join(map(listed, groups)) + ")")
    reached = lambda xs: F.size(F.filter(xs, lambda c: c >= doc_id))
    group = F.greatest(reached(heads) - 1, F.lit(0))  # an unknown id reaches none
    inside = let(group, lambda g: reached(F.element_at(all_groups, g + 1)) - 1)
    begins = let(group, lambda g: F.array_contains(F.element_at(all_groups, g + 1), doc_id))
    return group * size + inside, begins


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows in partitions by descending id; each part also gets the row that follows its last one.

    The cuts are ids that occur, so a part begins with its cut, and sending the rows of the next
    cut to the part before it is enough. The last part is followed by the largest id.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text").cast("long")), F.max("doc_id")).first()
    parts = max(1, -(-(size[0] or 0) // CHARS_PER_PART))
    largest = size[1]
    cuts: list[int] = []
    if largest is not None:
        shares = [k / parts for k in range(1, parts)]
        if shares:
            cuts = rows.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] or []
        cuts = sorted({*cuts, largest}, reverse=True)
    last = max(0, len(cuts) - 1)
    own, begins = _part_of(F.col("doc_id"), cuts) if cuts else (F.lit(0), F.lit(False))
    own = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(own)
    # the part that this row follows, for rows that begin a part
    behind = F.when(begins, F.when(own == 0, F.lit(last)).otherwise(own - 1))
    places = F.array(F.struct(own.alias("part"), F.lit(False).alias("only_follows")),
                     F.struct(behind.alias("part"), F.lit(True).alias("only_follows")))
    dealt = rows.withColumn("_at", F.explode_outer(places)).where("_at.part IS NOT NULL")
    dealt = dealt.select(F.col("_at.part").alias("part"), F.col("_at.only_follows").alias("only_follows"), "doc_id", "text")
    return dealt.repartition(max(1, len(cuts)), "part").sortWithinPartitions(
        "part", "only_follows", F.desc_nulls_last("doc_id"), "text"
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike they and the next one are."""
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def row(doc_id, text, own, following, next_print) -> tuple:
        changed = edited(text, following)
        other = fingerprint(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(text), digest, as_text(own), as_text(other), containment(own, other), containment(own, next_print))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def rows() -> Iterator[tuple]:
            part = first = held = None  # held: the row that waits for the one behind it
            closed = False
            for batch in batches:
                for at, follows, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if at != part:
                        if held is not None and not closed:
                            yield row(*held, first[1], first[2])
                        part, first, held, closed = at, None, None, False
                    if closed:
                        continue
                    own = fingerprint(text)
                    if held is not None:
                        yield row(*held, text, own)
                    closed = follows
                    held = (doc_id, text, own)
                    first = first or held
            if held is not None and not closed:
                yield row(*held, first[1], first[2])

        some = []
        for r in rows():
            some.append(r)
            if len(some) == 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    return _in_order(docs).mapInArrow(told, schema)
