"""Near duplicates by 64-bit similarity hashes, compared exactly in tiles.

Equal hashes are one class before anything is compared. Each distinct hash belongs to the cell
of its four population counts (16 bits each). Two hashes within ``RADIUS`` bits differ by at
most ``RADIUS`` in the sum over the four counts, so only tiles of cells that near are met; all
other pairs of tiles are skipped unseen. A cell of many hashes is cut into tiles of about
``TILE``, so no task holds a large cell. A pair of tiles is one row of an equi-join; numpy
compares it by exclusive-or and bit counts and returns no more links than it has hashes (one
star for each group that hangs together there), so a dense group gives no square of links.

Defined results: null and empty texts, and texts of white space, have hash zero and are linked
like any other; repeated rows each get a row; a null id never names a class unless all ids of
the class are null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.components import connected_components
from wellspring.llm.shared import ROW_KEY, materialise, utf8_words, with_row_key

SHINGLE, SEED, RADIUS, TILE, LANES, LANE_BITS = 3, 42, 2, 512, 4, 16
SIDE = LANE_BITS + 1
AT_ONCE = 1 << 16


def text_hash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit similarity hash of one text."""
    from xxhash import xxh64_intdigest

    words = utf8_words(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, AT_ONCE):
        some = words[i : i + AT_ONCE + shingle - 1]
        count = min(AT_ONCE, n - i)
        joined = map(b" ".join, zip(*(some[k:] for k in range(shingle)))) if len(some) >= shingle else [b" ".join(some)]
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in joined), np.uint64, count)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(count, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def text_hashes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, the columns of the row key and ``hash`` of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_hash(t, shingle) for t in batch.column(4).to_pylist()]
            columns = [*(batch.column(i) for i in range(4)), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *ROW_KEY, "hash"])

    rows = with_row_key(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *ROW_KEY, "text")
    return rows.mapInArrow(hashed, "doc_id long, _known boolean, _id long, _text_key long, hash long")


def _cells(nodes: DataFrame) -> DataFrame:
    counts = [
        F.bit_count(F.shiftrightunsigned("hash", LANE_BITS * k).bitwiseAND(F.lit(2**LANE_BITS - 1))) for k in range(LANES)
    ]
    cell = F.lit(0)
    for k, count in enumerate(counts):
        cell = cell + count * SIDE**k
    return nodes.withColumn("cell", cell.cast("int"))


def _near_cells(sizes: DataFrame) -> DataFrame:
    """Pairs of cells (``cell`` <= ``other``) that may hold hashes within the radius, with their tiles."""
    shifts = [d for d in product(range(-RADIUS, RADIUS + 1), repeat=LANES) if sum(map(abs, d)) <= RADIUS]
    steps = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in shifts]))
    moved = sizes.select("cell", "tiles", steps.alias("d"))
    other, inside = F.lit(0), F.lit(True)
    for k in range(LANES):
        count = F.floor(F.col("cell") / SIDE**k).cast("int") % SIDE + F.col(f"d.d{k}")
        other, inside = other + count * SIDE**k, inside & count.between(0, LANE_BITS)
    moved = moved.where(inside).select("cell", "tiles", other.cast("int").alias("other")).where("other >= cell")
    right = sizes.select(F.col("cell").alias("other"), F.col("tiles").alias("other_tiles"))
    return moved.join(right, "other")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star links of every group that hangs together within one pair of tiles."""
    for batch in batches:
        us, vs = [], []
        for i in range(batch.num_rows):
            a = batch.column(0)[i].values.to_numpy(zero_copy_only=False)
            b = batch.column(1)[i].values.to_numpy(zero_copy_only=False)
            near = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= RADIUS
            rows, columns = np.nonzero(near)
            if not len(rows):
                continue
            differ = a[rows] != b[columns]
            rows, columns = rows[differ], columns[differ]
            if not len(rows):
                continue
            left, right = np.arange(len(a)), np.full(len(b), len(a))
            while True:  # smallest row number that reaches each hash
                before = left.copy()
                np.minimum.at(right, columns, left[rows])
                np.minimum.at(left, rows, right[columns])
                if (before == left).all():
                    break
            for values, centre in ((a[rows], a[left[rows]]), (b[columns], a[right[columns]])):
                pair = np.unique(np.stack([values, centre]), axis=1)
                pair = pair[:, pair[0] != pair[1]]
                us.append(pair[0])
                vs.append(pair[1])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def near_links(hashes: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct hashes within the radius; ``hashes`` has distinct ``hash``."""
    cells = _cells(hashes.select("hash"))
    # at most 17 ** 4 cells whatever the input, so this table may be broadcast
    sizes = materialise(
        cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "simhash-cells"
    )
    placed = cells.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("hash"), F.col("tiles")).cast("int"))
    tiles = materialise(placed.groupBy("cell", "tile").agg(F.collect_list("hash").alias("hashes")), "simhash-tiles")
    pairs = _near_cells(sizes).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.withColumn("other_tile", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    pairs = pairs.where((F.col("other") > F.col("cell")) | (F.col("other_tile") >= F.col("tile")))
    right = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("other_tile"), F.col("hashes").alias("other_hashes"))
    # the planner takes the pairs, made from few cells, for small: they must not be broadcast
    left = pairs.select("cell", "tile", "other", "other_tile").join(tiles.hint("merge"), ["cell", "tile"])
    met = left.join(right.hint("merge"), ["other", "other_tile"])
    return met.select("hashes", "other_hashes").mapInArrow(_links, "u long, v long").distinct()


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, row key, ``hash``, ``component_id`` (smallest id of the class) and ``class`` of every row.

    ``class`` is a hash of the class and, unlike the id, never null.
    """
    hashes = materialise(text_hashes(docs), "simhash")
    nodes = materialise(hashes.groupBy("hash").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    linked = materialise(connected_components(near_links(nodes)), "simhash-linked")
    roots = nodes.join(linked.withColumnRenamed("node", "hash"), "hash")
    smallest = roots.groupBy("root").agg(F.min("first").alias("_least"))
    named = roots.join(smallest, "root").select("hash", "root", "_least")
    classes = nodes.join(named, "hash", "left").select(
        "hash",
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("_least")).alias("component_id"),
        F.coalesce("root", "hash").alias("class"),
    )
    # stored, so that the last join has plain exchanges on both sides and a hot hash can be split
    classes = materialise(classes, "simhash-classes")
    return hashes.join(classes, "hash").select("doc_id", *ROW_KEY, "hash", "component_id", "class")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class: the smallest id, and of equal ids the smallest text key."""
    keyed = with_row_key(docs)
    least = F.min(F.struct((~F.col("_known")).alias("unknown"), "_id", "_text_key")).alias("k")
    kept = near_duplicate_classes(docs).groupBy("class").agg(least)
    kept = kept.select((~F.col("k.unknown")).alias("_known"), F.col("k._id").alias("_id"), F.col("k._text_key").alias("_text_key"))
    return keyed.join(kept, ROW_KEY).dropDuplicates(ROW_KEY).select(*docs.columns)


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicate_classes(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("hash")), 16, "0").alias("fingerprint"), "component_id"
    )
