"""Merkle manifest of a dataset as an append log in postorder.

Leaves are digests of rows. The leaves of a language, in the order of their ids, make a tree,
and the roots of the languages one more. A tree's nodes stand in a log in the order in which
they are completed: node i of level L covers leaves up to j = min((i + 1) 2^L, n) - 1 and is
completed with leaf j, so its place is 2 j - ones(j) + L, where ones(j) counts the set bits of j:
before leaf j there are j leaves and j - ones(j) inner nodes. The places of siblings follow
from the same formula, and a proof is read from the log without a search.

Builders work on aligned runs of ``RUN`` nodes of a tree: the subtree of a run is a segment of
the log, written by one task. The roots of the segments are the nodes of the next round; three
rounds cover ``RUN`` cubed leaves. Proofs are extracted from the top down: a segment joins the
path of its root and adds the siblings inside it, so no upper node is looked up once a leaf.

Leaves are ranked by a range shuffle of digests; a language with most of the rows is spread
over ranges like any other.

Defined results: nulls of any column have an encoding of their own; a null language is the
first tree; null ids come first, rows with equal ids are ordered by their digest and identical
rows all count; an empty table has no tree and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wellspring.llm.shared import materialise

LEVELS = 12
RUN = 1 << LEVELS  # nodes of a builder
TAMPER = 7
MOST_BROADCAST = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "tree long, n long, block long, ids array<long>, changed array<string>, log binary, top string"


def place(level: int, i: int, n: int) -> int:
    """Place of node ``i`` of ``level`` in the log of a tree (or run) of ``n`` leaves."""
    j = min((i + 1) << level, n) - 1
    return 2 * j - j.bit_count() + level


def height(n: int) -> int:
    return (n - 1).bit_length()


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def append_log(leaves: list[str], levels: int) -> list[str]:
    """Nodes of one run in the order of completion; a node without a right sibling is hashed alone."""
    n, log = len(leaves), []
    for j, leaf in enumerate(leaves):
        log.append(leaf)
        level, i = 0, j
        while level < levels and (i & 1 or j == n - 1):
            left = log[place(level, i - 1, n)] if i & 1 else ""
            log.append(digest(left + log[-1]))
            level, i = level + 1, i >> 1
    return log


def siblings(log: list[str], i: int, n: int, levels: int) -> list[str]:
    """Path from leaf ``i`` to the top of its run: side and digest of each sibling, or an empty string."""
    path = []
    for level in range(levels):
        other = i ^ 1
        if i & 1:
            path.append("L" + log[place(level, other, n)])
        else:
            path.append("R" + log[place(level, other, n)] if other << level < n else "")
        i >>= 1
    return path


def fold(node: str, path: list[str]) -> str:
    """The root that a leaf and the siblings of its path lead to."""
    for step in path:
        node = digest(step[1:] + node if step[:1] == "L" else node + step[1:])
    return node


def proof_digest(path: list[str]) -> str:
    return digest("".join(step[1:] for step in path))


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**replaced: Column) -> Column:
    return F.sha2(F.concat(*[encoded(replaced.get(name, F.col(name))) for name in FIELDS]), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``leaf`` and ``changed``, the leaf after tampering where there is any."""
    # a decimal, since the largest long has a successor too
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    changed = F.when(hit & F.col("n_chars").isNotNull(), leaf_digest(n_chars=more))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_digest().alias("leaf"), changed.alias("changed"))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``rank`` within ``group`` (from 0) and its size ``n``, by ranges and sums of their sizes."""
    # rows that are equal in all keys are told apart, so that they need not share a range
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    keys = [group, *order, "_row"]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    at = sorted_rows.columns.index(group)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = object(), 0
        for batch in batches:
            places = np.empty(batch.num_rows, np.int64)
            for i, value in enumerate(batch.column(at).to_pylist()):
                last, seen = value, seen + 1 if value == last else 0
                places[i] = seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], [*batch.schema.names, "_place"])

    placed = sorted_rows.mapInArrow(counted, StructType([*sorted_rows.schema.fields, StructField("_place", LongType())]))
    placed = materialise(placed, "merkle-places")
    sizes = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
    )
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes
    met = placed.join(sizes, placed[group].eqNullSafe(F.col("_group")) & (placed["_part"] == F.col("_of")))
    return met.select(*[c for c in rows.columns if c != "_row"], (F.col("_before") + F.col("_place")).alias("rank"), "n")


def build(nodes: DataFrame) -> list[DataFrame]:
    """Segments of the logs, one table a round. ``nodes``: tree, n, rank, node, doc_id, changed."""

    def segment(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("rank", "node", "doc_id", "changed"))), key=lambda r: r[0])
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        log = append_log([r[1] for r in rows], LEVELS if n > RUN else height(n))
        return pa.table(
            {"tree": [tree], "n": pa.array([n], pa.int64()), "block": [rows[0][0] >> LEVELS],
             "ids": pa.array([[r[2] for r in rows]], pa.list_(pa.int64())),
             "changed": pa.array([[r[3] for r in rows]], pa.list_(pa.string())),
             "log": [bytes.fromhex("".join(log))], "top": [log[-1]]}
        )

    rounds = []
    while True:
        runs = nodes.withColumn("_block", F.shiftright("rank", LEVELS)).groupBy("tree", "_block")
        rounds.append(materialise(runs.applyInArrow(segment, SEGMENT), "merkle-log"))
        more = rounds[-1].where(F.col("n") > RUN)
        if more.isEmpty():
            return rounds
        nodes = more.select(
            "tree", F.ceil(F.col("n") / RUN).cast("long").alias("n"), F.col("block").alias("rank"), F.col("top").alias("node"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("changed"),
        )


def _levels(n: int) -> int:
    return LEVELS if n > RUN else height(n)


def _nodes(log: bytes) -> list[str]:
    text = log.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The segments of the first round with what lies above them: ``path``, ``subroot`` and ``root``.

    ``above``: for each tree ``_tree``, the ``path`` of its root and the ``root`` that this leads to.
    """

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, n, block, ids, log, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
                nodes, levels, size = _nodes(log), _levels(n), len(ids)
                yield pa.RecordBatch.from_pydict(
                    {"_tree": pa.array([tree] * size, pa.int64()), "_block": pa.array(range(block * RUN, block * RUN + size), pa.int64()),
                     "path": pa.array([siblings(nodes, i, size, levels) + path for i in range(size)], pa.list_(pa.string())),
                     "subroot": [subroot] * size, "root": [root] * size}
                )

    upper = None
    for segments in reversed(rounds):
        tops = segments.where(F.col("n") <= RUN)
        met = tops.join(above, tops["tree"] == above["_tree"]).withColumn("subroot", F.col("top"))
        met = met.select(*segments.columns, "path", "subroot", "root")
        if upper is not None:
            rest = segments.where(F.col("n") > RUN)
            rest = rest.join(upper, (rest["tree"] == upper["_tree"]) & (rest["block"] == upper["_block"]))
            met = met.union(rest.select(*segments.columns, "path", "subroot", "root"))
        columns = "_tree long, _block long, path array<string>, subroot string, root string"
        upper = met.select("tree", "n", "block", "ids", "log", "path", "subroot", "root").mapInArrow(below, columns)
    return met


def manifest(docs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Segments of the languages' logs, and for each tree the path from its root to the root of all."""
    leaves = ranked(leaves_of(docs), "lang", "doc_id", "leaf")
    leaves = materialise(leaves, "merkle-leaves")
    trees = ranked(leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0)), "_all", "lang")
    trees = materialise(trees.select("lang", F.col("rank").alias("tree")), "merkle-trees")
    names = trees.withColumnRenamed("lang", "_lang")
    names = F.broadcast(names) if names.count() <= MOST_BROADCAST else names
    nodes = leaves.join(names, leaves["lang"].eqNullSafe(names["_lang"]))
    rounds = build(nodes.select("tree", "n", "rank", F.col("leaf").alias("node"), "doc_id", "changed"))
    tops = rounds[0].where(F.col("n") <= RUN).select("tree", "top")
    for segments in rounds[1:]:
        tops = tops.union(segments.where(F.col("n") <= RUN).select("tree", "top"))
    n = trees.count()
    of_trees = build(
        tops.select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("tree").alias("rank"),
                    F.col("top").alias("node"), F.col("tree").alias("doc_id"), F.lit(None).cast("string").alias("changed"))
    )
    start = of_trees[-1].where(F.col("n") <= RUN).select(
        F.col("tree").alias("_tree"), F.array().cast("array<string>").alias("path"), F.col("top").alias("root")
    )
    met = paths(of_trees, start)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, log, path, root in zip(*(c.to_pylist() for c in batch.columns)):
                nodes, levels = _nodes(log), _levels(n)
                yield pa.RecordBatch.from_pydict(
                    {"_tree": pa.array(ids, pa.int64()), "root": [root] * len(ids),
                     "path": pa.array([siblings(nodes, i, len(ids), levels) + path for i in range(len(ids))], pa.list_(pa.string()))}
                )

    above = met.select("n", "ids", "log", "path", "root").mapInArrow(each, "_tree long, root string, path array<string>")
    return rounds, materialise(above, "merkle-above")


def manifest_report(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, the roots, its proof and whether the perhaps tampered row leads to the root."""
    rounds, above = manifest(docs)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, changed, log, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
                nodes, levels, size = _nodes(log), _levels(n), len(ids)
                leaves = [nodes[place(0, i, size)] for i in range(size)]
                whole = [siblings(nodes, i, size, levels) + path for i in range(size)]
                folded = [fold(c or leaf, p) for c, leaf, p in zip(changed, leaves, whole)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(ids, pa.int64()), "leaf": leaves, "subroot": [subroot] * size, "root": [root] * size,
                     "proof_sha256": [proof_digest(p) for p in whole], "folded_root": folded, "verified": [f == root for f in folded]}
                )

    columns = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return paths(rounds, above).select("n", "ids", "changed", "log", "path", "subroot", "root").mapInArrow(verified, columns)
