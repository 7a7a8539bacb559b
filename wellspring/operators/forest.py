"""Random forest of Gini trees over binned features.

The training rows are binned once: a byte a feature, which also holds the class, in files of the shared folder.
A task grows whole trees level by level over these files, which it maps and does not read into memory, so nothing
moves between tasks but finished trees. A level's histograms are counted for so many nodes at once as fit ``CELLS``.

Every tree draws a Poisson number of copies of each row from a hash of the row, and histograms count copies by class,
so the trees depend neither on the layout of the rows nor on the order of sums. Equal rows draw alike. Bin edges are
quantiles of all rows, or of about ``POOL`` rows chosen by hash where there are more.
"""

from __future__ import annotations

import atexit
import json
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.functions.values import col
from wellspring.operators import imputation
from wellspring.session import discard, scratch_path

BINS = 32
POOL = 20_000
BLOCK_ROWS = 65_536
CHUNK_ROWS = 16_384
CELLS = 8_000_000
SMALLEST_LEAF = 2
CLOSED = np.uint16(65_535)
POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])
DEEPEST = 15  # a tree has fewer than 65,535 nodes
TREE = "tree long, file string, importance array<double>"
# of a tree: first child, feature and cut of each node in one number, the row of its chances, these, and the levels
TREE_KINDS = ("<i8", "<i4", "<f4", "<i4")


# -- files of the shared folder --------------------------------------------------


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


def _write(uri: str, *arrays: np.ndarray) -> None:
    """Arrays one behind the other, their sizes in bytes first; a reader sees the whole file or none."""
    store, path = _store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.array([a.nbytes for a in arrays], "<i8").tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    store.move(part, path)


def _mapped(uri: str, kinds: Sequence) -> list[np.ndarray]:
    """The arrays of a file, mapped and not read. A store that cannot be mapped is copied once a worker."""
    from pyarrow import fs

    store, path = _store(uri)
    if not isinstance(store, fs.LocalFileSystem):
        copies = sys.__dict__.setdefault("_wellspring_copies", {})
        if not copies:
            copies[""] = tempfile.mkdtemp(prefix="mapped-")
            atexit.register(shutil.rmtree, copies[""], True)
        if uri not in copies:
            local = f"{copies['']}/{uuid.uuid4().hex}"
            fs.copy_files(path, local, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            copies[uri] = local
        path = copies[uri]
    raw = np.memmap(path, np.uint8, "r")
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, raw[:at].view("<i8")):
        out.append(raw[at : at + size].view(kind))
        at += int(size) + -int(size) % 8
    return out


# -- bins ----------------------------------------------------------------------------


def edges_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins - 1`` rising cuts between neighbouring values; a value up to a cut lies below it."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) > bins:
        upto = np.cumsum(counts)
        at = np.unique(np.searchsorted(upto, np.arange(1, bins) * (upto[-1] / bins)))
        at = at[at < len(found) - 1]
    else:
        at = np.arange(len(found) - 1)
    low, high = found[at], found[at + 1]
    middle = low / 2 + high / 2
    # between neighbouring numbers the middle may round to the higher one
    return np.where((middle >= low) & (middle < high), middle, low)


def _numbers(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    if np.isnan(values).any():
        raise ValueError("a feature has no value: impute the rows before a fit or a prediction")
    return values


def binned(columns: Iterable[pa.Array], edges: Sequence[np.ndarray], rows: int) -> np.ndarray:
    """Rows by features: the number of cuts below each value."""
    out = np.empty((rows, len(edges)), np.uint8)
    for i, (column, cuts) in enumerate(zip(columns, edges)):
        out[:, i] = np.searchsorted(cuts, _numbers(column), side="left")
    return out


def _blocks(rows: DataFrame, edges: list[np.ndarray], classes: int, folder: str) -> list[tuple[str, int]]:
    """Files with the hashes and codes (bin times classes plus class) of the rows: name and rows of each."""
    kind = np.uint8 if BINS * classes <= 256 else np.uint16

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stored() -> pa.RecordBatch:
            name, n = f"{folder}/{uuid.uuid4().hex}", sum(len(h) for h, _ in held)
            _write(name, np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            code = binned(batch.columns[2:], edges, batch.num_rows).astype(kind) * kind(classes)
            code += batch.column(1).to_numpy().astype(kind)[:, None]
            held.append((batch.column(0).to_numpy().view(np.uint64), code))
            if sum(len(h) for h, _ in held) >= BLOCK_ROWS:
                yield stored()
        if held:
            yield stored()

    return [tuple(r) for r in rows.mapInArrow(write, "file string, n long").collect()]


# -- growing ------------------------------------------------------------------------------


def draws(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Copies of each row in a tree's bag: Poisson numbers with mean 1, from the rows' hashes."""
    start = np.random.default_rng((seed, tree)).integers(0, 2**63, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = hashes ^ start
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.uint8)


def best_cuts(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For histograms (nodes, features, bins, classes): gain of the best cut, its feature and bin, and the counts below it.

    The gain is the fall of Gini impurity under the classes' weights; leaves keep ``SMALLEST_LEAF`` rows.
    """
    below = np.cumsum(counts, axis=2)
    every = below[:, :, -1:, :]
    below = below[:, :, :-1]
    size = below.sum(3)
    fits = (size >= SMALLEST_LEAF) & (every.sum(3) - size >= SMALLEST_LEAF)
    low, total = below * weights, every * weights
    high = total - low
    w_low, w_high, w = low.sum(3), high.sum(3), total.sum(3)
    with np.errstate(invalid="ignore", divide="ignore"):
        kept = np.einsum("nfbc,nfbc->nfb", low, low) / w_low + np.einsum("nfbc,nfbc->nfb", high, high) / w_high
        gain = np.where(fits, (kept - np.einsum("nfbc,nfbc->nfb", total, total) / w) / w, -1.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    feature, cut = np.divmod(best, gain.shape[2])
    every_node = np.arange(len(gain))
    return flat[every_node, best], feature, cut, below[every_node, feature, cut]


def grow(tree: int, files: Sequence[tuple[str, int]], features: int, weights: np.ndarray, depth: int, seed: int) -> tuple:
    """One tree as ``TREE_KINDS`` says, and the importances of the features."""
    classes = len(weights)
    kind = np.uint8 if BINS * classes <= 256 else np.uint16
    chosen = int(np.ceil(np.sqrt(features)))
    total = sum(n for _, n in files)
    # what a tree knows of its rows lies in files that are gone with the process, not in memory
    node, copies = (np.memmap(tempfile.TemporaryFile(), t, "w+", shape=max(total, 1)) for t in (np.uint16, np.uint8))
    blocks, at = [], 0
    for name, n in files:
        hashes, code = (np.asarray(a) for a in _mapped(name, (np.uint64, kind)))
        copies[at : at + n] = draws(hashes, tree, seed)
        blocks.append((slice(at, at + n), code.reshape(n, features)))
        at += n
    if not copies.any():
        copies[:] = 1
    node[:] = np.where(copies > 0, 0, CLOSED)
    counts = np.zeros(classes, np.int64)
    for where, code in blocks:
        counts += np.bincount(code[:, 0] % kind(classes), weights=copies[where], minlength=classes).astype(np.int64)

    feature, cut, below, of = [-1], [0], [0], [counts]  # by node, in order of creation
    importance = np.zeros(features)
    root = float((counts * weights).sum())
    opened = np.array([0]) if _splits(counts[None])[0] else np.array([], int)
    moves, levels = None, 0  # what became of the open nodes of the level before
    for level in range(depth):
        if not len(opened):
            break
        random = np.random.default_rng((seed, tree, level))
        asked = np.argpartition(random.random((len(opened), features)), chosen - 1, axis=1)[:, :chosen].astype(np.int64)
        step = max(1, CELLS // (chosen * BINS * classes))
        found = []
        for first in range(0, len(opened), step):
            some = asked[first : first + step]
            histogram = _histogram(blocks, node, copies, some, first, step < len(opened), moves if first == 0 else None, classes)
            for part in range(0, len(some), 128):
                gain, slot, bin_, low = best_cuts(histogram[part : part + 128], weights)
                found.append((gain, some[np.arange(part, part + len(gain)), slot], bin_, low))
        gain, best, bin_, low = (np.concatenate(x) for x in zip(*found))
        low, split = low.astype(np.int64), gain > 0
        levels += bool(split.any())
        children = np.full((len(opened), 2), CLOSED, np.uint16)
        place, upcoming = 0, []
        here = np.array([of[i] for i in opened])
        last = level + 1 == depth
        grows = np.stack([_splits(low), _splits(here - low)], 1) & split[:, None] & (not last)
        for i in np.flatnonzero(split):
            parent = opened[i]
            feature[parent], cut[parent], below[parent] = int(best[i]), int(bin_[i]), len(feature)
            importance[best[i]] += gain[i] * float((here[i] * weights).sum()) / root
            for side, n in enumerate((low[i], here[i] - low[i])):
                if grows[i, side]:
                    children[i, side] = place
                    place += 1
                    upcoming.append(len(feature))
                feature.append(-1), cut.append(0), below.append(0), of.append(n)
        moves = (best, ((bin_ + 1) * classes).astype(np.int64), children)
        opened = np.array(upcoming, int)

    leaves = np.flatnonzero(np.array(feature) < 0)
    row = np.zeros(len(feature), np.int32)
    row[leaves] = np.arange(len(leaves))
    # a leaf leads to itself: no bin lies above its cut
    child, asks, limit = np.array(below, np.int64), np.array(feature, np.int64), np.array(cut, np.int64)
    child[leaves], asks[leaves], limit[leaves] = leaves, 0, 255
    chances = np.array([of[i] for i in leaves]) * weights
    chances = (chances / chances.sum(1, keepdims=True)).astype(np.float32)
    fallen = importance.sum()
    importance = importance / fallen if fallen > 0 else importance
    return child << 24 | asks << 8 | limit, row, chances, np.array([levels], np.int32), importance


def _splits(counts: np.ndarray) -> np.ndarray:
    """Whether nodes with these counts can be split at all."""
    return (counts.sum(1) >= 2 * SMALLEST_LEAF) & ((counts > 0).sum(1) > 1)


def _histogram(blocks, node, copies, asked, first, partly, moves, classes) -> np.ndarray:
    """Copies by open node, asked feature, bin and class, for the nodes from ``first`` on.

    ``moves`` leads the rows from the nodes of the level before to those of this one.
    """
    chosen, cells = asked.shape[1], BINS * classes
    out = np.zeros(len(asked) * chosen * cells)
    slots = np.arange(chosen) * cells
    for where, code in blocks:
        flat, features = code.reshape(-1), code.shape[1]
        for low in range(where.start, where.stop, CHUNK_ROWS):
            part = slice(low, min(low + CHUNK_ROWS, where.stop))
            at = node[part]
            rows = np.flatnonzero(at != CLOSED)
            if not len(rows):
                continue
            now = at[rows].astype(np.int64)
            start = (rows + (low - where.start)) * features
            if moves is not None:
                best, limit, children = moves
                now = children[now, (flat.take(start + best.take(now)) >= limit.take(now)).astype(np.int8)]
                at[rows] = now
                left = np.flatnonzero(now != CLOSED)
                rows, start, now = rows[left], start[left], now[left].astype(np.int64)
            now -= first
            if partly:
                inside = np.flatnonzero((now >= 0) & (now < len(asked)))
                rows, start, now = rows[inside], start[inside], now[inside]
            key = flat.take(start[:, None] + asked.take(now, axis=0)).astype(np.int64)
            key += (now * (chosen * cells))[:, None] + slots
            np.add.at(out, key.ravel(), np.repeat(copies[part][rows].astype(np.float64), chosen))
    return out.reshape(len(asked), chosen, BINS, classes)


# -- the model ------------------------------------------------------------------------------


@dataclass
class Forest:
    """Files of the trees in the shared folder, the cuts of each feature and the importances."""

    files: list[str]
    edges: list[list[float]]
    importances: list[float]
    classes: int

    def chances(self, columns: Sequence[Column]) -> Column:
        """Probability of each class: the mean over the trees of the weighted shares in a row's leaves."""
        files, edges, classes = self.files, [np.array(e) for e in self.edges], self.classes

        def scored(*arrays: pa.Array) -> pa.Array:
            bins = binned(arrays, edges, len(arrays[0]))
            found = _walked(bins, files, classes)
            offsets = np.arange(0, found.size + 1, classes, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

        # not deterministic for the optimizer: a filter behind it would carry a copy of it
        return F.arrow_udf(scored, "array<double>").asNondeterministic()(*[c.cast("double") for c in columns])

    def save(self, spark: SparkSession, path: str) -> None:
        """Files get new names and the description is written last, so a reader never sees half a model."""
        from pyarrow import fs

        copied = []
        for name in self.files:
            (source, old), (target, new) = _store(name), _store(f"{path}/trees/{uuid.uuid4().hex}")
            target.create_dir(new.rsplit("/", 1)[0], recursive=True)
            fs.copy_files(old, new, source_filesystem=source, destination_filesystem=target)
            copied.append(f"trees/{new.rsplit('/', 1)[1]}")
        about = {"files": copied, "edges": self.edges, "importances": self.importances, "classes": self.classes}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        return cls(**about | {"files": [f"{path}/{name}" for name in about["files"]]})


_known: dict[tuple, list] = {}  # forests that this worker has mapped


def _trees(files: tuple[str, ...]) -> list[tuple]:
    if files not in _known:
        if len(_known) >= 4:
            _known.clear()
        _known[files] = [tuple(np.asarray(a) for a in _mapped(name, TREE_KINDS)) for name in files]
    return _known[files]


def _walked(bins: np.ndarray, files: Sequence[str], classes: int) -> np.ndarray:
    """Mean chances over the trees, rows by classes."""
    total = np.zeros((len(bins), classes))
    for low in range(0, len(bins), 4096):
        part = np.ascontiguousarray(bins[low : low + 4096])
        flat, start = part.reshape(-1), np.arange(len(part)) * part.shape[1]
        for nodes, leaves, chances, levels in _trees(tuple(files)):
            at = np.zeros(len(part), np.int64)
            for _ in range(int(levels[0])):
                node = nodes.take(at)
                at = (node >> 24) + (flat.take(start + ((node >> 8) & 0xFFFF)) > (node & 0xFF))
            total[low : low + 4096] += chances.reshape(-1, classes).take(leaves.take(at), axis=0)
    return total / total.sum(1, keepdims=True)


def fit_forest(
    train: DataFrame, features: Sequence[str], label: str, key: Sequence[str], trees: int, depth: int, seed: int, partitions: int
) -> Forest:
    """Balanced forest on imputed rows, which are binned in at most ``partitions`` tasks. Rows without a label are left out."""
    if depth > DEEPEST:
        raise ValueError(f"trees may be {DEEPEST} levels deep")
    spark = train.sparkSession
    shares = {r[label]: r for r in imputation.class_weights(train, label).collect() if r[label] is not None}
    if not shares or min(shares) < 0:
        raise ValueError("a forest needs rows with labels from 0 up")
    weights = np.zeros(max(shares) + 1)
    for c, r in shares.items():
        weights[c] = r["weight"]
    values = [col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    hashed = F.xxhash64(*key, label, *[col(f) for f in features]).alias("hash")
    rows = train.filter(F.col(label).isNotNull()).select(hashed, F.col(label).cast("int").alias("label"), *values)
    share = min(1.0, POOL / sum(r["n"] for r in shares.values()))
    chosen = rows.filter(F.pmod("hash", F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else rows
    pool = chosen.limit(4 * POOL).toArrow()
    if not pool.num_rows:
        pool = rows.limit(POOL).toArrow()
    edges = [edges_of(_numbers(c.combine_chunks())) for c in pool.columns[2:]]

    folder, grown = scratch_path(spark, "forest-rows"), scratch_path(spark, "forest")
    files = _blocks(rows.coalesce(partitions), edges, len(weights), folder)
    width = len(features)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                *parts, importance = grow(tree, files, width, weights, depth, seed)
                name = f"{grown}/{tree}-{uuid.uuid4().hex}"
                _write(name, *parts)
                yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([name]), pa.array([importance.tolist()])], ["tree", "file", "importance"])

    planted = sorted(spark.range(0, trees, 1, trees).mapInArrow(plant, TREE).collect())
    discard(spark, folder)
    importance = np.sum([r["importance"] for r in planted], axis=0)
    total = importance.sum()
    return Forest([r["file"] for r in planted], [e.tolist() for e in edges], (importance / total if total else importance).tolist(), len(weights))
