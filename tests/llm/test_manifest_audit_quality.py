"""The filter audit, the Merkle manifest and the quality scores against plain versions of themselves."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import filter_audit, merkle, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("part", "mask", "tree", "rank", "n", "block", "leaf", "path", "root", "score", "kind", "shard", "local", "_row", "_part", "held_out", "toxic")


def rows_of(seed=3):
    rng = random.Random(seed)
    words = "river stone Cloud EMBER quill éclair straße 12 x#1 a|b $5 mnop".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    many = " ".join(f"word{i}" for i in range(70))
    rows = [
        (1, None, None, None, None), (2, "", "en", "", 0), (3, " \t\n", "en", "s1", 3), (4, many, "en", "s1", len(many)), (5, many, "fr", "s2", 5),
        (None, many, "fr", "s2", 1), (None, None, None, "s2", None), (6, "a" * 40_000, "en", "s1", 2**63 - 1), (7, text(5000), None, "s1", 9),
        (8, many + " \x85 next", "é", "s1", 1), (8, many, "en", "s1", 1), (9, "EIN GROSSES WORT " * 30, "de", "s2", 4), (10, many + "$", "de", "s2", -4),
    ]
    rows += [rows[3], rows[3], rows[5]]  # repeated rows
    return rows + [(20 + i, text(rng.randint(1, 120)), rng.choice(["en", "fr", None]), rng.choice(["s1", None]), i) for i in range(60)]


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With further columns whose names the operators use themselves."""
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame.withColumns({name: F.lit("clash") for name in CLASHES})


def bag(frame, *columns):
    return Counter(map(tuple, frame.select(*columns).collect()))


# -- filter audit ----------------------------------------------------------------------------


def plain_failures(rows):
    found = []
    for doc_id, text, _, source, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (o or "") == t for i, o, _, _, _ in rows),
        }
        found.append((doc_id, source or "", "".join(k for k, v in fails.items() if v)))
    return found


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed, out = plain_failures(rows), []
    for part in {p for _, p, _ in failed}:
        mine = [(i, f) for i, p, f in failed if p == part]
        shapley = Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                removed = [(i, f) for i, f in left if letter in f]
                gone = [f for _, f in mine if letter in f and set(f) & set(order[: step - 1])]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(removed)
                lines.append(
                    (part, "".join(order), step, len(left), len(removed), len(gone), sum(f == letter for _, f in mine),
                     sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), letter)
                )
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return Counter(out)


LABELS = [(4, 1, 0), (5, 0, 1), (7, 1, 1), (8, None, 1), (9, 1, None), (9, 0, 0), (None, 1, 1), (25, 1, 0), (26, 0, 1), (999, 1, 1)]
AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("shard_bytes", [1, 3000, 16 << 20])
def test_audit_equals_the_plain_one_for_any_shards(spark, docs, rows, shard_bytes):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    assert bag(filter_audit.filter_audit(docs, labels, shard_bytes), *AUDIT) == plain_audit(rows, LABELS)


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs.where("false"), labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_matrix_has_one_number_for_a_word_in_all_shards(spark, docs, rows, tmp_path):
    shards = filter_audit.write_shards(docs, str(tmp_path / "shards"), 2000)
    assert shards.where(F.col("kind") == filter_audit.MATRIX).count() > 3
    words = shards.where(F.col("kind") == filter_audit.WORD).select("shard", "local", "key")
    numbers = filter_audit.global_numbers(shards).where(F.col("kind") == filter_audit.WORD)
    pairs = {(bytes(r.key), r.value) for r in words.join(numbers, ["shard", "local"]).collect()}
    vocabulary = {w for _, t, *_ in rows for w in (t or "").encode().split()}
    assert {w for w, _ in pairs} == vocabulary and len(pairs) == len(vocabulary) == len({v for _, v in pairs})
    counts = bag(filter_audit.matrix_rows(shards), "doc_id", "n_words", "n_distinct")
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    assert counts == Counter((i, len(w), len(set(w))) for i, w in split)


# -- Merkle manifest -------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def climb(levels, i, node):
    """Root from a node, and the siblings on the way."""
    proof = ""
    for level in levels[:-1]:
        run = level[i - i % 2 : i - i % 2 + 2]
        proof += "".join(run[k] for k in range(len(run)) if k != i % 2)
        run[i % 2] = node
        node, i = sha("".join(run)), i // 2
    return node, proof


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, members = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        members.append(mine)
        trees.append(levels_of([plain_leaf(r) for r in mine]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for at, (tree, mine) in enumerate(zip(trees, members)):
        for i, row in enumerate(mine):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, proof = climb(tree, i, plain_leaf(row, int(tampered)))
            folded, rest = climb(top, at, node)
            out.append((row[0], plain_leaf(row), tree[-1][0], top[-1][0], sha(proof + rest), folded, folded == top[-1][0]))
    return Counter(out)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels", [1, 2, 3, 12])
def test_manifest_equals_the_plain_one_for_any_runs(docs, rows, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "RUN", 1 << levels)
    assert bag(merkle.manifest_report(docs), *MANIFEST) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_one_row(spark, docs, rows):
    assert merkle.manifest_report(docs.where("false")).count() == 0
    one = merkle.manifest_report(docs.where("doc_id = 9")).collect()
    assert [tuple(r[c] for c in MANIFEST) for r in one] == list(plain_manifest([rows[11]]))
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == sha("")


@pytest.mark.parametrize("n", range(1, 40))
def test_places_are_those_of_the_log(n):
    """The closed form against a log written by recursion."""
    levels = levels_of([sha(str(i)) for i in range(n)])
    written = []

    def complete(level, i):
        for child in (2 * i, 2 * i + 1):
            if level and child < len(levels[level - 1]):
                complete(level - 1, child)
        written.append((level, i))

    complete(len(levels) - 1, 0)
    assert [merkle.place(level, i, n) for level, i in written] == list(range(len(written)))
    assert merkle.append_log(levels[0], merkle.height(n)) == [levels[level][i] for level, i in written]


# -- quality ---------------------------------------------------------------------------------


def quality_rows(n=240):
    rng = random.Random(5)
    words = [a + b for a in ("ri", "sto", "clo", "em", "qui") for b in ("ver", "ne", "ud", "ber", "ll")]
    rows = []
    for i in range(n):
        some = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        good = i % 3 != 0
        if not good:
            some = [w.upper() + "!!" for w in some] if i % 2 else [some[0]] * len(some)
        rows.append((i, " ".join(some), "en", "s1", 1, int(good)))
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([r[:5] for r in rows], SCHEMA).withColumns({name: F.lit("clash") for name in CLASHES})
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, quality int")
    return rows, docs, labels


def test_quality_on_held_out_texts(judged):
    rows, docs, labels = judged
    found = quality.quality_report(docs, labels).collect()
    truth = {r[0]: r[5] for r in rows}
    held = [r for r in found if r.held_out]
    assert len(found) == len(rows) and {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)


def test_quality_features_equal_the_plain_ones():
    rng = random.Random(1)
    for text in ["", "a", "Ab  12 ##!!! éÉ\n\n\U0001f600x x x", "".join(rng.choice("aB 3#é\n") for _ in range(900))]:
        kinds = []
        for c in text:
            kind = int(quality.sign_classes()[ord(c)]) if ord(c) < 0x10000 else 6
            if len(kinds) < 2 or not kinds[-1] == kinds[-2] == kind:
                kinds.append(kind)
        counts = np.zeros(quality.SHAPE_BUCKETS, int)
        for order in quality.SHAPE_ORDERS:
            for i in range(len(kinds) - order + 1):
                g = 0
                for k in kinds[i : i + order]:
                    g = ((g ^ (g >> 15)) * 0x85EBCA6B + k + order) & 0xFFFFFFFF
                counts[((g ^ (g >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF) >> 20] += 1
        assert (quality.shapes(text) == counts).all()
        at, n, repeated = quality.term_counts(text)
        words = Counter(zlib.crc32(w.encode()) % quality.WORD_BUCKETS for w in text.lower().split())
        assert dict(zip(at[: len(words)], n)) == words and len(at) == len(words) + (counts > 0).sum()


def test_long_texts_have_the_shapes_of_their_stretches(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("aB 3#é\n") for _ in range(3000))
    whole = quality.shapes(text)
    monkeypatch.setattr(quality, "SIGNS_AT_ONCE", 7)
    assert (quality.shapes(text) == whole).all()


def test_votes_equal_a_plain_count():
    rng = np.random.default_rng(0)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    voters = unit(np.round(rng.standard_normal((40, 3)), 1) + 0.01).astype(np.float32)
    voters[5] = voters[6] = voters[7]
    model = quality.QualityModel(None, None, voters, rng.integers(0, 2, 40).astype(np.float32), 0.7)
    asked = np.vstack([unit(rng.standard_normal((20, 3))), voters[5:6], np.zeros((1, 3))]).astype(np.float32)
    found = quality.votes(asked, model, 4)
    for q, score in zip(asked, found):
        near = (q[None] @ voters.T)[0]
        last = sorted(near)[-4]
        weight = [max(float(s), 0.0) ** quality.POWER if s >= last - 1e-6 else 0.0 for s in near]
        expected = sum(w * y for w, y in zip(weight, model.labels)) / sum(weight) if q.any() else 0.7
        assert score == pytest.approx(expected, abs=1e-3)


def test_space_spans_the_leading_singular_vectors(spark):
    rng = np.random.default_rng(4)
    at = np.arange(30, dtype="<i4")
    x = (rng.standard_normal((50, 3)) @ rng.standard_normal((3, 30)) * 5 + 0.01 * rng.standard_normal((50, 30))).astype("<f4")
    table = spark.createDataFrame([(i, i % 4, at.tobytes(), x[i].tobytes()) for i in range(50)], "doc_id long, shard long, at binary, x binary")
    basis = quality._basis(table, 3)
    expected = np.linalg.svd(x)[2][:3]
    assert np.abs(basis[30:]).max() < 1e-5
    assert np.linalg.norm(basis[:30].T - basis[:30].T @ expected.T @ expected) < 1e-2


def test_quality_of_awkward_rows(spark, docs, judged):
    _, plain, labels = judged
    report = quality.quality_report(docs, labels).collect()
    assert len(report) == docs.count()
    empty = {r.score for r in report if r.doc_id in (1, 2)}
    assert len(empty) == 1
    assert quality.quality_report(docs.where("false"), labels).count() == 0
    unlabelled = quality.quality_report(plain, labels.where("false"))
    assert unlabelled.select("score", "predicted").distinct().collect() == [(0.5, 1)]
    bad = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None), (3, 7)], "doc_id long, quality int")
    assert {r.score for r in quality.quality_report(plain, bad).collect()} == {0.5}
