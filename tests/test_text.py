"""Documents, retrieval against brute force, and diagnosis texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.constants import STOP_WORDS
from wellspring.operators import diagnosis, evidence, retrieval
from wellspring.operators.telemetry import parse_payload
from wellspring.sources import documents as docs

SEALS = """# Worn Pump Seals

A short note on seals and pump shafts.

## Typical Symptoms
- **Drips:** a wet base plate below the coupling
- short

## 4. Possible Root Causes
1. Dry running after a start without priming.
2. A bent shaft that wobbles at speed.
3. Grit in the flushing water.
4. The wrong elastomer for hot oil.

## 6. Recommended Operator Actions
1. Stop the pump and lock its switch.
- Replace both faces of the seal.
3. Check the shaft with a dial gauge.

## 7. Critical Safety Considerations
- Spilled oil makes the floor around the pump skid very slippery.
- Short line.
- Hot parts behind the guard burn bare hands within a moment.
"""
FILTERS = """# Clogged Filters

Clogged filters starve the burner.

## Signs
Suction falls while noise rises; clogged filters turn brown.
"""


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    (folder / "event_3_seals.md").write_text(SEALS)
    (folder / "event_8_filters.md").write_text(FILTERS)
    (folder / "notes.md").write_text("no title here, only seal notes of 2024")
    (folder / "skip.txt").write_text("# not read")
    return docs.chunk_sections(docs.read_documents(spark, str(folder))).persist()


def brute_force(chunks, query, event, k):
    def bag(text):
        words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in STOP_WORDS]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    rows = sorted(chunks, key=lambda r: (r.doc_name, r.section_no))
    bags = [bag(r.content) for r in rows]
    df = Counter(t for b in bags for t in b)

    def vector(b):
        v = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in b.items() if t in df}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    q = vector(bag(query))
    scored = []
    for r, b in zip(rows, bags):
        d = vector(b)
        score = sum(x * d.get(t, 0.0) for t, x in q.items())
        scored.append((r.chunk_id, score * 1.5 + 0.3 if event is not None and r.event_id == event else score))
    return sorted(scored, key=lambda pair: -round(pair[1], 10))[:k]


def test_sections(chunks):
    rows = {r.chunk_id: r for r in chunks.collect()}
    assert len(rows) == 5 + 2 + 1
    first = rows["event_3_seals_1"]
    assert (first.section_title, first.event_id, first.doc_title) == ("Overview", 3, "Worn Pump Seals")
    assert rows["event_3_seals_3"].section_title == "4. Possible Root Causes"
    note = rows["notes_1"]
    assert (note.doc_title, note.event_id, note.section_title) == ("notes", -1, "Overview")
    assert first.content.startswith("Document: Worn Pump Seals\nSection: Overview\nEvent ID: 3\n\n# Worn")


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_search_equals_brute_force(spark, chunks, broadcast_rows):
    asked = [
        (1, "worn seals drip on the base plate", 3),
        (2, "brown filters starve burners", 8),
        (3, "nothing known zzz qqq", 8),
        (4, "nothing known zzz qqq", 77),
        (5, "bent shaft and flushing water seal 2024 notes", 8),
    ]
    index = retrieval.fit_index(chunks)
    queries = spark.createDataFrame(asked, "query_id long, query string, event int")
    local = chunks.collect()
    for event in (None, "event"):
        for k in (1, 3, 8):
            got = {}
            for r in retrieval.search(queries, index, k, event, broadcast_rows).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
            for number, text, wanted in asked:
                expected = brute_force(local, text, wanted if event else None, k)
                assert [c for c, _ in got[number]] == [c for c, _ in expected]
                assert [s for _, s in got[number]] == pytest.approx([s for _, s in expected], abs=1e-9)


def test_index_survives_saving(spark, chunks, tmp_path):
    retrieval.fit_index(chunks).save(str(tmp_path / "index"))
    loaded = retrieval.load_index(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "worn seals")], "query_id long, query string")
    found = retrieval.search(queries, loaded, 3).collect()
    assert any("seals" in r.content.lower() for r in found)
    with pytest.raises(Exception):
        retrieval.load_index(spark, str(tmp_path / "missing"))


BODY = '{"P-PDG": 31000000, "P-TPT": 21000000, "T-TPT": 14.5, "P-MON-CKP": 19000000, "T-JUS-CKP": 9.2, "P-ANULAR": 800000, "T-PDG": 90, "QGL": 1.2, "ABER-CKP": 70}'


def incidents(spark, event=3, name="Severe Slugging", confidence=0.6):
    rows = [(1, "W", "ANOMALY", "FAULT", event, name, confidence, BODY)]
    schema = ("id long, well_id string, status string, binary_status string, event_id int, event_name string, "
              "confidence double, sensor_data string")
    df = evidence.with_evidence(parse_payload(spark.createDataFrame(rows, schema)))
    return df.drop("payload", "sensor_data")


def test_evidence_texts(spark):
    found = incidents(spark).first().evidence
    assert [e.sensor for e in found] == ["P-TPT", "T-TPT", "P-MON-CKP", "T-JUS-CKP"]
    assert found[0].significance == "Surge of 5.0% above maximum nominal threshold"
    assert found[1].observed_value == "14.50" and found[1].status == "ABNORMALLY LOW"
    assert found[1].expected_behavior == ">= 50.0 (Nominal: 50 - 95 °C (Transducer Temperature))"


def test_report_uses_retrieved_sections(spark, chunks):
    index = retrieval.fit_index(chunks)
    row = diagnosis.diagnose(incidents(spark), index, 5).first()
    text = row.raw_diagnosis
    for title in ("FAULT DETECTION", "SENSOR EVIDENCE", "POSSIBLE CAUSES", "RECOMMENDED CHECKS", "SAFETY NOTE", "KNOWLEDGE SOURCES"):
        assert f"{title}\n----------------\n" in text
    assert "Confidence: 60.0% (Low / Uncertain)" in text
    assert "1. 1. Dry running after a start without priming.\n" in text
    assert "2. Replace both faces of the seal.\n" in text
    assert "Spilled oil makes the floor" in text
    assert text.endswith("KNOWLEDGE SOURCES\n----------------\nWorn Pump Seals\n")
    assert row.retrieved_sources == ["Worn Pump Seals"] * 5
    assert "WARNING: Model confidence is low (<65%)" in row.prompt and "KNOWLEDGE EXCERPT 5" in row.prompt


def test_report_defaults(spark, chunks):
    index = retrieval.fit_index(chunks.filter("event_id = 8"))
    row = diagnosis.diagnose(incidents(spark, 8, "Hydrate in Production Line", 0.8), index).first()
    assert "1. Downhole hydraulic or multiphase" in row.raw_diagnosis
    assert "Confidence: 80.0% (High)" in row.raw_diagnosis and "WARNING" not in row.prompt


def test_dense_ranking(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 1), (3, [0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (None, [1.0, 0.0]), (2, None)], "query_id int, vector array<double>")
    got = retrieval.dense_topk(df, asked, 3).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 4)) for r in got] == [(2, 1.2), (1, 1.0), (3, 0.3)]


def test_dense_ranking_in_tiles_and_blocks_equals_every_product(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = [(i, np.round(rng.standard_normal(5), 1).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    vectors += [(300, None, 1), (301, [0.0] * 5, 2), (302, [1.0], 1), (303, vectors[7][1], None)]
    asked = [(i, np.round(rng.standard_normal(5), 1).tolist()) for i in range(23)] + [(50, [1.0, 2.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in retrieval.dense_topk(frame, queries, 6).collect()}

    def cosine(a, b):
        if b is None or len(a) != len(b) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for number, q in asked:
        scored = [(-(round(cosine(q, v) * 1.5 + 0.3, 8) if label == number else round(cosine(q, v), 8)), i) for i, v, label in vectors]
        for rank, (score, key) in enumerate(sorted(scored)[:6], 1):
            assert got[number, rank][0] == key and abs(got[number, rank][1] + score) < 1e-7
    assert len(got) == 6 * len(asked)


def test_missing_lines_of_a_section(spark):
    lines = diagnosis.numbered_lines(F.array(F.lit("a")), ["x", "y", "z"], ["p", "q", "r"])
    assert list(spark.range(1).select(*lines).first()) == ["1. a", "2. q", "3. r"]


def test_postings_of_an_index_are_not_shuffled(spark):
    """Only texts and the distinct terms of a shard move: none of the exchanges carries chunks of terms."""
    rows = [(f"c{i}", f"d{i}", i, 1, "pump valve pressure " * (i % 3) + f"word{i % 7}") for i in range(50)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_name string, section_no int, event_id int, content string")
    index = retrieval.fit_index(chunks, store=False)
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("Exchange")[1:]]
    assert not any(line.startswith((" hashpartitioning(chunk_id", " hashpartitioning(shard#")) and "chunk_id" in line.split(")")[0] for line in moved)
    assert not any("SortMergeJoin" in line for line in moved)
    lengths = index.postings.groupBy("chunk_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert len(lengths) == 50 and all(abs(r.n - 1) < 1e-9 for r in lengths)
    assert {r.term for r in index.idf.collect()} == {r.term for r in index.postings.select("term").distinct().collect()}


def test_an_index_of_few_and_many_shards_has_the_same_weights(spark, monkeypatch):
    """Also with a repeated id, null and empty texts and terms that many shards hold; and no term is exchanged as a row."""
    texts = [("a", "Red pump red pump valve"), ("b", "valve of a red pump"), ("b", "choke valve"), ("c", None), ("d", ""), (None, "red valve"), ("e", "the of")]
    chunks = spark.createDataFrame(texts * 1, "chunk_id string, content string")

    def found():
        index = retrieval.fit_index(chunks, store=False)
        weights = {(r.chunk_id, r.term): round(r.weight, 9) for r in index.postings.collect()}
        asked = {(r.chunk_id, r.term): round(r.weight, 9) for r in index.asked(["red pump", "valve", "missing"]).collect()}
        assert asked == {k: w for k, w in weights.items() if k[1] in ("red pump", "valve")}
        return weights, {r.term: round(r.idf, 9) for r in index.idf.collect()}

    weights, idf = found()
    assert idf["valve"] == round(math.log(8 / 4) + 1, 9) and idf["red pump"] == round(math.log(8 / 3) + 1, 9)
    assert weights["b", "valve"] == pytest.approx(weights["b", "choke"] * (1 + math.log(2)) * idf["valve"] / idf["choke"])
    monkeypatch.setattr(retrieval, "SHARD_LETTERS", 1)
    assert found() == (weights, idf)
    plan = retrieval.fit_index(chunks, store=False).postings._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "Window" not in plan


def test_search_by_products_equals_search_by_pairs(spark, monkeypatch):
    """Chunks with equal scores, without event and of many tiles; the incidents' queries meet no chunk as a pair of rows."""
    words = [f"w{i}" for i in range(30)]
    rng = np.random.default_rng(4)
    rows = [(f"c{i}", f"d{i % 7}", i, [1, 2, None][i % 3], " ".join(rng.choice(words, 8)) if i % 5 else "w1 w2 w3") for i in range(90)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_name string, section_no int, event_id int, content string")
    asked = [(i, [1, 2, 3, None][i % 4], " ".join(rng.choice(words, 6))) for i in range(20)]
    queries = spark.createDataFrame(asked, "query_id long, event int, query string")
    index = retrieval.fit_index(chunks)

    def found(event, most=1000):
        rows = retrieval.search(queries, index, 3, event, most).collect()
        return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in rows)

    by_pairs = {event: found(event, 0) for event in ("event", None)}
    assert len(by_pairs["event"]) == 60
    plan = retrieval.search(queries, index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    for cost in (0, 10**9):  # all pairs, all products
        real = retrieval._best_chunks
        for event in ("event", None):
            with monkeypatch.context() as patched:
                patched.setattr(retrieval, "PAIR_COST", cost)
                assert found(event) == by_pairs[event]
        assert real is retrieval._best_chunks
    postings, shares = rng.random((40, 12)), rng.random((9, 40)) * (rng.random((9, 40)) < 0.3)
    row, term = np.nonzero(shares)
    t, c = np.nonzero(postings)
    for cost in (0, 10**9):
        monkeypatch.setattr(retrieval, "PAIR_COST", cost)
        product = retrieval._Product(row, term, shares[row, term], 9, 40)
        assert product.with_postings(t, c, postings[t, c], 12) == pytest.approx(shares @ postings)
