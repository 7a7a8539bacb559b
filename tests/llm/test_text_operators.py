"""Each operator against a plain version of itself, on small tables with the awkward cases."""

import collections
import hashlib
import math
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import (
    chunk_fingerprints,
    components,
    decontamination,
    kneser_ney,
    language,
    mixing,
    pii,
    simhash,
    token_counts,
    token_files,
    toxicity,
)
from wellspring.llm.shared import remembered

WORDS = "the of and river stone cloud ember quill lantern harbor meadow Éclair straße niño 12 x1".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward():
    """(doc_id, text, lang, source): nulls in any column, empty, blank and long texts, ties, repeated rows."""
    rng = random.Random(7)
    long = sentence(rng, 6000)
    rows = [
        (1, "Mail a@b.co or c.d@e-f.org_x@y.zz, call +1 (017) 555-7713.", "en", "s1"),
        (2, None, None, None),
        (3, "", "en", "s1"),
        (4, " \t\n\r\x0b\x0c ", None, "s2"),
        (5, long, "en", "s1"),
        (6, long[:-40] + " other ending here", "fr", "s2"),
        (7, sentence(rng, 80), "fr", None),
        (7, sentence(rng, 80), "fr", None),
        (8, "card 4111 1111 1111 1111, 10.0.0.256 and 1.2.3.4.5.6.7.8 IBAN GB82 WEST 1234 5698 7654 32", "en", "s3"),
        (None, "no id here, but words", "en", "s3"),
        (None, None, "en", "s3"),
        (9, "a" * 5000, "en", "é"),
        (10, "\U0001f600 émoji Σ ΑΣ   x\x85y <|endoftext|>", None, "z"),
        (11, sentence(rng, 3), "en", "s1"),
    ]
    rows += [rows[0], rows[0]]  # repeated rows
    rows += [(20 + i, sentence(rng, rng.randint(1, 120)), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With further columns whose names the operators use themselves."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    for name in ("size", "block", "hash", "start", "term", "part", "spans", "held_out", "_text", "words", "range", "u", "n_words"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def bag(frame, *columns):
    return collections.Counter(map(tuple, frame.select(*columns).collect()))


# -- personal data ---------------------------------------------------------------------------


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    found = []
    for rank, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def test_personal_data(docs, rows):
    expected = collections.Counter((i, hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest()) for i, t, _, _ in rows)
    report = pii.personal_data_report(docs)
    assert bag(report, "doc_id", "base_sha256") == expected
    spans = {r.doc_id: r.spans for r in report.collect()}
    assert "iban:" in spans[8] and "ip:" in spans[8] and spans[3] == ""


@pytest.mark.parametrize("text", ["12 " * 700 + "a@b.cc " * 700, "5" * 20000, "a@" * 3000, "1." * 4000, "+1" + "(" * 5000])
def test_personal_data_in_dense_texts(spark, text):
    report = pii.personal_data_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert report.base_sha256 == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()


def test_checksums_and_context(spark):
    texts = ["GB82 WEST 1234 5698 7654 33", "XGB82WEST12345698765432", "ssn 123-45-6789", "code 123-45-6789", "ssn 000-45-6789"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.spans for r in pii.personal_data_report(frame).orderBy("doc_id").collect()] == ["", "", "national_id:4:15", "", ""]


def test_numbers_beside_other_words_and_numbers(spark):
    texts = ["GB82 WEST 1234 5698 7654 32 Please", "DE89 3704 0044 0532 0130 00 BIC COBADEFF", "SSN 123-45-6789, 234-56-7890", "GB82 WEST 1234 5698 7654 33 Please"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.spans for r in pii.personal_data_report(frame).orderBy("doc_id").collect()]
    assert found == ["iban:0:27", "iban:0:27", "national_id:4:15,national_id:17:28", ""]


# -- language --------------------------------------------------------------------------------


def test_language_learns_and_holds_out(spark):
    rng = random.Random(3)
    stems = {"aa": ["kalo", "mira", "tuva"], "bb": ["zrnk", "schwu", "pfolt"], "cc": ["iiyo", "ueeo", "aeoui"]}
    rows = []
    for i in range(240):
        lang = "aa bb cc".split()[i % 3]
        text = " ".join(rng.choice(stems[lang]) + rng.choice("xyz") for _ in range(30))
        rows.append((i, text, None if i % 17 == 0 else lang, lang))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    found = language.language_report(frame).join(frame.select("doc_id", "truth"), "doc_id").collect()
    assert len(found) == 240
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert np.mean([r.lang_pred == r.truth for r in found if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_awkward_rows(docs, empty, rows):
    found = language.language_report(docs).collect()
    assert len(found) == len(rows)
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in found} <= {"en", "fr", "und"}
    assert language.language_report(empty).count() == 0


def test_stretches_of_a_text_give_its_grams(monkeypatch):
    text = "some text that is cut into stretches"
    whole = np.sort(np.concatenate(list(language.buckets(text))))
    monkeypatch.setattr(language, "CHARS_AT_ONCE", 7)
    assert (np.sort(np.concatenate(list(language.buckets(text)))) == whole).all()


# -- token files -----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("top", [1, 300, 2**32 - 1])
def test_packed_ids_come_back(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, endpoint=True).astype(np.uint32)
    ids[::19] = np.uint32(2**32 - 1)
    docs, found = token_files.read_segment(token_files.write_segment([None, 5], [0, n], ids))
    assert (found == ids).all() and docs["tokens"].tolist() == [0, n] and docs["known"].tolist() == [0, 1]
    index, packed, places, high = token_files.pack(ids)
    for block in range(len(index)):
        some = token_files.unpack(index, packed, places, high, block, block + 1)
        assert (some[: n - 128 * block] == ids[128 * block : 128 * (block + 1)]).all()


def test_token_files(docs, empty, rows, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 500)
    tokenizer = Tokenizer.from_file(f"{token_files.TOKENIZERS}/word_bpe_49k.json")
    expected, start = collections.Counter(), 0
    for i, text in sorted(((i, t) for i, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        expected[(i, start, len(ids), zlib.crc32(ids.tobytes()))] += 1
        start += len(ids)
    assert bag(token_files.token_file_report(docs), "doc_id", "start", "n_tokens", "ids_crc32") == expected
    assert token_files.token_file_report(empty).count() == 0


def test_token_files_are_compressed(spark, tmp_path):
    """Blocks are packed at the width of their largest ids, so repeated texts leave much to compress."""
    docs = spark.createDataFrame([(i, "pump and valve of the well " * 40) for i in range(200)], "doc_id long, text string")
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, f"{token_files.TOKENIZERS}/word_bpe_49k.json")
    packed = spark.read.parquet(path).selectExpr("sum(length(data)) AS n").first()["n"]
    assert sum(f.stat().st_size for f in (tmp_path / "files").glob("*.parquet")) < packed / 2
    assert token_files.read_token_files(spark, path).count() == 200


def test_more_new_pieces_than_are_remembered(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(sys, "_wellspring_memory", {}, raising=False)
    path = f"{token_files.TOKENIZERS}/word_bpe_49k.json"
    tokenizer, encode = Tokenizer.from_file(path), token_files.piece_encoder(path, kept=2000)
    slices = [[f"the word{i}x{j}, of {i * j}." for j in range(20)] for i in range(4)]
    for texts in [*slices, *slices, ["the", ""]]:
        expected = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encode(texts) == expected
    (pieces,) = sys._wellspring_memory.values()
    assert pieces.size <= 2000 and len(pieces.known) <= 11 and len(pieces.older) <= 61  # a slice and what was before it
    remembered("another operator", dict)
    assert list(sys._wellspring_memory) == ["another operator"]


def test_ids_of_random_unicode_are_those_of_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(sys, "_wellspring_memory", {}, raising=False)
    path = f"{token_files.TOKENIZERS}/word_bpe_49k.json"
    tokenizer, encode = Tokenizer.from_file(path), token_files.piece_encoder(path)
    rng = random.Random(8)
    letters = [chr(c) for c in range(32, 0x2100)] + [chr(rng.randrange(0x2100, 0x2FFFF)) for _ in range(4000)]
    odd = "\u0130\u0307\u1e9e\u01c5\u03a3\u0345\u00df\u0149\u1f88\ufb03\u200d\u00ad\u0301\x01\n\t\x85\u2028"
    texts = ["BELED\u0130YES\u0130.", "GAZ\u0130, ve", "\u0130.", "a\x01b \x01 c\x01\x01 \x02", "x<|endoftext|>y", "a\u0307. \u01c5, \u1e9e."]
    for _ in range(3000):
        signs = [rng.choice(letters) if rng.random() < 0.4 else rng.choice(odd + "abcdEFG  .,.,") for _ in range(rng.randint(1, 40))]
        texts.append("".join(c for c in signs if not 0xD800 <= ord(c) < 0xE000))
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, encode(texts), expected) if a != b] == []


def test_latin_words_need_only_the_model(monkeypatch):
    """New words, the most of the encoder's time, skip the steps that would not change them."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(sys, "_wellspring_memory", {}, raising=False)
    path = f"{token_files.TOKENIZERS}/word_bpe_49k.json"
    tokenizer, encode = Tokenizer.from_file(path), token_files.piece_encoder(path)
    letters = [chr(c) for c in range(0x130) if chr(c).isalpha()]
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    rng = random.Random(3)
    texts = [f"{c} a{c} {c}a{c}b" for c in letters] + [f"\u00c9{c} z{c}{d}" for c in signs for d in signs]
    texts += [" ".join("".join(rng.choices(letters, k=rng.randint(1, 300))) + rng.choice(["", ".", "&&&", "\n"]) for _ in range(20)) for _ in range(50)]
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    (pieces,) = sys._wellspring_memory.values()
    asked = []

    class Counted:
        def encode(self, piece, **options):
            asked.append(piece)
            return tokenizer.encode(piece, **options)

    monkeypatch.setattr(pieces, "tokenizer", Counted())
    assert [t for t, a, b in zip(texts, encode(texts), expected) if a != b] == []
    assert [piece for piece in asked if any(c.isalpha() for c in piece)] == []


def test_special_tokens_are_found_by_their_exact_signs(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(sys, "_wellspring_memory", {}, raising=False)
    path = f"{token_files.TOKENIZERS}/word_bpe_49k.json"
    tokenizer, encode = Tokenizer.from_file(path), token_files.piece_encoder(path)
    texts = ["A<|ENDOFTEXT|> b", "<|endoftext|>", "\u00c9<|StartOfText|>.", "\u0416 <|EndOfText|>,", "X<|startoftext|>Y."]
    assert encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_a_piece_is_looked_up_once_a_call(monkeypatch):
    """Python sees the distinct pieces of a call, also where signs follow them, and not each of their places."""
    asked = []

    class Counted(token_files._Pieces):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    monkeypatch.setattr(sys, "_wellspring_memory", {}, raising=False)
    monkeypatch.setattr(token_files, "_Pieces", Counted)
    encode = token_files.piece_encoder(f"{token_files.TOKENIZERS}/word_bpe_49k.json")
    texts = ["The pump, the valve. THE pump\n(the well)", "", "valve: the"] * 50
    first, last = encode(texts[:3]), encode(texts)
    assert last == first * 50
    assert collections.Counter(asked) == dict.fromkeys(["the", "pump", ",", "valve", ".", "(the", "well", ")", ":"], 2)


def test_texts_are_cut_at_blanks_and_before_signs(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(sys, "_wellspring_memory", {}, raising=False)
    path = f"{token_files.TOKENIZERS}/word_bpe_49k.json"
    tokenizer, encode = Tokenizer.from_file(path), token_files.piece_encoder(path)
    calls = [[], [""], ["", ""], [" "], ["\n", " \n "], ["", "a", "", " ", ".", "b"], ["a", ".b", "\u0301c"]]
    calls += [["it's I'LL o'clock x's.y'd 'S", "a|b <|endoftext|>.", "a=\u0338 h\u0331. e\u0301! 5%a"], ["\x00a\x00. \x85b!\tc"]]
    for texts in calls:
        assert encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    pieces, before = token_files._cut(["a. b", "", ".c|\n"])
    assert pieces.to_pylist() == ["a", ".", "b", ".c|"] and before.tolist() == [0, 3, 3, 4]


def test_slices_are_bounded_by_their_signs(monkeypatch):
    monkeypatch.setattr(token_files, "SIGNS_AT_ONCE", 10)
    texts = ["a" * 4, "b" * 4, "c" * 30, "", "d", "e" * 11, ""]
    found = list(token_files._slices(texts))
    assert found == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 7)]
    assert list(token_files._slices([])) == []
    assert list(token_files._slices([""] * 2050)) == [(0, 1024), (1024, 2048), (2048, 2050)]


# -- toxicity --------------------------------------------------------------------------------


def best_segments(scores):
    """Maximal segments by definition: the best one, then those on its left and right."""
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, _, i, j = best
    right = [(s, a + j, b + j) for s, a, b in best_segments(scores[j:])]
    return best_segments(scores[:i]) + [(best[0], i, j)] + right


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-3, -1, -2, 1, 2, 5]) + rng.random() / 1000 for _ in range(rng.randint(0, 12))]
        words = [str(i) for i in range(len(scores))]
        found = toxicity.segments(words, {}, dict(zip(words, scores)))
        expected = best_segments(scores)
        assert [f[1:] for f in found] == [e[1:] for e in expected]
        assert np.allclose([f[0] for f in found], [e[0] for e in expected])


@pytest.mark.parametrize("fall", [0.5, 1.0, 2.0])
def test_scan_of_a_long_text_is_linear(fall):
    """Each positive word is followed by a fall; with the middle one the totals stay level."""
    words = ["up", "down"] * 100_000
    start = time.time()
    found = toxicity.segments(words, {}, {"up": 1.0, "down": -fall})
    assert time.time() - start < 5
    assert len(found) == (1 if fall < 1 else 100_000)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(1200):
        words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[10:10] = [rng.choice(["grubnash", "vexhorn", "snarlfit"]) + rng.choice(["", "s", "ed"]) for _ in range(3)]
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = toxicity.toxicity_report(docs, labels).collect()
    truth = dict(marks)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.3) for r in found)
    kept = toxicity.without_toxic(docs, toxicity.fit(toxicity.labelled(docs, labels)))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if not r.predicted}


def test_toxicity_of_awkward_rows(spark, docs, empty, rows):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (7, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.toxicity_report(docs, labels).count() == len(rows)
    assert toxicity.toxicity_report(docs, labels.where("false")).count() == len(rows)
    assert toxicity.toxicity_report(empty, labels).count() == 0


# -- decontamination -------------------------------------------------------------------------


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = collections.Counter()
    for doc_id, text in rows:
        words, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[(doc_id, len(words), len(hit), len(found), digest, bool(hit))] += 1
    return out


def test_decontamination(spark, docs, empty, rows):
    texts = {i: t for i, t, _, _ in rows}
    words = plain_words(texts[5])
    items = [(1, " ".join(words[100:125]).upper()), (2, "quill"), (3, ""), (4, None), (5, " ".join(words[31:41])), (6, "quill"),
             (7, "never seen words stand in this item of ten or more words"), (None, "Éclair straße")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0))
    expected = contamination([(i, t) for i, t, _, _ in rows], [(i, t) for i, t in items if i is not None])
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert bag(decontamination.decontamination_report(docs, frame.where("item_id IS NOT NULL")), *names) == expected
    assert decontamination.decontamination_report(docs, frame.where("false")).where("contaminated").count() == 0
    assert decontamination.decontamination_report(empty, frame).count() == 0
    clean = decontamination.without_contaminated(docs, frame.where("item_id IS NOT NULL"))
    assert clean.columns == docs.columns
    assert bag(clean, "doc_id") == collections.Counter((k[0],) for k in expected.elements() if not k[5])


def test_shuffled_lookup_gives_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, "the of and river"), (2, "stone cloud")], "item_id long, text string")
    before = bag(decontamination.decontamination_report(docs, items), "doc_id", "n_hit")
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", -1)
    assert bag(decontamination.decontamination_report(docs, items), "doc_id", "n_hit") == before


@pytest.mark.parametrize("most", [200_000, -1])
def test_lists_of_repeated_words_equal_every_place_tried(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("aab") for _ in range(n))
    edge = "b b a a a b a b b b"  # at every place of a stretch
    rows = [(i, prose(rng.randint(0, 120))) for i in range(40)] + [(100 + i, "c " * i + edge + " c" * 40) for i in range(70)]
    rows += [(200, "a " * 100), (201, "A"), (202, None), (203, ""), rows[0]]
    items = [(1, edge), (2, "a " * 10), (3, "a b"), (4, "b"), (5, prose(14)), (6, "a b a"), (7, "z"), (8, "a a a z a a a a a a")]
    report = decontamination.decontamination_report(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert bag(report, *names) == contamination(rows, items)


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, "x " * 20 + item), (2, "y beta alpha gamma epsilon delta zeta extra eta theta iota kappa z"), (3, "alpha " + "q " * 30 + "kappa")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    stretches = decontamination.stretches_of(frame)
    windows = decontamination.windows_of(spark.createDataFrame([(1, item)], "item_id long, text string"))
    windows = decontamination.looked_up(windows, decontamination.term_counts(stretches, windows))
    postings = decontamination.postings_of(stretches, windows)
    assert {r.doc_id for r in decontamination.exact_matches(postings, windows).collect()} == {1}
    assert {r.doc_id for r in decontamination.proximity_matches(postings, windows).collect()} == {1, 2}


def close_windows(rows, items, slop=3, share=0.8):
    """(doc_id, windows, items) of proximity matches, by trying every place for every window."""
    windows = collections.defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add(str(item))
    out = collections.Counter()
    for doc_id, text in rows:
        words, n, found = plain_words(text), 0, set()
        for window, ids in windows.items():
            width, least = len(window) + 2 * slop, math.ceil(round(share * len(set(window)), 9))
            places = range(max(1, len(words) - width + 1))
            if any(len(set(window) & set(words[i : i + width])) >= least for i in places):
                n, found = n + 1, found | ids
        out[(doc_id, n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0)] += 1
    return out


@pytest.mark.parametrize("most", [200_000, -1])
def test_proximity_report_equals_every_place_tried(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
    rng = random.Random(3)
    common = [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(common) for _ in range(n))
    passage = "alpha w1 gamma w2 epsilon w3 eta w4 iota w5"
    altered = [
        passage.replace("alpha", "other").replace("w5", "w6"),  # the rarest and one more
        " ".join(reversed(passage.split())),
        passage.replace("gamma", "x y z gamma").replace("eta", "v t eta"),
        passage.replace("gamma", "x").replace("eta", "v").replace("iota", "t"),  # one word too few
        passage,
    ]
    rows = [(i * 100 + k, f"{prose(20 + k)} {text} {prose(30)}") for i, text in enumerate(altered) for k in range(0, 36, 3)]
    rows += [(1000 + i, prose(rng.randint(0, 90))) for i in range(40)] + [(None, passage), (7, None), (8, ""), (9, "quill"), rows[0]]
    items = [(1, passage), (2, prose(14)), (3, "quill"), (4, "w1 w2 w1 w2 w1"), (5, None), (6, "never w7 w8 w9 w10 w11 w12 w13 w14 w15 " + prose(12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    report = decontamination.proximity_report(docs, frame)
    expected = close_windows(rows, items)
    assert bag(report, "doc_id", "n_near_windows", "n_near_items", "near_items_sha256", "near") == expected
    assert {r.doc_id // 100 for r in report.where("near AND doc_id < 500").collect()} >= {0, 1, 2, 4}
    assert report.where("contaminated AND NOT near").count() == 0
    exact = decontamination.decontamination_report(docs, frame)
    assert bag(report, *exact.columns) == bag(exact, *exact.columns)


# -- near duplicates -------------------------------------------------------------------------


def brute_classes(rows):
    hashes = [simhash.text_hash(t) & (2**64 - 1) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (hashes[i] ^ hashes[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return collections.Counter((rows[i][0], f"{hashes[i]:016x}", least.get(find(i))) for i in range(len(rows))), len(least)


def slow_hash(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, empty, rows, monkeypatch):
    for _, text, _, _ in rows[:14]:
        assert simhash.text_hash(text) & (2**64 - 1) == slow_hash(text)
    expected, classes = brute_classes([(i, t) for i, t, _, _ in rows])
    names = ["doc_id", "fingerprint", "component_id"]
    assert bag(simhash.near_duplicate_report(docs), *names) == expected
    monkeypatch.setattr(simhash, "TILE", 2)
    monkeypatch.setattr(simhash, "AT_ONCE", 50)
    assert bag(simhash.near_duplicate_report(docs), *names) == expected
    assert simhash.near_duplicate_report(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id IS NOT NULL").count() == classes


def test_links_of_close_hashes(spark):
    rng = random.Random(2)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    for h in list(hashes):
        chain = h
        for _ in range(3):
            chain ^= 1 << rng.randrange(64)
            chain ^= 1 << rng.randrange(64)
            hashes.append(chain)
    hashes = sorted(set(hashes))
    signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
    links = simhash.near_links(spark.createDataFrame([(h,) for h in signed], "hash long"))
    found = {r.node: r.root for r in components.connected_components(links).collect()}
    parent = {h: h for h in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(hashes):
        for j in range(i):
            if (a ^ hashes[j]).bit_count() <= 2:
                x, y = find(signed[i]), find(signed[j])
                parent[max(x, y)] = min(x, y)
    for h in signed:
        assert found.get(h, h) == find(h)


def test_components_of_a_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (1, 0)], "u long, v long")
    assert {(r.node, r.root) for r in components.connected_components(chain).collect()} == {(i, 0) for i in range(201)}
    assert components.connected_components(chain.where("false")).count() == 0


# -- chunk fingerprints ----------------------------------------------------------------------


def test_chunk_fingerprints(docs, empty, rows, monkeypatch):
    for chars in (2000, 10**9):
        monkeypatch.setattr(chunk_fingerprints, "CHARS_PER_PART", chars)
        order = sorted(((i, t or "") for i, t, _, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
        expected = collections.Counter()
        for k, (i, text) in enumerate(order):
            following = order[(k + 1) % len(order)][1]
            changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
            a, b, c = map(chunk_fingerprints.fingerprint, (text, changed, following))
            digest = hashlib.sha256(changed.encode()).hexdigest()
            likeness = chunk_fingerprints.containment(a, b), chunk_fingerprints.containment(a, c)
            expected[(i, len(text), digest, chunk_fingerprints.as_text(a), chunk_fingerprints.as_text(b), *likeness)] += 1
        report = chunk_fingerprints.fingerprint_report(docs)
        assert bag(report, *report.columns) == expected
    assert chunk_fingerprints.fingerprint_report(empty).count() == 0
    only_null = docs.where("doc_id IS NULL")
    assert chunk_fingerprints.fingerprint_report(only_null).count() == only_null.count()


def test_chunks_follow_the_content(monkeypatch):
    rng = random.Random(4)
    text = sentence(rng, 3000)
    data = text.encode()
    ends = chunk_fingerprints.chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= chunk_fingerprints.LONGEST and sizes[:-1].min() >= chunk_fingerprints.SHORTEST
    a = chunk_fingerprints.fingerprint(text)
    assert chunk_fingerprints.containment(a, chunk_fingerprints.fingerprint("A new start. " + text)) > 0.9
    assert chunk_fingerprints.containment(a, a) == 1
    monkeypatch.setattr(chunk_fingerprints, "AT_ONCE", 1000)
    assert chunk_fingerprints.chunk_ends(data) == ends


# -- mixing ----------------------------------------------------------------------------------


def test_mixing(docs, empty, rows):
    found = mixing.mixing_report(docs).collect()
    sizes = collections.Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, _ in rows)
    assert collections.Counter((r.doc_id, r["size"]) for r in found) == sizes
    total = sum(r["size"] for r in found)
    by_source = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"]
        entry = by_source.setdefault((r.source_size, r.target), [0, 0])
        entry[0] += r.taken
    assert math.isclose(sum(target for _, target in by_source), 1.5 * total)
    for (size, target), (taken, _) in by_source.items():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 2 * mixing.BLOCK
    again = mixing.mixing_report(docs.repartition(2))
    assert collections.Counter(map(tuple, found)) == bag(again, *again.columns)
    assert mixing.mixing_report(empty).count() == 0


def test_mixed_documents_hold_what_was_taken(spark):
    rng = random.Random(9)
    rows = [(i, f"w{i} " + sentence(rng, rng.randint(50, 400)), "en", f"s{i % 3}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixing.mixing_report(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words, texts = collections.Counter(), {r[0]: r[1] for r in rows}
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(texts[r.doc_id].split())
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_slots_show_every_block_before_any_twice(spark):
    sources = spark.createDataFrame([(1, 70, 97), (2, 13, 26), (3, 1, 1)], "source_no int, blocks long, slots long")
    shown = collections.defaultdict(list)
    for r in mixing.slot_table(sources).orderBy("slot").collect():
        shown[r.source_no].append((r["pass"], r.block))
    for no, blocks, slots in ((1, 70, 97), (2, 13, 26), (3, 1, 1)):
        assert len(shown[no]) == slots and len(set(shown[no])) == slots
        assert {b for _, b in shown[no][:blocks]} == set(range(blocks))


def test_mix_is_written_by_shard(spark, tmp_path, docs, empty):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.randint(0, 900))), None if i % 4 == 3 else f"s{i % 4}") for i in range(120)]
    rows += [(None, "", "s0"), (5, None, "s1"), (500, " \t two  words ", "s1")]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {w: (i, s) for i, t, s in rows for w in (t or "").split()}
    mix = mixing.write_mix(many, str(tmp_path / "mix"), 50)
    blocks = mix.collect()
    words = collections.Counter(w for r in blocks for w in r.text.split())
    taken = collections.Counter()
    for word, n in words.items():
        taken[texts[word][0]] += n
    report = {r.doc_id: r.taken for r in mixing.mixing_report(many).collect() if r["size"]}
    assert {i: n for i, n in report.items() if n} == dict(taken)
    for r in blocks:
        assert r.n_words == len(r.text.split()) <= mixing.BLOCK and {texts[w][1] for w in r.text.split()} == {r.source}
    shown = collections.Counter((r.source, r.block, r["pass"]) for r in blocks)
    assert max(shown.values()) == 1  # a pass shows a block once

    # the counts drawn are those written; each source's sum to its slots
    drawn = {(r.shard, r.source): r.slots for r in mixing.shard_counts(many, 50).collect()}
    assert drawn == collections.Counter((r.shard, r.source) for r in blocks)
    slots = {r.source: r.slots for r in mixing.source_targets(mixing.sized_documents(many)).collect()}
    shards = -(-sum(slots.values()) // 50)
    for source, n in slots.items():
        counts = [drawn.get((k, source), 0) for k in range(shards)]
        assert sum(counts) == n
        # chi square over equally likely shards: mean k - 1, deviation sqrt(2 (k - 1))
        spread = sum((c - n / shards) ** 2 for c in counts) * shards / n
        assert abs(spread - (shards - 1)) < 5 * math.sqrt(2 * (shards - 1))

    # a file is a run of shards and places
    files = collections.defaultdict(list)
    for r in mix.selectExpr("_metadata.file_name AS f", "shard", "place").collect():
        files[r.f].append((r.shard, r.place))
    assert all(places == sorted(places) for places in files.values())
    runs = sorted((p[0], p[-1]) for p in files.values())
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:]))
    again = mixing.mixed_blocks(many.repartition(3), 50)
    assert bag(again, *again.columns) == bag(mix, *again.columns)
    assert mixing.mixed_blocks(docs).count() == sum(r.slots for r in mixing.shard_counts(docs).collect())
    assert mixing.mixed_blocks(empty).count() == 0 == mixing.shard_counts(empty).count()


# -- language model --------------------------------------------------------------------------


def test_language_model(docs, empty, rows, monkeypatch):
    monkeypatch.setattr(kneser_ney, "CHARS_PER_RANGE", 3000)  # several ranges and spread contexts
    monkeypatch.setattr(kneser_ney, "TOKENS_AT_ONCE", 500)
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words, pairs = collections.Counter(), collections.Counter()
    for i, t, _, _ in rows:
        if i is not None and not held(i):
            words.update(tokens(t))
            pairs.update(zip([b" ", *tokens(t)], tokens(t)))
    contexts, continued, kinds = collections.Counter(), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (v, w), n in pairs.items():
        contexts[v] += n
        continued[w] += 1
        kinds[v][min(n, 3) - 1] += 1
    counted = lambda c: kneser_ney._discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)])
    high, low, types = counted(pairs), counted(continued), sum(continued.values())
    less = lambda n, d: max(n - d[min(n, 3) - 1], 0) if n else 0
    rest = sum(low[min(n, 3) - 1] for n in continued.values()) / types

    def chance(v, w):
        lower = less(continued[w], low) / types + rest / (len(words) + 1)
        if not contexts[v]:
            return lower
        return less(pairs[v, w], high) / contexts[v] + np.dot(high, kinds[v]) / contexts[v] * lower

    for v in [b" ", b"the", b"quill"]:
        assert math.isclose(sum(chance(v, w) for w in [*words, b"  unknown"]), 1, rel_tol=1e-9)
    total = sum(words.values())
    expected = sorted(
        (-1 if i is None else i, held(i), len(tokens(t)), sum(w in words for w in tokens(t)), total,
         round(sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in tokens(t)), 5),
         round(sum(math.log10(chance(v, w)) for v, w in zip([b" ", *tokens(t)], tokens(t))), 5))
        for i, t, _, _ in rows
    )
    found = sorted(
        (-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5))
        for r in kneser_ney.language_model_report(docs).collect()
    )
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    assert np.allclose([f[5:] for f in found], [e[5:] for e in expected], atol=2e-5)
    assert kneser_ney.language_model_report(empty).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    found = kneser_ney.language_model_report(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (found.n_tokens, found.n_known, found.train_tokens, found.score) == (3, 0, 0, 0.0)


# -- token counts ----------------------------------------------------------------------------


def test_token_counts(docs, empty, rows):
    encode = token_counts.encoder(f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken").encode_ordinary
    lengths = [len(encode(t or "")) for _, t, _, _ in rows]
    histogram = token_counts.with_suffix_sums(token_counts.length_counts(docs)).persist()
    for r in histogram.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_at_least == sum(n >= r.n_tokens for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= r.n_tokens)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
        assert r.truncated_tokens == sum(min(n, r.n_tokens) for n in lengths)
        assert math.isclose(r.share_fitting, sum(n <= r.n_tokens for n in lengths) / len(lengths))
    for r in token_counts.at_limits(histogram, [0, 5, 100, 10**6]).collect():
        assert r.docs_longer == sum(n > r.context_limit for n in lengths)
        assert r.tokens_kept == sum(min(n, r.context_limit) for n in lengths)
    for r in token_counts.quantiles(histogram, [0.1, 0.5, 0.99, 1.0]).collect():
        assert r.n_tokens == min(n for n in lengths if sum(m <= n for m in lengths) / len(lengths) >= r.share - 1e-12)
    assert token_counts.with_suffix_sums(token_counts.length_counts(empty)).count() == 0
