"""Benchmark decontamination by a positional inverted index.

One scan cuts every document into words and stores their postings (term, position), sorted by term,
in stretches of ``STRETCH`` words that overlap by a window: the position lists of a place lie in one
row, and those of a common word or a long document in many. The occurrences of the benchmark's terms
are counted over all documents. A window's terms are taken from the rarest up: postings of the rarest
give starts (position less the term's place in the window), a join by both terms and their distance
keeps those that the second's list has too, and the lists of the others, less their places, are
intersected with what is left until nothing is. A start that all lists hold is an exact match.

Proximity matches hold most of a window's distinct words, in any order, close by. Of n words k
are needed, so one of the n - k + 1 rarest must be there; the postings of these are not stored
but checked as the stretches are read.

Only built-in functions are used. The benchmark's tables are broadcast up to
``MOST_BROADCAST`` rows and joined by a shuffle beyond.

Defined results: a null, empty or wordless text has no words and no hits; a benchmark item
without words is never found; equal items are found together; repeated documents each get a
row; empty tables give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.shared import LOWER, UPPER, materialise, whole_text, with_row_key

WINDOW, STRETCH = 10, 32
SLOP, SHARE = 3, 0.8
MOST_BROADCAST = 200_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BEYOND_ASCII = r"[^\x00-\x7F]"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; the quick ``lower`` serves ASCII, where it changes nothing else."""
    lowered = F.when(F.regexp_like(text, F.lit(BEYOND_ASCII)), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, GAP, -1), "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``phrase``, ``words`` and the ``items`` that hold them."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), words_of(whole_text()).alias("words"))
    rows = rows.withColumn("n", F.size("words")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - window + 1))
    cut = rows.select("item", "words", F.explode_outer(starts).alias("at"))
    cut = cut.select("item", F.slice("words", F.col("at"), F.lit(window)).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("phrase", F.array_join("words", " "))


def stretches_of(docs: DataFrame, window: int = WINDOW, overlap: int | None = None) -> DataFrame:
    """The stored words: ``doc_id``, ``text_key``, ``n_words``, ``base``, ``lead``, the words ``around`` and their ``lists``.

    ``lists`` holds (term, at) of the words around, sorted: the position list of each term. A stretch begins at word ``base``; ``lead`` words before it and ``overlap`` behind it come
    along. Exact matches need an overlap of ``window`` - 1, proximity matches twice the slop more,
    which is the default. A document without words has one row without a stretch.
    """
    text = whole_text()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), words_of(text).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    overlap = window - 1 + 2 * SLOP if overlap is None else overlap
    starts = F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRETCH)))
    rows = rows.withColumn(
        "stretch",
        F.explode_outer(
            F.transform(
                starts,
                lambda b: F.struct(
                    b.alias("base"),
                    F.least(b, F.lit(overlap)).alias("lead"),
                    F.slice("words", F.greatest(b - overlap, F.lit(0)) + 1, F.least(b, F.lit(overlap)) + STRETCH + overlap).alias("around"),
                ),
            )
        ),
    )
    postings = F.transform("stretch.around", lambda w, at: F.struct(w.alias("term"), at.alias("at")))
    return rows.select(
        "doc_id", "text_key", "n_words", "stretch.base", "stretch.lead", "stretch.around", F.sort_array(postings).alias("lists")
    )


def _own(stretches: DataFrame, *columns: str) -> DataFrame:
    """``columns``, ``term`` and ``at`` of the postings of the stretches themselves, without the words beside them."""
    said = stretches.select(*columns, "lead", F.explode_outer("lists").alias("p"))
    said = said.where((F.col("p.at") >= F.col("lead")) & (F.col("p.at") < F.col("lead") + STRETCH))
    return said.select(*columns, "lead", "p.term", "p.at")


def term_counts(stretches: DataFrame, windows: DataFrame) -> DataFrame:
    """Occurrences, over all documents, of every term of the benchmark."""
    terms = windows.select(F.explode("words").alias("term")).distinct()
    used = _own(stretches).select("term").join(_small(terms), "term")
    counts = used.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def looked_up(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``windows`` with their terms from the rarest up.

    ``term`` and ``place`` are the rarest one's, ``second`` is the next and ``apart`` its distance from
    the first (a window of one word has the same twice), ``rest`` the others with their places.
    """
    placed = windows.select("phrase", F.posexplode("words").alias("place", "term")).join(counts, "term")
    ranked = placed.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("n", "term", "place"))).alias("by_n"))
    first, second = F.col("by_n")[0], F.coalesce(F.get("by_n", F.lit(1)), F.col("by_n")[0])
    rest = F.transform(F.slice("by_n", F.lit(3), F.size("by_n")), lambda t: F.struct(t["term"].alias("term"), t["place"].alias("place")))
    return windows.join(ranked, "phrase").select(
        "phrase", "words", "items", first["term"].alias("term"), first["place"].alias("place"),
        second["term"].alias("second"), (second["place"] - first["place"]).alias("apart"), rest.alias("rest"),
    )


def postings_of(stretches: DataFrame, windows: DataFrame) -> DataFrame:
    """Postings of the windows' rarest terms, with the lists of their stretch; ``inside`` is the place in it."""
    carried = [name for name in ("around", "lists") if name in stretches.columns]
    said = _own(stretches, "doc_id", "text_key", "base", *carried).withColumnRenamed("at", "inside")
    found = said.join(_small(windows.select("term").distinct()), "term")
    position = F.col("base") - F.col("lead") + F.col("inside")
    return found.select("term", "doc_id", "text_key", position.alias("position"), "inside", *carried)


def exact_matches(postings: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text_key``, ``start``, ``size`` and ``items`` of every occurrence of a window."""
    inside = F.col("inside")
    beside = F.filter("lists", lambda p: F.abs(p["at"] - inside) < window)
    pairs = postings.select("doc_id", "text_key", "term", "position", "inside", "lists", F.explode_outer(beside).alias("q"))
    pairs = pairs.withColumn("second", F.col("q.term")).withColumn("apart", F.col("q.at") - inside).drop("q")
    asked = windows.select("term", "second", "apart", "place", F.size("words").alias("size"), "rest", "items")
    met = pairs.join(_small(asked), ["term", "second", "apart"])

    def both(starts: Column, t: Column) -> Column:
        shifted = F.transform(F.filter("lists", lambda p: p["term"] == t["term"]), lambda p: p["at"] - t["place"])
        return F.when(F.size(starts) == 0, starts).otherwise(F.array_intersect(starts, shifted))

    left = F.aggregate("rest", F.array(inside - F.col("place")), both)
    start = F.col("position") - F.col("place")
    return met.where(F.size(left) > 0).select("doc_id", "text_key", start.alias("start"), "size", "items")


def _needed(words: str, share: float) -> Column:
    return F.ceil(F.round(F.size(F.array_distinct(words)) * F.lit(share), 9)).cast("int")


def proximity_terms(windows: DataFrame, counts: DataFrame, share: float = SHARE) -> DataFrame:
    """``phrase``, ``words``, ``items`` and ``term``: of each window the rarest terms, one of which every match holds."""
    terms = windows.select("phrase", F.explode_outer(F.array_distinct("words")).alias("term")).join(counts, "term")
    ranked = terms.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("by_n"))
    rare = F.slice("by_n", F.lit(1), F.size("by_n") - _needed("words", share) + 1)
    rows = windows.select("phrase", "words", "items").join(ranked, "phrase")
    return rows.select("phrase", "words", "items", F.explode_outer(rare).alias("r")).select(
        "phrase", "words", "items", F.col("r.term").alias("term")
    )


def near_postings(stretches: DataFrame, windows: DataFrame, slop: int = SLOP, share: float = SHARE) -> DataFrame:
    """Postings, not stored, that have the hashes of enough words of a window of their term around them."""
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    core = F.slice("around", F.col("lead") + 1, F.lit(STRETCH))
    said = stretches.where("base IS NOT NULL").withColumn("keys", hashes(F.col("around")))
    said = said.select("doc_id", "text_key", "base", "lead", "around", "keys", F.posexplode_outer(core).alias("at", "term"))
    said = said.withColumn("inside", F.col("lead") + F.col("at"))
    asked = windows.select(
        F.col("term").alias("_term"), F.array_distinct(hashes(F.col("words"))).alias("_keys"),
        # two words with one hash count once, so as many fewer are asked for
        (_needed("words", share) - F.size(F.array_distinct("words")) + F.size(F.array_distinct(hashes(F.col("words"))))).alias("_needed"),
        (F.size("words") - 1 + 2 * slop).alias("_reach"),
    )
    low = F.greatest(F.col("inside") - F.col("_reach"), F.lit(0))
    near = F.slice("keys", low + 1, F.col("inside") - low + F.col("_reach") + 1)
    enough = F.size(F.array_intersect("_keys", near)) >= F.col("_needed")
    found = said.join(_small(asked), (F.col("term") == F.col("_term")) & enough, "left_semi")
    return found.select("term", "doc_id", "text_key", (F.col("base") + F.col("at")).alias("position"), "inside", "around")


def proximity_matches(postings: DataFrame, windows: DataFrame, slop: int = SLOP, share: float = SHARE) -> DataFrame:
    """Places where ``share`` of a window's distinct words stand, in any order, within its length and twice ``slop``.

    ``start`` is the first word of the first such place around the posting.
    """
    met = postings.select("doc_id", "text_key", "term", "position", "inside", "around")
    met = met.join(_small(windows.select("term", "phrase", "words", "items")), "term")
    reach = F.size("words") - 1 + 2 * slop
    met = met.withColumn("low", F.greatest(F.col("inside") - reach, F.lit(0)))
    met = met.withColumn("near", F.slice("around", F.col("low") + 1, F.col("inside") - F.col("low") + reach + 1))
    held = lambda said: F.size(F.array_intersect("words", said)) >= _needed("words", share)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("near") - reach))
    places = F.filter(starts, lambda at: held(F.slice("near", at, reach + 1)))
    met = met.where(held(F.col("near"))).withColumn("at", F.get(places, F.lit(0))).where("at IS NOT NULL")
    start = F.col("position") - F.col("inside") + F.col("low") + F.col("at") - 1
    return met.select("doc_id", "text_key", start.alias("start"), "phrase", "items").distinct()


def _covered(spans: Column) -> Column:
    """Number of words under sorted spans that may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["sum"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["end"]))).cast("long").alias("sum"),
        F.greatest(acc["end"], s["stop"]).alias("end"),
    )
    return F.aggregate(spans, zero, step, lambda acc: acc["sum"])


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The stored stretches of ``docs`` and the exact matches in them."""
    stretches = materialise(stretches_of(docs, window, window - 1).drop("around"), "stretches")
    windows = materialise(windows_of(items, window), "benchmark-windows")
    windows = materialise(looked_up(windows, term_counts(stretches, windows)), "benchmark-lookup")
    return stretches, materialise(exact_matches(postings_of(stretches, windows), windows, window), "matches")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in whose text no window occurs."""
    _, found = find_matches(docs, items, window)
    texts = found.select(F.col("text_key").alias("_text_key")).distinct()
    return with_row_key(docs).join(_small(texts), "_text_key", "left_anti").select(*docs.columns)


def _exact_hits(found: DataFrame) -> DataFrame:
    span = F.struct("start", (F.col("start") + F.col("size")).alias("stop"))
    hits = found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids")
    )
    return hits.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), _covered(F.col("spans")).alias("_hit"), "ids")


def _near_hits(near: DataFrame) -> DataFrame:
    return near.groupBy(F.col("doc_id").alias("_near_doc"), F.col("text_key").alias("_near_key")).agg(
        F.size(F.collect_set("phrase")).cast("long").alias("_near"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("near_ids"),
    )


def _sha256(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ",").cast("binary"), 256)


def _report(stretches: DataFrame, found: DataFrame, near: DataFrame | None = None) -> DataFrame:
    rows = stretches.where("base IS NULL OR base = 0").select("doc_id", "text_key", "n_words")
    hits = _exact_hits(found)
    rows = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_doc"]) & (rows["text_key"] == hits["_key"]), "left")
    none = F.array().cast("array<string>")
    ids = F.coalesce("ids", none)
    columns = [
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        _sha256(ids).alias("items_sha256"),
        (F.coalesce("_hit", F.lit(0)) > 0).alias("contaminated"),
    ]
    if near is not None:
        hits, near_ids = _near_hits(near), F.coalesce("near_ids", none)
        rows = rows.join(hits, F.col("doc_id").eqNullSafe(hits["_near_doc"]) & (F.col("text_key") == hits["_near_key"]), "left")
        columns += [
            F.coalesce("_near", F.lit(0)).cast("long").alias("n_near_windows"),
            F.size(near_ids).cast("long").alias("n_near_items"),
            _sha256(near_ids).alias("near_items_sha256"),
            (F.coalesce("_near", F.lit(0)) > 0).alias("near"),
        ]
    return rows.select(*columns)


def decontamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, the words inside occurrences of windows, and the items found."""
    return _report(*find_matches(docs, items, window))


def proximity_report(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, share: float = SHARE) -> DataFrame:
    """``decontamination_report`` and the windows and items that have proximity matches; an exact match is one too."""
    stretches = materialise(stretches_of(docs, window, window - 1 + 2 * slop), "stretches")
    windows = materialise(windows_of(items, window), "benchmark-windows")
    counts = materialise(term_counts(stretches, windows), "benchmark-terms")
    exact = materialise(looked_up(windows, counts), "benchmark-lookup")
    rare = materialise(proximity_terms(windows, counts, share), "benchmark-rare")
    found = exact_matches(postings_of(stretches, exact), exact, window)
    near = proximity_matches(near_postings(stretches, rare, slop, share), rare, slop, share)
    return _report(stretches, found, near)
