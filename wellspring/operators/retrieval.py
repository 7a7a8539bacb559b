"""TF-IDF index and cosine search over text chunks, with an event boost."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspring.constants import BOOST_FACTOR, BOOST_OFFSET, QUERY_PHRASE
from wellspring.functions.text import tokens
from wellspring.session import materialise, scratch_path

CHUNK_ORDER = ["doc_name", "section_no"]
BROADCAST_ROWS = 500_000  # (query, term) rows that may be sent to every executor
REACH_SLACK = 1e-9  # covers rounding in the comparison of a bound with a score
SHARD_LETTERS = 16_000_000  # of a shard, whose grams one task counts at once
ARROW_ROWS = 65_536
SEARCH_BLOCK, CELLS = 256, 4_000_000  # queries at once, and terms times chunks
PAIR_COST = 100  # of a pair of a query and a posting, in products of a matrix
SCORE_DIGITS = 10  # scores that differ only by summation order rank by chunk order


@dataclass
class Index:
    """``chunks`` (chunk_id, ...), ``idf`` (term, idf) and ``postings`` (chunk_id, term, weight).

    ``asked`` gives the postings of some terms where that is cheaper than to choose from all.
    """

    chunks: DataFrame
    idf: DataFrame
    postings: DataFrame
    asked: Callable[[list[str]], DataFrame] | None = None

    def postings_of(self, terms: DataFrame, most: int) -> DataFrame:
        """Postings of a table of distinct terms; up to ``most`` of these may be sent to the tasks."""
        if self.asked and len(few := terms.limit(most + 1).collect()) <= most:
            return self.asked([r["term"] for r in few])
        return self.postings.join(terms, "term", "left_semi")

    def among(self, counts: DataFrame, most: int) -> Index:
        """The same index with the idf of the terms in ``counts`` only, stored; up to ``most`` of these may be broadcast."""
        terms = counts.select("term").distinct()
        small = terms.limit(most + 1).count() <= most
        idf = self.idf.join(F.broadcast(terms) if small else terms, "term", "left_semi")
        return replace(self, idf=materialise(idf, "asked-idf"))

    def save(self, path: str) -> None:
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.idf.write.mode("overwrite").parquet(f"{path}/idf")
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str) -> Index:
    """A saved index; reading fails when there is none."""
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("chunks", "idf", "postings")))


def task_count(spark: SparkSession) -> int:
    """Partitions for rows that are few but turn into many."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Occurrences of every gram per row of ``df``.

    The texts are placed by key before they are cut up, so counting their grams needs
    no further shuffle. The number of partitions is given: sized by the short texts it
    would be too small for the grams.
    """
    return gram_counts(worded(df, F.col(key), text=text).repartition(task_count(df.sparkSession), key), [key])


def worded(df: DataFrame, *keys: Column, text: str) -> DataFrame:
    """The tokens of a text with a blank between them, which is what is placed instead of the text."""
    return df.select(*keys, F.array_join(tokens(F.col(text)), " ").alias("words"))


def gram_counts(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences of every gram of ``words`` by ``keys``, without a shuffle where rows are placed by these."""
    words = F.split(F.nullif("words", F.lit("")), " ")
    pairs = F.arrays_zip(words.alias("word"), F.slice(words, 2, F.size(words)).alias("following"))
    # explode_outer: the plain form makes the optimizer evaluate the pairs twice
    pair = placed.select(*keys, F.explode_outer(pairs).alias("pair"))
    both = F.array(F.col("pair.word"), F.concat("pair.word", F.lit(" "), "pair.following"))
    exploded = pair.select(*keys, F.explode_outer(both).alias("term"))
    return exploded.filter("term IS NOT NULL").groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def unit_weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Sublinear tf times idf, scaled to length 1 per ``key``; unknown terms drop out.

    The result stays partitioned by ``key``.
    """
    raw = counts.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.col("raw") / norm).drop("raw")


def fit_index(chunks: DataFrame, store: bool = True) -> Index:
    """TF-IDF over unigrams and bigrams of the chunk contents.

    Postings are many times the text, so they are not shuffled and not kept as strings: the words are stored once and
    placed by shards, packed, and numpy counts the grams of a shard as numbers. A shard names each of its distinct terms
    once, packed in order by target, where equal terms meet; the frequencies come back in the same order without the
    terms and meet the postings, which are counted anew. ``store`` writes chunks, idf and postings to the shared folder,
    for an index that many searches read; a single search needs none.
    """
    def keep(df: DataFrame, name: str) -> DataFrame:
        return materialise(df, name) if store else df

    chunks = keep(chunks, "chunks")
    spark = chunks.sparkSession
    words, path = worded(chunks, F.col("chunk_id"), text="content"), scratch_path(spark, "words")
    words.write.option("compression", "zstd").parquet(path)
    words = spark.read.schema(words.schema).parquet(path)
    n, letters = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    shards = max(task_count(spark), letters // SHARD_LETTERS)
    places = 4 * shards  # more than shards, so that few of these share a task
    shard = F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard")
    packed = words.select(shard, "chunk_id", "words").mapInArrow(_packed_shards, "shard int, packed binary")
    placed = packed.repartition(places, "shard")
    named = placed.groupBy("shard").applyInArrow(lambda words: _named_terms(words, shards), "target int, shard int, packed binary")
    met = named.repartition(places, "target").groupBy("target").applyInArrow(
        _frequencies, "target int, shard int, told binary, terms binary"
    )
    known = materialise(met, "frequencies")
    of_terms = known.filter("terms IS NOT NULL").select("terms").mapInArrow(_unpacked_rows, "term string, chunks long")
    idf = of_terms.select("term", idf_of("chunks", n).alias("idf"))
    told = known.filter("told IS NOT NULL").select("target", "shard", "told").repartition(places, "shard")
    kind = dict(chunks.dtypes)["chunk_id"]

    def postings(asked: list[str] | None = None) -> DataFrame:
        wanted = None if asked is None else spark.sparkContext.broadcast(asked)

        def weighed(words: pa.Table, frequencies: pa.Table) -> pa.Table:
            return _weighed(words, frequencies, shards, n, None if wanted is None else pa.array(wanted.value, pa.string()))

        both = placed.groupBy("shard").cogroup(told.groupBy("shard"))
        return both.applyInArrow(weighed, f"chunk_id {kind}, term string, weight double")

    return Index(chunks, keep(idf, "idf"), keep(postings(), "postings"), None if store else postings)


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
    with pa.ipc.new_stream(sink, table.schema, options=options) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: pa.ChunkedArray) -> list[pa.Table]:
    return [pa.ipc.open_stream(p.as_buffer()).read_all() for chunk in packed.chunks for p in chunk]


def _packed_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each shard as one value, of a part of a task of limited size."""
    held: list[pa.RecordBatch] = []

    def flushed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        shard = table.column("shard").to_numpy()
        order = np.argsort(shard, kind="stable")
        found, first = np.unique(shard[order], return_index=True)
        rows = table.drop_columns("shard").take(pa.array(order))
        packed = [_pack(rows.slice(low, high - low)) for low, high in zip(first, [*first[1:], len(order)])]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(packed, pa.binary())], ["shard", "packed"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) > SHARD_LETTERS:
            yield flushed()
    if held:
        yield flushed()


def _unpacked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for table in _unpack(pa.chunked_array([batch.column(0)])):
            yield from table.to_batches(max_chunksize=ARROW_ROWS)


def _counted(placed: pa.Table, targets: int) -> tuple:
    """Grams of a shard: the chunks, and by posting the place of its chunk, the number of its term and the count; then the
    target of each term and a function that gives the terms of some numbers.

    A term's number is its place among the shard's terms, whatever way the rows lie; its target hangs on its first word.
    """
    words = pa.concat_tables(_unpack(placed.column("packed")))
    ids = words.column("chunk_id").combine_chunks().dictionary_encode(null_encoding="encode")
    lists = pc.split_pattern(words.column("words").combine_chunks(), " ")
    row = pc.list_parent_indices(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    coded = coded.filter(keep := pc.not_equal(coded.dictionary, "").take(coded.indices)) if len(coded) else coded
    row = row[keep.to_numpy(zero_copy_only=False)] if len(row) else row
    order = pc.sort_indices(coded.dictionary).to_numpy()
    known = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word = rank[coded.indices.to_numpy()] if len(order) else np.empty(0, np.int64)
    width = len(known) + 1
    follows = row[1:] == row[:-1]
    keys = np.concatenate([word * width, (word[:-1] * width + 1 + word[1:])[follows]])
    chunk = ids.indices.to_numpy()[np.concatenate([row, row[1:][follows]])].astype(np.int64)
    distinct, local = np.unique(keys, return_inverse=True)
    pair, tf = np.unique(chunk * max(len(distinct), 1) + local, return_counts=True)
    chunk, local = np.divmod(pair, max(len(distinct), 1))

    def terms(numbers: np.ndarray) -> pa.Array:
        first, second = np.divmod(distinct[numbers], width)
        one = known.take(pa.array(first))
        two = known.take(pa.array(np.maximum(second - 1, 0), mask=second == 0))
        return pc.binary_join_element_wise(one, two, " ", null_handling="skip")

    of_word = np.array([zlib.crc32(word.encode()) % targets for word in known.to_pylist()], np.int32)
    target = of_word[distinct // width] if len(distinct) else np.empty(0, np.int32)
    return ids.dictionary, chunk, local, tf, target, terms


def _named_terms(placed: pa.Table, targets: int) -> pa.Table:
    """The distinct terms of a shard in their order, packed by target, with how many chunks of the shard hold each."""
    _, _, local, _, target, terms = _counted(placed, targets)
    held = np.bincount(local).astype(np.int32)
    rows: list[tuple] = []
    for to, numbers in _by_target(target):
        rows.append((to, placed.column("shard")[0].as_py(), _pack(pa.table({"term": terms(numbers), "n": held[numbers]}))))
    columns = zip(*rows) if rows else ([], [], [])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], ["target", "shard", "packed"])


def _by_target(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of the terms of each target, in order."""
    order = np.argsort(target, kind="stable")
    found, first = np.unique(target[order], return_index=True)
    for to, low, high in zip(found.tolist(), first, [*first[1:], len(order)]):
        yield to, order[low:high]


def _frequencies(named: pa.Table) -> pa.Table:
    """For each shard how many chunks hold its terms, in its order, and once all terms of the target with that number."""
    tables = _unpack(named.column("packed"))
    coded = pa.concat_tables(tables).column("term").combine_chunks().dictionary_encode()
    places = coded.indices.to_numpy()
    chunks = np.bincount(places, weights=np.concatenate([t.column("n").to_numpy() for t in tables])).astype(np.int64)
    ends = np.cumsum([t.num_rows for t in tables])
    told = [_pack(pa.table({"chunks": chunks[places[high - t.num_rows : high]]})) for t, high in zip(tables, ends)]
    target = named.column("target")[0].as_py()
    every = _pack(pa.table({"term": coded.dictionary, "chunks": chunks}))
    columns = ([target] * (len(told) + 1), [*named.column("shard").to_pylist(), None], [*told, None], [None] * len(told) + [every])
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["target", "shard", "told", "terms"])


def _weighed(placed: pa.Table, frequencies: pa.Table, targets: int, n: int, asked: pa.Array | None) -> pa.Table:
    """Postings of a shard, of all its terms or of those asked: sublinear tf times idf, scaled to length 1 by chunk."""
    ids, chunk, local, tf, target, terms = _counted(placed, targets)
    told = dict(zip(frequencies.column("target").to_pylist(), _unpack(frequencies.column("told"))))
    held = np.zeros(len(target))
    for to, numbers in _by_target(target):
        held[numbers] = told[to].column("chunks").to_numpy()
    raw = (1 + np.log(tf)) * (np.log((1 + n) / (1 + held)) + 1)[local]
    norm = np.sqrt(np.bincount(chunk, weights=raw * raw, minlength=len(ids)))
    if asked is not None:
        hit = pc.is_in(terms(np.arange(len(held))), value_set=asked).to_numpy(zero_copy_only=False)[local]
        chunk, local, raw = chunk[hit], local[hit], raw[hit]
    weight = raw / norm[chunk]
    schema = pa.schema([("chunk_id", ids.type), ("term", pa.string()), ("weight", pa.float64())])
    parts = [
        pa.RecordBatch.from_arrays([ids.take(pa.array(chunk[part])), terms(local[part]), pa.array(weight[part])], schema=schema)
        for part in (slice(low, low + ARROW_ROWS) for low in range(0, len(weight), ARROW_ROWS))
    ]
    return pa.Table.from_batches(parts, schema)


def idf_of(chunks: str, n: int) -> Column:
    """Inverse document frequency of a term that ``chunks`` of ``n`` chunks hold."""
    return F.log((1 + n) / (1 + F.col(chunks))) + 1


def search(
    queries: DataFrame,
    index: Index,
    top_k: int = 4,
    event: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Best ``top_k`` chunks for each query: (query_id, rank, score, chunk columns).

    ``queries`` has query_id and query; ``event`` names its column with the event
    whose chunks are boosted. The result equals scoring every chunk:

    * A chunk that shares no term with the query scores 0 (before the boost), so of
      those the first ``top_k`` in chunk order, and the first of the query's event,
      are candidates enough.
    * With an event, its own chunks are ranked first. Another chunk scores at most
      its ``reach``, the length of its vector over the asked terms, because the
      query's vector has length 1; where that is below the score already held by
      ``top_k`` own chunks, the chunk cannot come in and is not scored.
    """
    parts = task_count(queries.sparkSession)
    wanted = queries.select("query_id", (F.col(event) if event else F.lit(None).cast("int")).alias("wanted_event"))
    counts = materialise(term_counts(queries, "query_id", "query"), "query-terms")
    index = index.among(counts, broadcast_rows)
    weights = materialise(
        unit_weights(counts, index.idf, "query_id")
        .withColumnRenamed("weight", "query_weight")
        .join(wanted, "query_id"),
        "query-weights",
    )
    small = weights.limit(broadcast_rows + 1).count() <= broadcast_rows
    order = index.chunks.select("chunk_id", "event_id", *CHUNK_ORDER)
    in_chunk = Window.partitionBy("chunk_id")
    asked = materialise(
        index.postings_of(weights.select("term").distinct(), broadcast_rows)
        .join(order, "chunk_id")
        .withColumn("reach", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(in_chunk))),
        "asked-postings",
    )
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), *CHUNK_ORDER)

    def best(postings: DataFrame, asking: DataFrame, condition: Column, side: str) -> DataFrame:
        if small:
            return leading(boosted(_products(postings.repartition(parts, "chunk_id"), asking, side, top_k)))
        # A few postings can meet many queries, so their number of partitions is
        # given; the products of a chunk then meet without another shuffle.
        pairs = postings.repartition(parts, "chunk_id").join(asking, (postings["term"] == asking["term"]) & condition)
        scores = pairs.groupBy("chunk_id", "event_id", *CHUNK_ORDER, "query_id", "wanted_event").agg(
            F.sum(F.col("weight") * F.col("query_weight")).alias("score")
        )
        return leading(boosted(scores))

    def leading(scores: DataFrame) -> DataFrame:
        # the row_number filter also runs on each input partition before the shuffle
        ranked = scores.withColumn("rank", F.row_number().over(by_score))
        return ranked.filter(F.col("rank") <= top_k).drop("rank")

    first = order.orderBy(*CHUNK_ORDER).limit(top_k).collect()
    rows = F.array(*[F.struct(*[F.lit(row[c]).alias(c) for c in order.columns]) for row in first])
    fill = wanted.withColumn("first", F.explode_outer(rows)).select("query_id", "wanted_event", "first.*")
    fill = boosted(fill.withColumn("score", F.lit(0.0)))
    if event:
        in_event = Window.partitionBy("event_id").orderBy(*CHUNK_ORDER)
        of_event = order.withColumn("place", F.row_number().over(in_event)).filter(F.col("place") <= top_k)
        unmatched = wanted.join(of_event, wanted["wanted_event"] == of_event["event_id"])
        own = best(asked, weights, asked["event_id"] == weights["wanted_event"], "own")
        own = own.union(boosted(unmatched.withColumn("score", F.lit(0.0))))
        own = materialise(leading(unrepeated(own)), "own-chunks")
        held = own.groupBy("query_id").agg(
            F.when(F.count("*") >= top_k, F.min("score")).otherwise(0.0).alias("held")
        )
        asking = weights.join(held, "query_id", "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
        asking = materialise(asking, "asking")
        lowest = asking.agg(F.min("held")).first()[0] or 0.0
        reachable = asked.filter(F.col("reach") >= lowest - REACH_SLACK)
        others = best(
            reachable,
            asking,
            (~reachable["event_id"].eqNullSafe(asking["wanted_event"]))
            & (reachable["reach"] >= asking["held"] - REACH_SLACK),
            "others",
        )
        found = own.union(others).union(fill)
    else:
        found = best(asked, weights, F.lit(True), "all").union(fill)
    ranked = unrepeated(found).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", "score", "chunk_id").join(index.chunks, "chunk_id")


def _products(postings: DataFrame, asking: DataFrame, side: str, top_k: int) -> DataFrame:
    """Scores of the best chunks of each query in every task, as products of matrices and not as pairs of rows.

    ``side``: ``own`` for chunks of the query's event, ``others`` for those that are not and whose reach is enough,
    ``all`` for every chunk. What leaves a task is bounded by the queries.
    """
    columns = ["query_id", "wanted_event", "term", "query_weight", "held"]
    rows = asking if "held" in asking.columns else asking.withColumn("held", F.lit(0.0))
    told = rows.select(*columns).orderBy("wanted_event", "query_id").toArrow().unify_dictionaries().combine_chunks()
    for i, name in ((0, "query_id"), (2, "term")):
        told = told.set_column(i, name, pc.dictionary_encode(told.column(name)).combine_chunks())
    sent = asking.sparkSession.sparkContext.broadcast(_pack(told))
    kinds = dict(postings.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("chunk_id", "event_id", *CHUNK_ORDER))
    schema += f", query_id {dict(asking.dtypes)['query_id']}, wanted_event {dict(asking.dtypes)['wanted_event']}, score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            queries = pa.ipc.open_stream(pa.py_buffer(sent.value)).read_all()
            yield from _best_chunks(pa.Table.from_batches(held), queries, side, top_k)

    return postings.select("chunk_id", "event_id", *CHUNK_ORDER, "term", "weight", "reach").mapInArrow(scored, schema)


def _best_chunks(postings: pa.Table, queries: pa.Table, side: str, top_k: int) -> Iterator[pa.RecordBatch]:
    """The best chunks of each query among the postings of a task, ties in chunk order."""
    names = ["chunk_id", "event_id", *CHUNK_ORDER]
    keyed = postings.append_column("row", pa.array(np.arange(postings.num_rows)))
    chunks = keyed.group_by(names).aggregate([("row", "min")])
    chunks = chunks.take(pc.sort_indices(chunks, sort_keys=[(c, "ascending") for c in CHUNK_ORDER], null_placement="at_start"))
    terms = queries.column("term").combine_chunks()
    # null keys meet nothing in Arrow's joins, so the place comes from the first row of each chunk's group
    ids = [postings.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in names]
    _, group = np.unique(np.stack(ids, 1), axis=0, return_inverse=True)
    place_of = np.empty(len(chunks), np.int64)
    place_of[group.ravel()[chunks.column("row_min").to_numpy()]] = np.arange(chunks.num_rows)
    place = place_of[group.ravel()]
    term = pc.index_in(postings.column("term").combine_chunks(), value_set=terms.dictionary.cast(pa.string()))
    known = term.is_valid().to_numpy(zero_copy_only=False)
    place, term = place[known], term.to_numpy(zero_copy_only=False)[known].astype(np.int64)
    weight, reach = postings.column("weight").to_numpy()[known], np.zeros(chunks.num_rows)
    reach[place] = postings.column("reach").to_numpy()[known]
    order = np.argsort(place, kind="stable")
    place, term, weight = place[order], term[order], weight[order]

    number = queries.column("query_id").combine_chunks()
    query, asked = number.indices.to_numpy().astype(np.int64), terms.indices.to_numpy().astype(np.int64)
    event = queries.column("wanted_event").to_pandas().astype("Float64").fillna(-(2.0**40)).to_numpy(float)
    of_chunk = chunks.column("event_id").to_pandas().astype("Float64").fillna(-(2.0**41 if side == "own" else 2.0**40)).to_numpy(float)
    share, enough = queries.column("query_weight").to_numpy(), queries.column("held").to_numpy()
    found = []
    for wanted in np.unique(event) if side != "all" else [None]:
        rows = np.flatnonzero(event == wanted) if wanted is not None else np.arange(len(query))
        fits = np.ones(len(of_chunk), bool) if wanted is None else of_chunk == wanted if side == "own" else of_chunk != wanted
        numbers = np.unique(query[rows])
        for low in range(0, len(numbers), SEARCH_BLOCK):
            block = numbers[low : low + SEARCH_BLOCK]
            some = rows[np.isin(query[rows], block)]
            words, at = np.unique(asked[some], return_inverse=True)
            limit, row = np.zeros(len(block)), np.searchsorted(block, query[some])
            limit[row] = enough[some]
            product = _Product(row, at, share[some], len(block), len(words))
            width = min(VECTOR_TILE, max(64, CELLS // len(words)))
            inside = fits & (reach >= limit.min() - REACH_SLACK) if side == "others" else fits
            column = np.full(len(terms.dictionary), -1)
            column[words] = np.arange(len(words))
            used = np.flatnonzero(inside[place] & (column[term] >= 0))
            if not len(used):
                continue
            held_place, compact = np.unique(place[used], return_inverse=True)
            start = np.searchsorted(compact, np.arange(0, len(held_place) + width, width))
            best_score, best_place = np.full((len(block), 0), 0.0), np.full((len(block), 0), 0)
            for tile, (first, last) in enumerate(zip(start[:-1], start[1:])):
                if first == last:
                    continue
                base, part = tile * width, used[first:last]
                size = min(width, len(held_place) - base)
                scores = product.with_postings(column[term[part]], compact[first:last] - base, weight[part], size)
                places = np.broadcast_to(held_place[base : base + size], scores.shape)
                if side == "others":
                    scores[limit[:, None] - REACH_SLACK > reach[places]] = -1.0
                best_score = np.hstack([best_score, scores])
                best_place = np.hstack([best_place, places])
                best_score, best_place = _foremost(best_score, best_place, top_k, side == "own")
            line, rank = np.nonzero(best_score > 0)
            found.append((block[line], best_place[line, rank], best_score[line, rank], np.full(len(line), np.nan if wanted is None else wanted)))
    if not found:
        return
    block, at, score, wanted = (np.concatenate(x) for x in zip(*found))
    wanted = pa.array(wanted, pa.float64(), mask=np.isnan(wanted) | (wanted <= -(2.0**40))).cast(queries.schema.field("wanted_event").type)
    columns = [chunks.column(c).combine_chunks().take(pa.array(at)) for c in names]
    columns += [number.dictionary.take(pa.array(block)), wanted, pa.array(score)]
    table = pa.table(columns, [*names, "query_id", "wanted_event", "score"])
    yield from table.to_batches(max_chunksize=ARROW_ROWS)


class _Product:
    """Weights of a block of queries by term, to be multiplied with the postings of some chunks."""

    def __init__(self, row: np.ndarray, term: np.ndarray, share: np.ndarray, rows: int, terms: int):
        order = np.argsort(term, kind="stable")
        self.row, self.share, self.rows = row[order], share[order], rows
        self.first = np.searchsorted(term[order], np.arange(terms + 1))
        self.matrix = None

    def with_postings(self, term: np.ndarray, column: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        """Queries by chunks: as a product of matrices, or over the pairs with a common term where these are few."""
        met = self.first[term + 1] - self.first[term]
        terms, pairs = len(self.first) - 1, int(met.sum())
        if pairs * PAIR_COST > self.rows * terms * size:
            if self.matrix is None:
                self.matrix = np.zeros((self.rows, terms))
                np.add.at(self.matrix, (self.row, np.repeat(np.arange(terms), np.diff(self.first))), self.share)
            vectors = np.zeros((terms, size))
            np.add.at(vectors, (term, column), weight)
            return self.matrix @ vectors
        posting = np.repeat(np.arange(len(term)), met)
        asking = np.arange(pairs) + np.repeat(self.first[term] - (np.cumsum(met) - met), met)
        scores = np.zeros(self.rows * size)
        np.add.at(scores, self.row[asking] * size + column[posting], self.share[asking] * weight[posting])
        return scores.reshape(self.rows, size)


def _foremost(scores: np.ndarray, places: np.ndarray, top_k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ``top_k`` highest scores of each row as they rank, the first of equal ones first; columns are in chunk order."""
    ranked = np.round(scores * BOOST_FACTOR + BOOST_OFFSET if own else scores, SCORE_DIGITS)
    every = np.arange(len(scores))
    chosen = []
    for _ in range(min(top_k, scores.shape[1])):
        at = ranked.argmax(1)
        chosen.append(at)
        ranked[every, at] = -np.inf
    at = np.sort(np.stack(chosen, 1), axis=1)  # back in chunk order
    return np.take_along_axis(scores, at, 1), np.take_along_axis(places, at, 1)


def boosted(scores: DataFrame) -> DataFrame:
    """Raise the score of chunks of the wanted event; keep what ranking needs."""
    score = F.col("score")
    raised = F.when(F.col("event_id") == F.col("wanted_event"), score * BOOST_FACTOR + BOOST_OFFSET).otherwise(score)
    return scores.select("query_id", "chunk_id", *CHUNK_ORDER, F.round(raised, SCORE_DIGITS).alias("score"))


def unrepeated(scores: DataFrame) -> DataFrame:
    """A chunk found as match and as fill keeps its real, higher score."""
    return scores.groupBy("query_id", "chunk_id", *CHUNK_ORDER).agg(F.max("score").alias("score"))


def build_query(event_id: Column, event_name: Column, evidence: Column | None = None) -> Column:
    """Query text from the event and what the deviating sensors show."""
    parts = [F.concat(F.lit("Event "), event_id.cast("string"), F.lit(": "), event_name), F.lit(QUERY_PHRASE)]
    if evidence is not None:
        symptoms = F.transform(evidence, lambda e: F.concat_ws(" ", e["sensor"], e["status"], e["significance"]))
        parts.append(F.nullif(F.array_join(symptoms, " "), F.lit("")))
    return F.concat_ws(" ", *parts)


def retrieve_fault_knowledge(incidents: DataFrame, index: Index, top_k: int = 3) -> DataFrame:
    """Best chunks for all incidents at once: (id, rank, score, chunk columns).

    ``incidents`` has id, event_id, event_name and evidence. Incidents whose query has
    the same terms known to the index share one search.
    """
    asked = incidents.select(
        "id",
        F.col("event_id").alias("wanted_event"),
        build_query(F.col("event_id"), F.col("event_name"), F.col("evidence")).alias("query"),
    )
    asked = materialise(asked.withColumn("query_id", F.md5(F.concat_ws("|", "wanted_event", "query"))), "incident-queries")
    distinct = asked.groupBy("query_id").agg(F.first("wanted_event").alias("wanted_event"), F.first("query").alias("query"))
    counts = materialise(term_counts(distinct, "query_id", "query"), "incident-terms")
    index = index.among(counts, BROADCAST_ROWS)
    counts = counts.join(index.idf.select("term"), "term", "left_semi")
    bags = counts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("bag")
    )
    named = distinct.join(bags, "query_id", "left").select(
        F.col("query_id").alias("asked_id"),
        "wanted_event",
        "query",
        F.md5(F.to_json(F.struct("wanted_event", "bag"))).alias("query_id"),
    )
    named = materialise(named, "query-groups")
    groups = named.groupBy("query_id").agg(F.first("wanted_event").alias("wanted_event"), F.min("query").alias("query"))
    found = search(groups, index, top_k, "wanted_event")
    pairs = asked.select("id", F.col("query_id").alias("asked_id")).join(named.select("asked_id", "query_id"), "asked_id")
    return pairs.join(found, "query_id").drop("asked_id", "query_id")


def dense_topk(
    vectors: DataFrame,
    queries: DataFrame,
    top_k: int = 4,
    vector: str = "embedding",
    key: str = "vec_id",
    label: str | None = "label",
) -> DataFrame:
    """Cosine ranking of stored vectors for a table of queries (query_id, vector): query_id, key, score, rank.

    Queries are packed into blocks and vectors into tiles, one row each; every tile meets every block
    as a product of two matrices. A task keeps the best ``top_k`` of a query over all its tiles, so
    what leaves it is bounded by the queries and not by the vectors; the partial lists are merged by
    query. A query's number boosts the vectors whose ``label`` equals it. A vector that is null, of
    length 0 or of another dimension than the query scores 0; null queries are left out; ties go
    to the smaller key.
    """
    asked = queries.select(F.col("query_id").cast("long"), F.transform("vector", lambda v: v.cast("double")).alias("x"))
    asked = materialise(asked.filter("x IS NOT NULL AND query_id IS NOT NULL"), "dense-queries")
    blocks = -(-asked.count() // QUERY_BLOCK) or 1  # the hash deals evenly enough for blocks of near that size
    packed = asked.withColumn("size", F.size("x")).groupBy("size", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    packed = packed.agg(F.array_sort(F.collect_list(F.struct("query_id", "x"))).alias("q"))
    packed = packed.select("size", "block", "q.query_id", F.col("q.x").alias("queries"))
    rows = vectors.select(
        F.col(key).cast("long").alias("key"), F.transform(vector, lambda v: v.cast("double")).alias("x"),
        (F.col(label).cast("long") if label else F.lit(None).cast("long")).alias("label"),
    )
    met = rows.mapInArrow(_tiles, TILES).crossJoin(packed)  # blocks of the asked queries, not pairs of rows
    found = met.mapInPandas(lambda frames: _best(frames, top_k), PARTIAL)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top_k)
    return ranked.select("query_id", F.col("key").alias(key), "score", "rank")


QUERY_BLOCK, VECTOR_TILE = 512, 2048
TILES = "keys array<long>, labels array<long>, vectors array<array<double>>"
PARTIAL = "query_id long, key long, score double"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``VECTOR_TILE`` vectors."""
    for batch in batches:
        for start in range(0, batch.num_rows, VECTOR_TILE):
            some = batch.slice(start, VECTOR_TILE)
            one = [pa.array([some.column(name).to_pylist()], pa.list_(some.schema.field(name).type)) for name in ("key", "label", "x")]
            yield pa.RecordBatch.from_arrays(one, ["keys", "labels", "vectors"])


def _matrix(vectors, size: int) -> np.ndarray:
    """Vectors of length 1 as rows; zeros for those that are null, zero or of another size."""
    out = np.zeros((len(vectors), size))
    for i, values in enumerate(vectors):
        if values is not None and len(values) == size:
            out[i] = values
    return _unit(out)


def _best(frames: Iterator[pd.DataFrame], top_k: int) -> Iterator[pd.DataFrame]:
    """The best vectors of each query over all tiles of a task."""
    kept: dict[tuple, tuple] = {}
    for frame in frames:
        for row in frame.itertuples():
            numbers = np.array(row.query_id, np.int64)
            keys, scores = kept.get((row.size, row.block), (np.empty((len(numbers), 0), np.int64), np.empty((len(numbers), 0)), None))[:2]
            found = _matrix(row.queries, row.size) @ _matrix(row.vectors, row.size).T
            labels = pd.Series(row.labels, dtype="float64").to_numpy()  # null is equal to nothing
            found = np.where(numbers[:, None] == labels[None, :], found * BOOST_FACTOR + BOOST_OFFSET, found)
            scores = np.hstack([scores, np.round(found, 8)])
            keys = np.hstack([keys, np.broadcast_to(np.array(row.keys, np.int64), found.shape)])
            order = np.lexsort((keys, -scores), axis=1)[:, :top_k]
            kept[row.size, row.block] = np.take_along_axis(keys, order, 1), np.take_along_axis(scores, order, 1), numbers
    for keys, scores, numbers in kept.values():
        yield pd.DataFrame({"query_id": np.repeat(numbers, keys.shape[1]), "key": keys.ravel(), "score": scores.ravel()})


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
