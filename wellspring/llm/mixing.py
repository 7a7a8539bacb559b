"""Mixing sources to target weights by blocks of words.

Each source is a stream of words, its documents in the order of a hash bucket and the id, cut
into blocks of ``BLOCK`` words. A source's target gives it a number of slots. Slot i of pass e
shows block (a i + b) mod n, with a prime multiplier a and a shift b drawn from source and
pass: a permutation of the n blocks, so no block is shown twice before all were shown once.
Each slot falls to an output shard by a hash, which makes the counts of a source over the
shards a multinomial draw whose sum is the source's slots (``shard_counts``). Blocks meet their
slots in a join by source and block number, so a large source is spread over all tasks.
``write_mix`` writes the blocks shard by shard, within a shard in a pseudorandom order.

Word offsets come from sums within hash buckets of about ``BUCKET_ROWS`` documents and over the
buckets, never from one window over a source. Only built-in functions are used.

Defined results: null, empty and blank texts have size 0 and are never shown; a null source is
a source of its own, behind all others; repeated rows are documents of their own; with no
words at all every target is 0; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.shared import ROW_KEY, WORD, materialise, whole_text, with_row_key

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, BUCKET_ROWS, SLOTS_PER_SHARD, SLOTS_AT_ONCE = 128, 4096, 1024, 100_000
MULTIPLIERS = (2147483647, 2147483629, 2147483587, 2147483579)
MOST_BROADCAST = 100_000


def number_of(key: Column) -> Column:
    """A whole number below 2 ** 32 from the md5 of a string."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, its number, size, documents, ``target`` words, blocks and slots. ``sizes``: source, size.

    A source is full when its equal share by weight of what is left reaches its limit; taking
    the sources in the order of limit by weight settles all of them in one pass.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = materialise(sources, "mix-sources")
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sources.withColumn("source_no", F.row_number().over(by_name))
    choice = F.lit(weights[0])
    for i, w in enumerate(weights):
        choice = F.when((F.col("source_no") - 1) % len(weights) == i, F.lit(w)).otherwise(choice)
    ranked = ranked.withColumn("weight", choice).withColumn("limit", F.col("source_size") * most)
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("limit").over(before), zero)) / F.sum("weight").over(rest)
    full = ranked.withColumn("_total", total).withColumn("full", F.col("limit") / F.col("weight") <= level)
    full_sum = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(zero)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), zero).otherwise(F.col("weight"))).over(everything)
    fair = F.try_divide(F.col("_total") - full_sum, open_weight) * F.col("weight")
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(fair)
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    out = full.withColumn("target", target).withColumn("blocks", blocks)
    slots = F.least(
        F.col("blocks") * int(most), F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long")
    )
    slots = F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0))
    return out.select("source", "source_no", "source_size", "n_docs", "target", "blocks", slots.cast("long").alias("slots"))


def slot_table(sources: DataFrame, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """``source_no``, ``pass``, ``slot``, ``block``, ``shard`` of every slot of the mix."""
    step = SLOTS_AT_ONCE
    # a given number of partitions, since few source rows become many slots behind the exchange
    parts = sources.agg(F.sum(F.ceil(F.col("slots") / step))).first()[0] or 1
    shards = F.ceil(F.sum("slots").over(Window.partitionBy()) / slots_per_shard)
    rows = sources.withColumn("shards", shards).where("slots > 0")
    rows = rows.withColumn("_from", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(step).cast("long"))))
    rows = rows.repartition(int(parts), "source_no", "_from")
    upto = F.least(F.col("_from") + step, F.col("slots")) - 1
    rows = rows.withColumn("slot", F.explode_outer(F.sequence(F.col("_from"), upto)))
    which = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    seed = F.concat_ws(":", F.lit("shift"), F.col("source_no"), which)
    primes = F.array(*[F.lit(m).cast("long") for m in MULTIPLIERS])
    prime = F.element_at(primes, (number_of(seed) % len(MULTIPLIERS) + 1).cast("int"))
    i = (F.col("slot") % F.col("blocks")).cast("decimal(38,0)")
    block = ((prime % F.col("blocks")) * i + number_of(F.concat(F.lit("b"), seed))) % F.col("blocks")
    shard = number_of(F.concat_ws(":", F.lit("shard"), F.col("source_no"), F.col("slot"))) % F.col("shards")
    return rows.select("source_no", which.alias("pass"), "slot", block.cast("long").alias("block"), shard.cast("long").alias("shard"))


def placed_documents(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` rows (doc_id, source, size) with their source's numbers and the place of their first word."""
    few = F.broadcast(sources) if sources.count() <= MOST_BROADCAST else sources
    names = few.withColumnRenamed("source", "_source")
    rows = sized.join(names, sized["source"].eqNullSafe(names["_source"])).drop("_source")
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    key = F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("bucket", (number_of(key) % buckets).cast("long"))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("_bucket_size"))
    over = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("_bucket_size").over(over), F.lit(0)).alias("_bucket_start"))
    inside = Window.partitionBy("source_no", "bucket").orderBy(F.asc_nulls_first("doc_id"), "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, ["source_no", "bucket"])
    return rows.withColumn("start", F.col("_bucket_start") + F.col("_inside")).drop("_inside", "_bucket_start", "bucket")


def pieces_of(placed: DataFrame) -> DataFrame:
    """One row per document and block it reaches into: ``block`` and the words ``from`` to ``until`` of the document."""
    first = F.floor(F.col("start") / BLOCK).cast("long")
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK).cast("long")
    rows = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    begin = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0).cast("long"))
    end = F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size"))
    return rows.withColumn("from", begin).withColumn("until", end)


def sized_documents(docs: DataFrame) -> DataFrame:
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))


def mixing_report(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, the words of it that the mix takes,
    and over how many output shards they are dealt (``n_shards``)."""
    sized = materialise(sized_documents(docs), "mix-sizes")
    sources = materialise(source_targets(sized), "mix-targets")
    uses = slot_table(sources).groupBy("source_no", "block", "shard").agg(F.count(F.lit(1)).alias("uses"))
    pieces = pieces_of(placed_documents(sized, sources))
    taken = F.sum(F.coalesce(F.col("uses"), F.lit(0)) * (F.col("until") - F.col("from")))
    keys = ["source_no", "start", "doc_id", "size", "source_size", "target"]
    # documents of size 0 share a start, so they are counted and spread out again
    # by its few source rows the planner takes the table of slots for small: it must not be broadcast
    dealt = pieces.join(uses.hint("merge"), ["source_no", "block"], "left").groupBy(*keys, "shard").agg(
        F.coalesce(taken, F.lit(0)).alias("_taken"), F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("_empty")
    )
    summed = dealt.groupBy(*keys).agg(
        F.sum("_taken").cast("long").alias("taken"), F.count("shard").alias("n_shards"), F.sum("_empty").alias("_empty")
    )
    copies = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1).cast("long"), F.col("_empty"))))
    return summed.withColumn("_copy", copies).select("doc_id", "size", "source_size", "target", "taken", "n_shards")


def shard_counts(docs: DataFrame, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """``shard``, ``source``, ``slots``: how many blocks of each source were drawn for each output shard."""
    sources = materialise(source_targets(sized_documents(docs)), "mix-targets")
    drawn = slot_table(sources, slots_per_shard).groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("slots"))
    return drawn.join(sources.select("source_no", "source"), "source_no").select("shard", "source", "slots")


def mixed_blocks(docs: DataFrame, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The mix itself, one row per slot: ``shard``, ``place``, ``source``, ``block``, ``pass``, ``n_words``, ``text``.

    A block holds the words of its source in the order of the stream, at most ``BLOCK`` of them.
    ``place`` orders the blocks within a shard.
    """
    words = F.split(F.regexp_replace(whole_text(), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    sized = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), words.alias("words")), "mix-words"
    )
    sources = materialise(source_targets(sized), "mix-targets")
    pieces = pieces_of(placed_documents(sized, sources)).where("block IS NOT NULL")
    part = F.slice("words", (F.col("from") + 1).cast("int"), (F.col("until") - F.col("from")).cast("int"))
    parts = pieces.select("source_no", "source", "block", "start", (F.col("until") - F.col("from")).alias("n"), F.array_join(part, " ").alias("part"))
    blocks = parts.groupBy("source_no", "source", "block").agg(
        F.sum("n").alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "part"))).alias("_parts")
    )
    blocks = blocks.withColumn("text", F.array_join(F.col("_parts.part"), " ")).drop("_parts")
    met = blocks.join(slot_table(sources, slots_per_shard).hint("merge"), ["source_no", "block"])
    place = number_of(F.concat_ws(":", F.lit("place"), "source_no", "slot"))
    return met.select("shard", place.alias("place"), "source", "block", "pass", "n_words", "text")


def write_mix(docs: DataFrame, path: str, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """Writes the mix in the order of its shards and reads it back.

    Tasks take ranges of shards, so a reader of some shards skips the other files by their statistics.
    """
    mix = materialise(mixed_blocks(docs, slots_per_shard), "mix-blocks")
    order = ["shard", "place", F.col("source").asc_nulls_last(), "block", "pass"]
    mix.repartitionByRange("shard", "place").sortWithinPartitions(*order).write.parquet(path)
    return docs.sparkSession.read.schema(mix.schema).parquet(path)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass, a document's words that lie in blocks shown in it.

    A document of which a pass shows every word keeps its text as it is; of others the shown
    words remain, joined by spaces. Columns as in ``docs``; ``n_chars`` is that of the new text.
    """
    keyed = with_row_key(docs)
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    sized = materialise(
        keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), *ROW_KEY), "mix-sizes"
    )
    sources = materialise(source_targets(sized), "mix-targets")
    slots = slot_table(sources).select("source_no", "block", "pass")
    pieces = pieces_of(placed_documents(sized, sources)).where("block IS NOT NULL")
    shown = pieces.join(slots.hint("merge"), ["source_no", "block"]).groupBy(*ROW_KEY, "start", "source_no", "size", "pass").agg(
        F.sort_array(F.collect_list(F.struct("from", "until"))).alias("spans"), F.sum(F.col("until") - F.col("from")).alias("_words")
    )
    # repeated rows have one text, so one of them may carry the shows of all
    one = F.struct("spans", (F.col("_words") == F.col("size")).alias("all"))
    shown = shown.groupBy(*ROW_KEY).agg(F.collect_list(one).alias("shows"))
    met = keyed.dropDuplicates(ROW_KEY).join(shown, ROW_KEY)
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    met = met.withColumn("_words", words).withColumn("_show", F.explode("shows"))
    part = F.flatten(F.transform(F.col("_show.spans"), lambda s: F.slice("_words", (s["from"] + 1).cast("int"), (s["until"] - s["from"]).cast("int"))))
    text = F.when(F.col("_show.all"), F.col("text")).otherwise(F.array_join(part, " "))
    met = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return met.select(*docs.columns)
