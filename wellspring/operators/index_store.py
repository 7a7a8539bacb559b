"""A TF-IDF index on shared storage, bucketed by term, that grows by batches of chunks.

Stored are the chunks, the counts of their terms, and for every batch how many of its chunks
hold a term. A new batch only adds rows: old texts are not read and old counts are not written
again. The inverse document frequencies follow from the sums of a term over the batches and
the weights from counts and frequencies; all of these tables are bucketed by term, so their
joins and sums by term need no exchange. The lengths of the chunks' vectors change with every
batch and are written anew, one row a chunk.

The row in ``batches`` is written last and commits a batch. Every table carries the attempt
that wrote a row and readers keep committed attempts only, so a batch that broke off leaves
nothing behind that counts, and one that is repeated changes nothing.

Defined results: a chunk whose id is null or in the index already is left out, of an id that
occurs several times in a batch the smallest row stays; null, empty and stop-word texts are
chunks without terms; an empty batch is committed without effect. One writer at a time. A
term stands once a chunk, so a bucket holds at most one row a chunk for its hottest term.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.operators.retrieval import Index, term_counts
from wellspring.session import discard

BUCKETS = 64
COUNTS = "chunk_id STRING, term STRING, tf BIGINT, attempt STRING"
FREQUENCIES = "term STRING, chunks BIGINT, attempt STRING"
BATCHES = "number BIGINT, batch STRING, attempt STRING, chunks BIGINT"


@dataclass
class IndexStore:
    spark: SparkSession
    path: str
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> IndexStore:
        """A new store; fails when there is one already. The number of buckets stays as it is."""
        spark.createDataFrame([], BATCHES).write.parquet(f"{path}/batches")
        spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")
        return cls(spark, path, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IndexStore:
        """A stored index, also one that another session wrote or extended."""
        store = cls(spark, path, spark.read.parquet(f"{path}/layout").first()["buckets"])
        for part, columns in (("counts", COUNTS), ("frequencies", FREQUENCIES)):
            spark.catalog.refreshTable(store._bucketed(part, columns))
        return store

    def _bucketed(self, part: str, columns: str) -> str:
        """The name under which a session knows a bucketed folder."""
        name = "index_" + uuid.uuid5(uuid.NAMESPACE_URL, f"{self.path}/{part}").hex
        place = f"{self.path}/{part}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (term) SORTED BY (term) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        return name

    def _append(self, rows: DataFrame, part: str, columns: str) -> None:
        """Placed like the buckets, so that a task writes one file."""
        rows.repartition(self.buckets, "term").write.insertInto(self._bucketed(part, columns))

    def batches(self) -> DataFrame:
        return self.spark.read.schema(BATCHES).parquet(f"{self.path}/batches")

    def _committed(self, rows: DataFrame, batches: DataFrame) -> DataFrame:
        # one row a batch: the operator of the index decides how many there are
        return rows.join(F.broadcast(batches.select("attempt")), "attempt", "left_semi")

    def _weighed(self, batches: DataFrame) -> DataFrame:
        """chunk_id, term, raw (weight before scaling) and idf; nothing is exchanged by term."""
        n = batches.agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
        counts = self._committed(self.spark.table(self._bucketed("counts", COUNTS)), batches)
        return counts.join(self._idf(batches, n).hint("merge"), "term").select(
            "chunk_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw")
        )

    def _idf(self, batches: DataFrame, n: int) -> DataFrame:
        rows = self._committed(self.spark.table(self._bucketed("frequencies", FREQUENCIES)), batches)
        return rows.groupBy("term").agg((F.log((1 + n) / (1 + F.sum("chunks"))) + 1).alias("idf"))

    def _stored_chunks(self, batches: DataFrame) -> DataFrame:
        return self._committed(self.spark.read.parquet(f"{self.path}/chunks"), batches).drop("attempt")

    def extend(self, chunks: DataFrame, batch: str) -> None:
        """Add the chunks of a batch; a batch that is in the index already changes nothing."""
        before = self.batches()
        done = before.agg(F.max("number"), F.count(F.when(F.col("batch") == batch, 1))).first()
        if done[1]:
            return
        number, attempt = (done[0] or 0) + 1, uuid.uuid4().hex
        new = chunks.filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min(F.struct(*chunks.columns)).alias("row")).select("row.*")
        if number > 1:
            new = new.join(self._stored_chunks(before).select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns)
        new.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(f"{self.path}/chunks")
        added = self.spark.read.schema(chunks.schema).parquet(f"{self.path}/chunks/attempt={attempt}") if self._wrote(attempt) else chunks.limit(0)
        counts = term_counts(added, "chunk_id", "content").select("chunk_id", "term", "tf", F.lit(attempt).alias("attempt"))
        self._append(counts, "counts", COUNTS)
        own = self.spark.table(self._bucketed("counts", COUNTS)).filter(F.col("attempt") == attempt)
        held = own.groupBy("term").agg(F.count("*").alias("chunks")).withColumn("attempt", F.lit(attempt))
        self._append(held.select("term", "chunks", "attempt"), "frequencies", FREQUENCIES)
        row = self.spark.createDataFrame([(number, batch, attempt, added.count())], BATCHES)
        lengths = self._weighed(before.union(row)).groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        lengths.write.parquet(f"{self.path}/lengths/{attempt}")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        # those of the batch before stay for readers that are at work
        old = before.filter(F.col("number") == number - 2).first()
        if old:
            discard(self.spark, f"{self.path}/lengths/{old['attempt']}")

    def _wrote(self, attempt: str) -> bool:
        """Whether an attempt has chunks; without rows there is no folder."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/chunks/attempt={attempt}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def index(self) -> Index:
        """The index as the search takes it; weights are derived when they are read.

        A search keeps the asked terms of the counts first, so only their rows meet the lengths.
        """
        batches = self.batches()
        last = batches.orderBy(F.desc("number")).first()
        if last is None:
            raise ValueError(f"no batch has been added to {self.path}")
        n = batches.agg(F.sum("chunks")).first()[0]
        lengths = self.spark.read.schema("chunk_id string, norm double").parquet(f"{self.path}/lengths/{last['attempt']}")
        # one row a chunk is hashed, so that the many postings need no sort by chunk
        scaled = self._weighed(batches).join(lengths.hint("shuffle_hash"), "chunk_id")
        postings = scaled.select("chunk_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))
        return Index(self._stored_chunks(batches), self._idf(batches, n), postings)
