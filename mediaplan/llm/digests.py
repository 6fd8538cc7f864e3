"""Exact dedup against a persistent index of digests.

The index is a Parquet table bucketed and sorted by digest: one row for each distinct
text, with the document that stays and how many rows have had the text. New rows are
first reduced to one row a digest (partial aggregation, so a text that a third of all rows
share is summed where it is read), then anti-joined with the index without moving the
index, and what is new is appended.

A batch is known by a number: the caller's, or a checksum of its rows. So a batch that comes again, after a
failure say, is the same batch: what the index lacks of it is added and the answer is the same. Every batch adds a
file to a bucket; ``compact`` writes the index anew with one sorted file a bucket, in as many buckets as its rows ask for."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediaplan.sources.tables import keep, scratch_path

from .text import free_name

BUCKETS = 64
#: Rows of a bucket, which is one task of the join; larger tables get more buckets.
BUCKET_ROWS = 4_000_000
#: [\x20\x09-\x0D]
_WHITE = " \t\n\x0b\x0c\r"


def squeezed(text: str | Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _WHITE, "")


def digest_of(text: str | Column) -> Column:
    return F.sha2(squeezed(text), 256)


class DigestIndex:
    """An index in a folder that all executors share. ``open`` takes up one that is there."""

    SCHEMA = "digest STRING, keep_id BIGINT, chars BIGINT, group_size BIGINT, batch BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({self.SCHEMA}) USING PARQUET "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    @classmethod
    def scratch(cls, spark: SparkSession, buckets: int | None = None, rows: int = 0) -> DigestIndex:
        """An index in a new folder, for about so many rows."""
        return cls(spark, scratch_path(spark, "digest-index"), buckets or buckets_for(rows))

    def close(self) -> None:
        """Takes the table's name out of the session's catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def compact(self) -> DigestIndex:
        """The same index in a new folder, with one sorted file a bucket and buckets by its number of rows."""
        made = DigestIndex.scratch(self.spark, rows=self.table().count())
        made._write(self.rows().repartition(made.buckets, "digest"))
        return made

    def _write(self, rows: DataFrame) -> None:
        (rows.select("digest", "keep_id", "chars", "group_size", "batch")
         .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).saveAsTable(self.name))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """The table as plain files, whose rows any join may move."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def append(self, docs: DataFrame, batch: int | None = None) -> DataFrame:
        """Takes in a batch (doc_id, text) and returns a row for each of its rows: doc_id, digest, chars,
        keep_id, group_size (rows of this batch with the text), fresh (the text was not in the
        index) and kept.

        Of equal texts an indexed document stays, else the longest original, then the
        smallest doc_id (null last). Null text counts as empty; of rows that repeat id and
        text one is kept; other columns are ignored; an empty batch gives no rows. A batch that
        comes again, by its number or without one by its rows, adds nothing and gives the rows it gave before."""
        rows, groups, batch, first = self._take(docs, batch)
        return self._answer(rows, groups, batch, first)

    def take(self, docs: DataFrame, batch: int | None = None) -> int:
        """``append`` without its rows: the number of the batch."""
        return self._take(docs, batch)[2]

    def _take(self, docs: DataFrame, batch: int | None) -> tuple[DataFrame, DataFrame, int, bool]:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of("text").alias("digest"),
                           F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
        # repeated rows are counted, not carried
        rows = keep(rows.groupBy("digest", "doc_id", "chars").agg(F.count("*").alias("times")), "digests")
        batch = batch_number(rows) if batch is None else batch
        best = F.struct(F.col("chars"), -F.coalesce("doc_id", F.lit(2**63 - 1)))
        groups = rows.groupBy("digest").agg(F.max(best).alias("best"), F.sum("times").alias("group_size"))
        groups = groups.select("digest", "best.*", "group_size").toDF("digest", "chars", "minus", "group_size")
        keep_id = F.when(F.col("minus") != -(2**63 - 1), -F.col("minus"))
        groups = groups.select("digest", keep_id.alias("keep_id"), "chars", "group_size")
        fresh = (groups.repartition(self.buckets, "digest").hint("merge")
                 .join(self.table().select("digest"), "digest", "left_anti"))
        first = self.table().isEmpty()
        self._write(fresh.withColumn("batch", F.lit(batch).cast("long")))
        return rows, groups, batch, first

    def _answer(self, rows: DataFrame, groups: DataFrame, batch: int, first: bool) -> DataFrame:
        known = self.rows().select("digest", "keep_id", F.col("chars").alias("keep_chars"), "batch",
                                                          F.col("group_size").alias("first_size"))
        # what a batch finds in an empty index are its own groups
        sizes = None if first else keep(groups.select("digest", "group_size"), "digest-groups")
        out = rows.join(known, "digest")  # both sides move, so a hot digest can be split
        if sizes is not None:
            out = out.join(sizes, "digest")
        else:
            out = out.withColumn("group_size", F.col("first_size"))
        mine = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")) & (F.col("batch") == batch)
        return (out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
                .select("doc_id", "digest", "chars", "keep_id", "group_size", (F.col("batch") == batch).alias("fresh"),
                        (mine & (F.col("copy") == 1)).alias("kept")))


def buckets_for(rows: int) -> int:
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


def batch_number(rows: DataFrame) -> int:
    """A checksum of a batch's rows, whatever their order."""
    own = F.xxhash64("digest", "doc_id", "chars", "times")
    found = rows.agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.sum(own.cast("decimal(38,0)")).alias("s"))
    return found.select(F.xxhash64("n", "x", "s")).first()[0]


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, batch: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: those whose text is new to the index, one of each
    text. A batch that comes again keeps the rows it kept before."""
    scratch = index is None
    index = index or DigestIndex.scratch(docs.sparkSession, rows=docs.count())
    batch = index.take(docs, batch)
    if scratch:
        index.close()
    key = free_name(docs, "_key")
    stays = index.rows().filter(F.col("batch") == batch).select(
        _row_key(F.col("digest"), F.col("keep_id"), F.col("chars")).alias(key))
    length = F.length(F.coalesce("text", F.lit(""))).cast("long")
    marked = docs.withColumn(key, _row_key(digest_of("text"), F.col("doc_id").cast("long"), length))
    # one shuffle by the row's key serves both
    return marked.join(stays, key, "left_semi").dropDuplicates([key]).drop(key)


def _row_key(digest: Column, doc_id: Column, chars: Column) -> Column:
    return F.concat_ws("/", digest, F.coalesce(doc_id.cast("string"), F.lit("-")), chars.cast("string"))
