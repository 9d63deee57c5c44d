"""Exact dedup over a persistent digest index.

The index is a table of one row for each distinct text, bucketed and sorted
by digest. A new batch is reduced to one row a digest, anti-joined with the
index by sort-merge (both sides lie in the same buckets, so the index is
neither shuffled nor sorted again) and what is new is appended.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscope.llm.common import inner_id, outer_id, stage
from lendscope.session import work_path

#: A write that keeps to buckets needs as many of them as the index has.
BUCKETS = 64


def text_digest(text: Column) -> Column:
    """SHA-256 of the text after each run of white space became one space;
    NULL counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


class DigestIndex:
    """Digest -> id of the row that stays, kept in ``path`` across sessions.

    Opening an existing path takes up what earlier runs appended. Columns:
    digest binary, keep_id long. The number of buckets is fixed when the index
    is made; about 200 MB of digests a bucket is a good size.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + re.sub(r"\W", "_", path)[-80:]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Append the digests of ``rows`` (digest, doc_id) that the index lacks;
        of equal texts in the batch the smallest id stays. Copies are summed up
        before the shuffle, so a group of any size is one row a task."""
        first = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        new = first.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        # By the bucket, so that one task writes it, into one file, whatever the number of tasks.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        (new.select("digest", "keep_id").repartition(self.buckets, bucket)
            .sortWithinPartitions(bucket, "digest").write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size,
    kept, text_sha256.

    The rows enter the index in ``batches`` by rising doc_id, as deliveries
    would, so in a new index the smallest doc_id of equal texts stays; with an
    index from earlier runs its rows stay. group_size counts rows of ``docs``.
    NULL text is empty; a NULL doc_id sorts after all others. Of rows with the
    same doc_id and text one is kept. An empty table gives no rows. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    same = Window.partitionBy("doc_id", "digest").orderBy(F.lit(1))
    rows = stage(
        docs.select(inner_id().alias("doc_id"), F.unhex(text_digest(F.col("text"))).alias("digest"))
            .withColumn("copy", F.row_number().over(same)), "digests")
    index = index or DigestIndex(spark, work_path(spark, "digest-index"))
    low, high = rows.agg(F.min("doc_id"), F.max(F.when(F.col("doc_id") < (1 << 62), F.col("doc_id")))).first()
    cuts = [low + (high - low + 1) * k // batches for k in range(1, batches)] if high is not None else []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = rows if lo is None else rows.where(F.col("doc_id") >= lo)
        index.add(part if hi is None else part.where(F.col("doc_id") < hi))
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = stage(sizes.join(index.table().hint("merge"), "digest"), "digest-groups")
    return rows.join(groups, "digest").select(
        outer_id(F.col("doc_id")).alias("doc_id"), outer_id(F.col("keep_id")).alias("keep_id"), "group_size",
        ((F.col("doc_id") == F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact_dedup drops; all columns stay."""
    stays = exact_dedup(docs).where("kept").select(inner_id().alias("id"), F.col("text_sha256").alias("sha"))
    rows = docs.select(F.struct("*").alias("whole"), inner_id().alias("id"), text_digest(F.col("text")).alias("sha"))
    return rows.join(stays, ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"]).select("whole.*")
