"""Exact dedup against a persistent digest index, a table bucketed and sorted by hash.

New texts are reduced to one row per digest before they meet the index, so a text that fills a
third of the input is one row there. The index side of the sort-merge join is read bucket by
bucket and not shuffled; digests it lacks are appended under the name of their batch, so a batch
whose run was lost can be taken in again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raincourse.session import sized

BUCKETS = 64


def text_digest(column: str = "text") -> F.Column:
    """SHA-256 of a text in UTF-8 as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256))


def digests_of(docs: DataFrame) -> DataFrame:
    return sized(docs.select("doc_id", text_digest().alias("digest")), "digests")


def index_exists(spark: SparkSession, index: str) -> bool:
    return spark.catalog.tableExists(index)


def ingest(digests: DataFrame, index: str, batch: str, buckets: int = BUCKETS) -> DataFrame:
    """Add a batch of (doc_id, digest) to table ``index``; one row per digest of the batch.

    Result: digest, keep_id (of the document that stays), group_size (rows of the batch), known
    (an earlier batch had it; then keep_id is the index's). Within a batch the largest doc_id
    stays, any id before null. An empty batch adds nothing. ``batch`` names the batch: taken in
    again, whether its first run ended before, within or after the append, it gives the same
    answer, and the index is as after one run.
    """
    spark = digests.sparkSession
    groups = sized(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    if not index_exists(spark, index):
        empty = groups.select("digest", "keep_id", F.lit(batch).alias("batch")).where("false")
        empty.write.bucketBy(buckets, "digest").sortBy("digest").saveAsTable(index)
    known = spark.table(index).where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"))
    mine = spark.table(index).where(F.col("batch") == batch).select("digest")
    new = groups.hint("merge").join(known, "digest", "left_anti")
    old = groups.hint("merge").join(known, "digest")
    result = sized(new.select("digest", "keep_id", "group_size", F.lit(False).alias("known"))
                   .union(old.select("digest", "old_id", "group_size", F.lit(True))), "ingested")
    add = result.where("NOT known").hint("merge").join(mine, "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch"))
    add.repartition(buckets, "digest").write.mode("append").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(index)
    return result


def dedup(digests: DataFrame, index: str, batches: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``digests``: doc_id, keep_id, group_size, kept, digest.

    The rows go to the index in ``batches`` ranges of doc_id, largest ids first, so the row that
    the index keeps is the one with the largest doc_id of all; rows with a null doc_id come last
    and stay only where a text has no other. Rows that repeat an id and its text are all marked
    like it. An empty table gives an empty result.
    """
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, width = low or 0, ((high or 0) - (low or 0)) // batches + 1
    batch = F.coalesce(((F.col("doc_id") - low) / width).cast("int"), F.lit(0))
    groups = None
    for b in range(batches - 1, -1, -1):
        part = ingest(digests.where(batch == b), index, f"range {b} of {batches}", buckets)
        groups = part if groups is None else groups.union(part)
    groups = sized(groups.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "groups")
    return (digests.join(groups, "digest")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"))
