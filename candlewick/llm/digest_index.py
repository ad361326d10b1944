"""Exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.shared import SPACES, stored
from candlewick.plans.scratch import new_folder

ENTRY = "text_sha256 string, keep_id long, n_chars long, group_size long"


@dataclass(frozen=True)
class DigestIndex:
    """A table of one entry per different text, in `buckets` sorted buckets at `path`.

    The number of buckets is fixed when the index is made. A later session opens
    the same folder again; joins on the digest then read it without a shuffle.
    """

    spark: SparkSession
    table: str
    path: str
    buckets: int = 64

    @staticmethod
    def at(spark: SparkSession, path: str, buckets: int = 64) -> DigestIndex:
        """Open the index in a folder, or start one there."""
        # By the whole path: folders of one last name are different indexes.
        table = "digest_index_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:32]
        if not spark.catalog.tableExists(table):
            spark.sql(
                f"CREATE TABLE {table} ({ENTRY}) USING parquet CLUSTERED BY (text_sha256) "
                f"SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
        return DigestIndex(spark, table, path, buckets)

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> None:
        """Add the groups whose digest is not there yet (sort-merge anti-join).

        Each bucket is written by one task, however many a shuffle has by the session's
        settings, so an append adds one file to a bucket.
        """
        new = groups.hint("merge").join(self.entries(), "text_sha256", "left_anti")
        new = new.select("text_sha256", "keep_id", "n_chars", "group_size")
        # As Spark numbers the buckets.
        bucket = F.pmod(F.hash("text_sha256"), F.lit(self.buckets))
        (
            new.repartitionById(self.buckets, bucket)
            .sortWithinPartitions("text_sha256")
            .write.mode("append")
            .format("parquet")
            .option("path", self.path)
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)


def with_digest(docs: DataFrame) -> DataFrame:
    """`doc_id, text_sha256, n_chars` of every row; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(F.regexp_replace(text, SPACES, ""), 256).alias("text_sha256"),
        F.char_length(text).cast("long").alias("n_chars"),
    )


def groups_by_digest(rows: DataFrame) -> DataFrame:
    """One row per digest: the longest text, then the smallest doc_id, stays."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("_order"))).alias("_best")
    grouped = rows.groupBy("text_sha256").agg(best, F.sum("rows").alias("group_size"))
    return grouped.select(
        "text_sha256",
        (-F.col("_best._order")).alias("keep_id"),
        F.col("_best.n_chars").alias("n_chars"),
        "group_size",
    )


def dedup_into(index: DigestIndex, docs: DataFrame) -> DataFrame:
    """Deduplicate a batch against the index, and append what is new to it.

    Returns `doc_id, keep_id, group_size, kept, text_sha256`. `keep_id` names the
    document of the index that has the text; for a text that came with an earlier
    batch, that is the earlier document, and none of this batch is kept.

    - Texts are equal when identical without `[\\x20\\x09-\\x0D]`; a null text is empty.
    - Rows that repeat both doc_id and text are one document and come back as one
      row; group_size counts all rows. A null doc_id loses every tie.
    - An empty batch gives no rows and leaves the index as it is.
    - Other columns of `docs` are not read.
    """
    rows = with_digest(docs).groupBy("text_sha256", "doc_id")
    rows = stored(
        rows.agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("rows")), "digests"
    )
    groups = groups_by_digest(rows)
    index.append(groups)
    # One row per digest on both sides, the index side without a shuffle. Only then is
    # a group spread to its documents, by a join whose hot keys Spark can split.
    found = stored(
        groups.select("text_sha256").join(
            index.entries().select("text_sha256", "keep_id", "group_size"), "text_sha256"
        ),
        "digest-groups",
    )
    return rows.join(found, "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def exact_duplicates(docs: DataFrame, buckets: int = 64) -> DataFrame:
    """`dedup_into` an index of its own."""
    spark = docs.sparkSession
    return dedup_into(DigestIndex.at(spark, new_folder(spark, "digest-index"), buckets), docs)


ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
best AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM rows)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best
"""
