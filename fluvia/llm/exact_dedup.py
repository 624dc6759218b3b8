"""Exact deduplication against a persistent digest index, by DataFrame operations alone.

The index is a table bucketed and sorted by digest. A batch is reduced to one row a digest (partial
aggregates before the shuffle, so a text that fills a third of the batch costs one row a task), then
deduplicated by a sort-merge anti-join whose index side is read without shuffle or, while its
buckets hold one file each, sort; what is new is appended in the same buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import delete, exists, joined_to_groups, new_path, partitions, written

#: Characters that don't count when texts are compared: space, tab, line feed, vertical tab, form feed, return.
IGNORED = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without IGNORED; null counts as empty."""
    return F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), IGNORED, ""), "UTF-8"), 256)


class DigestIndex:
    """digest, keep_id, keep_chars of every distinct text seen so far."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, table: str | None = None):
        """An index at a path that all executors share (a new one by default), opened again if it is there.

        buckets is fixed when the index is made, and known when it is opened again, by any session. table is its name in
        the catalogue, by default one that no other has.
        """
        self.spark = spark
        self.path = (path or new_path(spark, "digest-index")).rstrip("/")
        about = f"{self.path}.about"
        if exists(spark, about):
            self.buckets = spark.read.schema("buckets int").json(about).first()["buckets"]
        else:
            self.buckets = buckets or partitions(spark)
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.json(about)
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, keep_chars BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def close(self) -> None:
        """Take the index out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def destroy(self) -> None:
        self.close()
        delete(self.spark, self.path)
        delete(self.spark, f"{self.path}.about")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def candidates(self, rows: DataFrame) -> DataFrame:
        """Of (digest, id, chars) rows, one a digest: the most characters, then the smallest id."""
        best = F.max(F.struct(F.col("id").isNotNull(), "chars", (-F.col("id")).alias("back"))).alias("best")
        return rows.groupBy("digest").agg(best).select(
            "digest", (-F.col("best.back")).alias("keep_id"), F.col("best.chars").alias("keep_chars")
        )

    def append_new(self, rows: DataFrame) -> None:
        """Add the digests of (digest, id, chars) rows that the index doesn't hold."""
        known = self.read().select(F.col("digest").alias("known")).hint("merge")
        fresh = self.candidates(rows).join(known, F.col("digest") == F.col("known"), "left_anti")
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.table)
        )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        digest(F.col(text_col)).alias("digest"),
        F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("chars"),
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None
) -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical without white space; of equal texts that with the most code
    points, then the smallest id, stays, unless the index has the text from an earlier batch, which
    then stays. group_size counts the batch's rows. A null text counts as empty; rows without an id
    are never kept before one with an id. Rows that repeat an id and text are one document: each is
    reported, with equal results. Without an index, one is made for this batch and goes with it. Empty tables give empty results; other columns are ignored.
    """
    passing = index is None
    index = index or DigestIndex(docs.sparkSession)
    rows = written(digests(docs, id_col, text_col), "digests")
    index.append_new(rows)
    counts = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    keepers = index.read().select(F.col("digest").alias("d"), "keep_id")
    groups = counts.join(keepers, F.col("digest") == F.col("d")).select("d", "keep_id", "group_size")
    groups = written(groups, "digest-groups")
    if passing:  # nothing of it is read any more
        index.destroy()
    return joined_to_groups(rows, groups, {"digest": "d"}, "group_size").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
