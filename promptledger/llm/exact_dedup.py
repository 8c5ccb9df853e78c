"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of the normalised text. New documents are aggregated to
one row per digest (map-side first, so a text with millions of copies shuffles one row per task), joined by sort-merge
with the index, and what the index lacks (the anti-join) is appended. The index side of that join is never shuffled: its
buckets are the join's partitions. After ``compact`` a bucket is one file, which is read as sorted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, discard, documents, freeze, lookup, new_path, partitions

SCHEMA = T.StructType([
    T.StructField("digest", T.BinaryType()),
    T.StructField("keep_id", T.LongType()),
    T.StructField("keep_row", T.LongType()),
    T.StructField("batch", T.StringType()),
])


def digest(text):
    """32 bytes of SHA-256 over the UTF-8 of the text with A to Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


class DigestIndex:
    """A digest table in ``path`` that outlives the session: another session opens it by the same path and buckets."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or partitions(spark)
        self.path = path or new_path(spark, "digests")
        self._open()

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _open(self) -> None:
        """Enter the newest generation that ``compact`` finished, or the first, in the catalogue."""
        path, fs = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(n[4:]) for n in names if n.startswith("gen-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_done"))]
        self.generation = max(done, default=0)
        self.location = f"{self.path}/gen-{self.generation}"
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def close(self) -> None:
        """Leave the catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def compact(self) -> None:
        """Rewrite the index with one sorted file for each bucket. A rewrite that fails leaves the old generation in use.

        Rows are dealt by their bucket's number: by the digest itself, Spark would take the scan as dealt already and then
        read it unbucketed.
        """
        old, rows = self.table, self.rows()
        self.table, self.location = f"digest_index_{uuid.uuid4().hex}", f"{self.path}/gen-{self.generation + 1}"
        path, fs = self._fs()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.location), True)
        (
            rows.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets))).write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.location).saveAsTable(self.table)
        )
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/_done")).close()
        self.spark.sql(f"DROP TABLE {old}")
        self.generation += 1

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """One file per bucket and batch, written in bucket order."""
        (
            fresh.repartition(self.buckets, "digest").select(*SCHEMA.names).write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.location).saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def ingest(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
        """Deduplicate ``docs`` against the index and each other, append the new digests, and return a row per document:
        doc_id, keep_id, group_size (copies in this batch), kept, text_sha256.

        Of equal texts in a batch the row with the largest doc_id stays; a text that an earlier batch brought in stays
        there, and all its rows here are dropped. Null texts count as empty, and empty texts are equal. Null doc_ids
        sort below all others. Rows that repeat a doc_id with the same text keep exactly one. An empty table returns no
        row and appends nothing. Other columns are ignored, whatever their names. Ingesting a batch again by the same
        name after a failure gives the same rows.
        """
        batch = batch or uuid.uuid4().hex
        rows = freeze(
            docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text)).alias("digest"))
            .withColumn("row", F.monotonically_increasing_id()),
            "digest-rows",
        )
        best = F.max(F.struct("doc_id", "row"))
        groups = freeze(
            rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"),
            "digest-groups",
        )
        held = self.rows().select("digest", F.col("keep_id").alias("old_id"), F.col("batch").alias("old"))
        resolved = groups.hint("merge").join(held, "digest", "left")
        own = F.col("old").isNull() | (F.col("old") == batch)
        resolved = freeze(resolved.select(
            "digest", F.when(own, F.col("keep_id")).otherwise(F.col("old_id")).alias("keep_id"), F.when(own, F.col("keep_row")).alias("keep_row"),
            "group_size", F.col("old").isNull().alias("fresh")), "digest-resolved")
        self.append(resolved.filter("fresh").drop("fresh", "group_size").withColumn("batch", F.lit(batch)))
        discard(groups)
        resolved = resolved.drop("fresh")
        return lookup(rows, resolved, "digest", "group_size").select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    found = index.ingest(documents(spark, sf_dir))
    index.close()
    return found


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d
"""
