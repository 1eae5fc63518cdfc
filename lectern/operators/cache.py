"""The cache of recognised images as a maintained table, bucketed by key.

Results are appended as they come; the last usable row of a key counts, and
compaction leaves that one alone.  The table is bucketed by the key, so neither
a lookup nor the choice of last rows moves any of it: only the images that are
looked up are dealt into its buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .resolve import usable_rows

BUCKETS = 64
SCHEMA = "ocr_cache_key string, image_sha256 string, ocr_config_sha256 string, ocr_status string, ocr_text string, ordinal long"


class Cache:
    """Rows (image_sha256, ocr_config_sha256, ocr_status, ocr_text) under a table's name in the catalog.

    ordinal tells runs apart: rows of a later run count before those of an
    earlier one, and among equals the larger text, so that the outcome never
    depends on the order of files.  Rows that are no usable results (hashes of
    64 hex digits, status ok or empty) are not taken in.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        own = rows.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in SCHEMA.split(", ")])
        # dealt as the buckets are, so that a task writes few of them
        own.repartition(self.buckets, "ocr_cache_key").write.bucketBy(self.buckets, "ocr_cache_key").sortBy("ocr_cache_key").format("parquet").mode(mode).saveAsTable(name)

    def append(self, results: DataFrame) -> None:
        """Add a run's results; its ordinal is one above the table's largest."""
        new = results.withColumn("ocr_cache_key", T.cache_key(F.col("image_sha256"), F.col("ocr_config_sha256")))
        last = -1
        if self.spark.catalog.tableExists(self.name):
            last = self.spark.table(self.name).agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("m")).first().m
        self._write(usable_rows(new).withColumn("ordinal", F.lit(last + 1)), self.name, "append")

    def rows(self) -> DataFrame:
        """The last row of each key."""
        table = self.spark.table(self.name)
        return table.groupBy("ocr_cache_key").agg(F.max(F.struct("ordinal", "ocr_text", "ocr_status", "image_sha256", "ocr_config_sha256")).alias("c")).select("ocr_cache_key", "c.image_sha256", "c.ocr_config_sha256", "c.ocr_status", "c.ocr_text", "c.ordinal")

    def reuse(self, images: DataFrame, config_sha: Column) -> DataFrame:
        """images (path, sha256) with ocr_status, ocr_text and cache_reused.

        The cache stays where it lies: images are dealt to its buckets.
        """
        keyed = images.withColumn("ocr_cache_key", T.cache_key(F.col("sha256"), config_sha)).repartition(self.buckets, "ocr_cache_key")
        found = keyed.join(self.rows().select("ocr_cache_key", "ocr_status", "ocr_text").hint("merge"), "ocr_cache_key", "left")
        return found.withColumn("cache_reused", F.col("ocr_status").isNotNull().cast("int"))

    def missing(self, images: DataFrame, config_sha: Column) -> DataFrame:
        """Images without a result: what is left to recognise, and a violation in a run without recognition."""
        return self.reuse(images, config_sha).where("cache_reused = 0").select("path", "sha256")

    def compact(self) -> None:
        """Keep the last row of each key alone; the new table takes the old one's name when it is whole."""
        beside = f"{self.name}_{uuid.uuid4().hex}"
        self._write(self.rows(), beside, "error")
        old = f"{beside}_old"
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {beside} RENAME TO {self.name}")
        self.spark.sql(f"DROP TABLE {old}")
