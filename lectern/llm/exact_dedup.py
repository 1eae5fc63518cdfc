"""Exact deduplication by progressive refinement.

Length first, then a hash of the first characters, then a hash of the whole
text.  Prefixes are hashed only where a length occurs twice, whole texts only
where a length and prefix do, and no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, small

PREFIX = 128
#: Keys (16 bytes each) up to which the surviving groups of a level are broadcast; beyond, the level is passed over.
BROADCAST_KEYS = 500_000


def survivors(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``rows`` with a column ``alone``: whether no other row has these keys.

    Keys are counted with map-side partial sums, so one that a third of all
    rows have costs one row a task.  Where too many keys survive to be
    broadcast, all rows go on to the next level: that reads more, and shuffles
    no text.
    """
    twice = cut(rows.where("NOT alone").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    if not small(twice, most):
        return rows
    marked = rows.join(F.broadcast(twice.withColumn("twice", F.lit(True))), keys, "left")
    return marked.withColumn("alone", F.col("alone") | F.col("twice").isNull()).drop("twice")


def exact_dedup(docs: DataFrame, prefix: int = PREFIX, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, plus every other column of ``docs`` but its text.

    Texts are equal when identical; of equal texts the row with the largest
    doc_id stays.  A null text counts as empty.  Rows that repeat a doc_id with
    the same text are one document: each counts in group_size and all of them
    are kept or none.  A null doc_id sorts before every other and stays only in
    a group of null ids, with a null keep_id.  Columns of ``docs`` that bear a
    result's name are replaced by the result.
    """
    results = ("doc_id", "text", "keep_id", "group_size", "kept")
    extra = [c for c in docs.columns if c.lower() not in results]
    rows = pick(docs, "doc_id", "text", *extra).toDF("doc_id", "text", *[f"__{i}" for i in range(len(extra))])
    names = rows.columns[2:]
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"length": F.octet_length("text"), "alone": F.lit(False)})
    rows = survivors(rows, ["length"], broadcast_keys)
    rows = rows.withColumn("prefix_hash", F.when(~F.col("alone"), F.xxhash64(F.substring("text", 1, prefix))))
    rows = survivors(rows, ["length", "prefix_hash"], broadcast_keys)
    # the text goes no further than this projection: its hash replaces it before any shuffle of survivors
    marked = rows.select("doc_id", *names, "length", F.when(~F.col("alone"), F.sha2("text", 256)).alias("full_hash"))
    twins = marked.where("full_hash IS NOT NULL")
    groups = twins.groupBy("length", "full_hash").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    alone = marked.where("full_hash IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *names)
    together = twins.join(groups, ["length", "full_hash"]).select("doc_id", "keep_id", "group_size", *names)
    out = alone.unionByName(together).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.select("doc_id", "keep_id", "group_size", "kept", *[F.col(n).alias(c) for n, c in zip(names, extra, strict=True)])
