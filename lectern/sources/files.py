"""Files to DataFrames and back."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .shared import listed, remove, replace


class Contract(ValueError):
    """A file that is not what it is said to be."""


def notes(spark: SparkSession, folder: str, root: list[str], dates: list[str]) -> DataFrame:
    """Every *.md below the folder: ids, path, source, date, text, counts.

    Broken UTF-8 is replaced and line ends become LF; notes without a source
    are dropped.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
    base = F.regexp_replace(F.col("path"), "^file:/+", "/")
    below = F.regexp_replace(F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), r"^.*?" + r"\Q" + folder.rstrip("/") + r"\E/?", "")
    rows = files.select(below.alias("raw_path"), X.newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    name = F.element_at(F.split("raw_path", "/"), -1)
    rows = rows.select(
        X.record_id(F.col("raw_path")).alias("note_id"), X.short_id(F.col("raw_path")).alias("legacy_note_id"), X.posix_path(F.col("raw_path")).alias("relative_path"),
        X.source_in(F.col("raw_path"), root).alias("source"), X.date_in(name, dates).alias("collection_date"), "text", X.words(F.col("text")).alias("word_count"), X.chars(F.col("text")).alias("char_count"),
    )
    return rows.where("source <> ''")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Every .png below the folder, in any case: path, basename, sha256 of its content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][nN][gG]").option("recursiveFileLookup", True).load(folder)
    base = F.regexp_replace(F.col("path"), "^file:/+", "/")
    below = F.regexp_replace(F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), r"^.*?" + r"\Q" + folder.rstrip("/") + r"\E/?", "")
    rows = files.select(X.posix_path(below).alias("path"), F.sha2("content", 256).alias("sha256"))
    return rows.select("path", F.lower(F.element_at(F.split("path", "/"), -1)).alias("basename"), "sha256")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, blanks as blanks; a byte order mark is no part of the first name."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').fillna("")


def read_contract(spark: SparkSession, path: str, required: Iterable[str]) -> DataFrame:
    """``read_csv`` with the required columns present and cells trimmed."""
    table = read_csv(spark, path)
    missing = [c for c in required if c not in table.columns]
    if missing:
        raise Contract(f"{path}: no column {missing}")
    return table.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in table.columns])


def read_strict(spark: SparkSession, path: str, required: Iterable[str], label: str) -> DataFrame:
    """A sheet with a proper header, no ragged row, and at least one row."""
    first = spark.read.csv(path, header=False, multiLine=True, escape='"').limit(1).collect()
    if not first:
        raise Contract(f"{label}: no header")
    header = [(c or "").strip().lstrip("﻿") for c in first[0]]
    if "" in header:
        raise Contract(f"{label}: a column has no name")
    if len(set(header)) < len(header):
        raise Contract(f"{label}: a column name occurs twice")
    if missing := [c for c in required if c not in header]:
        raise Contract(f"{label}: no column {missing}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))] + [T.StructField("__bad", T.StringType())])
    table = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", enforceSchema=True)
    if table.where("__bad IS NOT NULL").limit(1).collect():
        raise Contract(f"{label}: rows have other numbers of cells than the header")
    if not table.limit(1).count():
        raise Contract(f"{label}: no rows")
    return table.select(*[F.trim(F.coalesce(F.col(f"c{i}"), F.lit(""))).alias(c) for i, c in enumerate(header)])


def write_csv(table: DataFrame, path: str, fields: list[str], metrics: Iterable[str] = (), extras: str = "drop", order: list[str] | None = None) -> None:
    """The fields in this order; metrics with six places; null as blank.  Further columns are dropped, or refused."""
    further = [c for c in table.columns if c not in fields]
    if extras == "refuse" and further:
        raise Contract(f"columns that are not to be written: {further}")
    shown = [F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c).cast("double"))).alias(c) if c in set(metrics) else F.col(c).cast("string").alias(c) for c in fields]
    rows = table.orderBy(*order) if order else table
    rows.select(*shown).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_csv_file(table: DataFrame, path: str, fields: list[str], metrics: Iterable[str] = (), extras: str = "drop", order: list[str] | None = None) -> None:
    """``write_csv`` as one file of that name, in order.

    One task writes it, as it is one file, and sorts with spilling; it gets its
    name in one step when the job is done, in place of an older one, so after a
    failed task nothing is seen and an older file stays.  For reports; a table
    of the corpus's size belongs in ``write_csv``'s folder of parts.
    """
    spark = table.sparkSession
    beside = f"{path}.pending-{uuid.uuid4().hex}"
    rows = table.repartition(1)
    try:
        write_csv(rows.sortWithinPartitions(*order) if order else rows, beside, fields, metrics, extras)
        parts = [f for f in listed(spark, beside) if f.rpartition("/")[2].startswith("part-")]
        replace(spark, parts[0], path)
    finally:
        remove(spark, beside)


def codebook(spark: SparkSession, path: str) -> DataFrame:
    """A codebook from JSON: a list of {family, code, label, objective, patterns}."""
    rows = spark.read.schema("family string, code string, label string, objective string, patterns array<string>").json(path, multiLine=True)
    return rows.select("family", "code", "label", "objective", F.posexplode("patterns").alias("pattern_idx", "pattern"))


def run_metrics(tables: dict[str, DataFrame], by: dict[str, str] | None = None, distinct: dict[str, list[str]] | None = None) -> DataFrame:
    """metric, value: how many rows each table has, how many for each value of its column in ``by``, and how many different values those in ``distinct`` have.

    Blank values are ``(blank)``; null is no value of its own among different
    ones.  One pass over each table; an empty one has 0 rows.
    """
    rows = []
    for name, table in tables.items():
        different, own = (distinct or {}).get(name, []), (by or {}).get(name)
        value = F.coalesce(F.nullif(F.trim(F.col(own).cast("string")), F.lit("")), F.lit("(blank)")) if own else F.lit("")
        counted = table.select(value.alias("of"), F.lit(1).cast("long").alias("n"), *[F.col(c).alias(f"distinct_{i}") for i, c in enumerate(different)])
        # a row that counts for nothing, so that an empty table has its row too
        counted = counted.unionByName(table.sparkSession.range(1).select(F.lit(None).cast("string").alias("of"), F.lit(0).cast("long").alias("n")), allowMissingColumns=True)
        # all rows and those of each value in one pass; different values of columns in all rows alone
        sets = [[], [F.col("of")]] if own else [[]]
        counts = counted.groupingSets(sets, F.col("of")).agg(F.sum("n").alias("n"), F.grouping("of").alias("all"), *[F.count_distinct(f"distinct_{i}").alias(f"d{i}") for i in range(len(different))])
        whole = [F.struct(F.lit(f"{name}_rows").alias("metric"), F.col("n").alias("value"))] + [F.struct(F.lit(f"{name}_distinct_{c}").alias("metric"), F.col(f"d{i}").alias("value")) for i, c in enumerate(different)]
        part = F.array(F.struct(F.concat(F.lit(f"{name}_{own}_"), "of").alias("metric"), F.col("n").alias("value")))
        rows.append(counts.where("all = 1 OR n > 0").select(F.inline(F.when(F.col("all") == 1, F.array(*whole)).otherwise(part))))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
