"""From raw documents to packed training sequences, in four stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import line_dedup as lines
from lectern.llm import ngram_join, packing
from lectern.llm import toxicity as toxic
from lectern.llm.common import cut, pick, read, remove, shared_folder, small

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4_096
#: Words that a worker remembers in the last stage: fewer than where packing is alone, as it follows others in the same executors.
WORDS = 100_000


def aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents with all columns but doc_id and text renamed by place, so that no stage's own columns clash with them."""
    lower = [c.lower() for c in docs.columns]
    at = {docs.columns.index(c) if c in docs.columns else lower.index(c): c for c in ("doc_id", "text")}
    names = [at.get(i, f"__{i}") for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples do not speak against; labels are those of the input folder.

    Each row is judged by its own text, rows without doc_id, repeated and empty
    ones too; other columns stay; an empty table stays empty.
    """
    rows, names = aside(docs)
    return toxic.scored(rows, read(spark, sf_dir, "labels")).where("score < 0.5").select(names).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that earlier ones have; those of which nothing is left are gone.

    n_chars is the new text's where a text has changed.  Rows without doc_id
    stay as they are, as do null and empty texts; rows that share a doc_id are
    held against earlier ones each; other columns stay.
    """
    rows, names = aside(docs)
    done = lines.line_dedup(rows)
    changed = F.size("removed") > 0
    blank = F.trim(F.regexp_replace("text", "[\\t-\\r ]+", " ")) == ""
    done = done.where(~(changed & blank))
    if "n_chars" in docs.columns:
        own = names[docs.columns.index("n_chars")]
        done = done.withColumn(own, F.when(changed, F.length("text")).otherwise(F.col(own)).cast(docs.schema["n_chars"].dataType))
    return done.select(names).toDF(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest doc_id.

    A row goes by its doc_id and its own text, so rows that share a doc_id have
    the fate of their texts; rows without doc_id, and null and empty texts,
    stay; other columns stay.
    """
    rows, _ = aside(docs)
    found = ngram_join.ngram_jaccard_join(rows, width=5, pct=80)
    later = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct())
    hint = F.broadcast if small(later, ngram_join.BROADCAST_IDS) else (lambda x: x)
    rows = rows.withColumn("key_of", F.xxhash64("text"))
    kept = rows.join(hint(later), (F.col("doc_id") == F.col("id")) & (F.col("key_of") == F.col("key")), "left_anti")
    return kept.drop("key_of").toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as sequences; what a null or empty text, or a repeated row, gives is said at ``packing.pack``."""
    return packing.pack(pick(docs, "doc_id", "text"), public_tokenizers.path(TOKENIZER), CAPACITY, words=WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot express these stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read again.

    The files go to the shared folder; a stage's are removed once the next one
    is written.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
