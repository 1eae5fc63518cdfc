"""Delta-maintained token counts by source, language and tokenizer version.

A batch of changes is a table of signed counts: an insert adds a document's
tokens, a delete takes them away, a revision does both.  Committing a batch
writes its sums by group and gives them the batch's name in one step, so a
batch counts once whoever commits it and however often.  Totals are the sum of
all committed batches; ``compact`` replaces them by their sums.  No batch is
ever read at document level again.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import keeps, pick, remove, ship, turn
from .shingles import sliced

GROUP = ("source", "lang", "version")
SUMS = ("docs", "tokens", "chars")
SCHEMA = "source string, lang string, version string, docs long, tokens long, chars long"


@lru_cache(maxsize=2)
def _byte_level(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


keeps("token_counts", _byte_level.cache_clear)


def counter(path: str, pattern: str) -> Callable[[str], int]:
    """How many tokens a vocabulary gives a text: byte-level ranks (.tiktoken) with the pattern, or a word vocabulary (.json)."""
    if path.endswith(".tiktoken"):
        encode = _byte_level(path, pattern).encode_ordinary
        return lambda text: len(encode(text))
    encode = bpe.vocabulary(path).encode
    return lambda text: len(encode(text)) // 4


def tokenized(docs: DataFrame, paths: list[str], pattern: str) -> DataFrame:
    """doc_id, source, lang, text_key, chars, tokens (one number for each vocabulary) of every row: what later batches are made of.

    A null text counts as empty: one document of no tokens.  text_key (md5 of
    the text) tells rows that share a doc_id apart.  Repeated rows count each;
    other columns are ignored; an empty table gives none.
    """
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", "source", "lang").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", "text", "source", "lang", F.md5("text").alias("text_key"), F.length("text").cast("long").alias("chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("token_counts")
        counters = [counter(p, pattern) for p in paths]
        for batch in batches:
            for part in sliced(batch):
                counts = [[c(t) for c in counters] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[part.column(i) for i in range(2, 6)], pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "source", "lang", "text_key", "chars", "tokens"])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, text_key string, chars long, tokens array<long>")


def of_version(rows: DataFrame, version: str, tokens: Column) -> DataFrame:
    """source, lang, version, docs, tokens, chars: what each row of ``tokenized`` adds."""
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("docs"), tokens.cast("long").alias("tokens"), "chars")


def counted(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    """source, lang, version, docs, tokens, chars: what each document adds, its tokens counted by an expression over ``text``.

    A null text counts as empty: one document of no tokens.  Null sources and
    languages are groups of their own; repeated rows count each; other columns
    are ignored, whatever their names; an empty table gives none.
    """
    rows = pick(docs, "doc_id", "text", "source", "lang").withColumn("text", F.coalesce("text", F.lit("")))
    return of_version(rows.withColumn("chars", F.length("text").cast("long")), version, tokens)


def copies_of(rows: DataFrame) -> DataFrame:
    """The rows of ``tokenized`` that repeat a text of a larger doc_id; a null doc_id is the smallest."""
    kept = rows.groupBy("text_key").agg(F.max("doc_id").alias("kept"))
    return rows.join(kept, "text_key").where("NOT (doc_id <=> kept)").drop("kept")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, *SUMS)


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, *[(-F.col(c)).alias(c) for c in SUMS])


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old counts out, new ones in; documents stay as many where both have them."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Additive totals kept under ``path``, a folder that all executors share.

    Null sources and languages are groups of their own.  Ties cannot arise, and
    an empty batch is committed like any other.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._place(self.path).getFileSystem(self._conf)

    def _names(self, prefix: str) -> list[str]:
        """Of the finished folders that begin with ``prefix``, what comes after it."""
        top = self._place(self.path)
        found = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return [n.removeprefix(prefix) for n in found if n.startswith(prefix) and self._fs.exists(self._place(f"{self.path}/{n}/_SUCCESS"))]

    def _compacted(self, base: str | None) -> set[str]:
        """The batches in a compaction: one name each."""
        return {r.name for r in self.spark.read.parquet(f"{base}/names").collect()} if base else set()

    def _listing(self) -> tuple[str | None, set[str], set[str]]:
        """The folder of the last compaction, the batches in it, and those beside it, all as of one moment."""
        beside, bases = set(self._names("batch=")), self._names("base=")
        # batches are listed first: one that a compaction takes in between is in its names, and counts there
        base = f"{self.path}/base={max(bases, key=int)}" if bases else None
        old = self._compacted(base)
        return base, old, beside - old

    def committed(self, batch: str) -> bool:
        _, old, beside = self._listing()
        return batch in beside or batch in old

    def _publish(self, attempt: str, name: str) -> bool:
        """Give a finished folder its name, unless another writer has given it first; the step is atomic."""
        final = f"{self.path}/{name}"
        if self._fs.exists(self._place(final)) and not self._fs.exists(self._place(f"{final}/_SUCCESS")):
            remove(self.spark, final)  # of a writer that named its folder before it was finished
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(self._place(attempt), self._place(final), sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError:
            if not self._fs.exists(self._place(f"{final}/_SUCCESS")):
                raise
            remove(self.spark, attempt)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write the batch's sums, unless it is committed already; returns whether it was new.

        The sums of a hot group are formed before the shuffle.  A job that
        fails leaves a nameless folder, which never counts; of two writers of
        one batch the first to finish counts.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch names are letters, digits, - and _: {batch!r}")
        if self.committed(batch):
            return False
        attempt = f"{self.path}/attempt-{uuid.uuid4().hex}"
        sums = changes.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(attempt)
        return self._publish(attempt, f"batch={batch}")

    def _sums(self, base: str | None, beside: set[str]) -> DataFrame:
        ready = [f"{self.path}/batch={n}" for n in sorted(beside)] + ([f"{base}/sums"] if base else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*ready) if ready else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where("docs <> 0 OR tokens <> 0 OR chars <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens, chars over all committed batches; groups without documents are left out."""
        base, _, beside = self._listing()
        return self._sums(base, beside)

    def compact(self) -> None:
        """Put all committed batches into one table of sums.

        Names and sums are those of one listing, so a batch that is committed
        meanwhile stays beside it.  Totals are the same before and after, and a
        compacted batch is still committed.  Folders of the batches stay for
        readers that have listed them, until the next compaction.
        """
        base, old, beside = self._listing()
        attempt, number = f"{self.path}/attempt-{uuid.uuid4().hex}", int(base.rpartition("=")[2]) + 1 if base else 0
        self._sums(base, beside).write.parquet(f"{attempt}/sums")
        self.spark.createDataFrame([(n,) for n in sorted(beside | old)], "name string").write.parquet(f"{attempt}/names")
        self._fs.create(self._place(f"{attempt}/_SUCCESS")).close()
        if self._publish(attempt, f"base={number}"):
            for n in set(self._names("batch=")) & old:
                remove(self.spark, f"{self.path}/batch={n}")
