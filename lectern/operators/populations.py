"""Summaries of the corpus, its two populations, and who carries which code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FULL, UNIQUE = "full_corpus", "text_unique"


def source_summary(notes: DataFrame) -> DataFrame:
    """By source: notes, dated notes, first and last date (blank without any), words, image references."""
    date = F.nullif(F.col("collection_date"), F.lit(""))
    return notes.groupBy(T.source_or_none(F.col("source")).alias("source")).agg(
        F.count("*").alias("note_count"), F.count(date).alias("dated_note_count"), F.coalesce(F.min(date), F.lit("")).alias("first_date"),
        F.coalesce(F.max(date), F.lit("")).alias("last_date"), F.sum("word_count").alias("word_count"), F.sum("image_ref_count").alias("image_ref_count"),
    )


def corpus_summary(notes: DataFrame, refs: DataFrame, mentions: DataFrame, entities: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row of the corpus: notes, sources, references, mentions, entity and keyword rows.

    References count as existing (resolved) or not, whatever keeps them from
    it.  by_currency has currency:mentions:least:largest, notes_by_source and
    mentions_by_source source:count, each in order of name.
    """
    listed = lambda *parts: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda x: F.concat_ws(":", *[x[f"col{i + 1}"] for i in range(len(parts))])), ";")
    text = lambda c: F.col(c).cast("string")
    named = lambda *parts: [(F.col(p) if isinstance(p, str) else p).alias(f"col{i + 1}") for i, p in enumerate(parts)]
    per_source = lambda table: table.groupBy(T.source_or_none(F.col("source")).alias("source")).agg(F.count("*").alias("n"))
    known = F.nullif(F.trim("source"), F.lit(""))
    n = notes.agg(F.count("*").alias("note_count"), F.count_distinct(known).alias("source_count"))
    r = refs.agg(F.count("*").alias("image_reference_count"), F.count_if(F.col("status") == "resolved").alias("existing_ref_count"), F.count_if(~F.col("status").eqNullSafe(F.lit("resolved"))).alias("missing_or_external_ref_count"))
    m = mentions.groupBy("currency").agg(F.count("*").alias("n"), F.min(F.col("amount").cast("decimal(18,8)")).alias("low"), F.max(F.col("amount").cast("decimal(18,8)")).alias("high"))
    m = m.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("price_mention_count"), listed(*named("currency", text("n"), text("low"), text("high"))).alias("by_currency"))
    e, k = entities.agg(F.count("*").alias("entity_mention_rows")), keywords.agg(F.count("*").alias("keyword_rows"))
    by = [per_source(t).agg(listed(*named("source", text("n"))).alias(name)) for t, name in ((notes, "notes_by_source"), (mentions, "mentions_by_source"))]
    out = n
    for one in (r, m, e, k, *by):  # single rows all of them
        out = out.crossJoin(one)
    return out


def top_prices(mentions: DataFrame, most: int = 50) -> DataFrame:
    return mentions.groupBy("currency", "amount").agg(F.count("*").alias("mention_count")).orderBy(F.desc("mention_count"), "currency", "amount").limit(most)


def text_key() -> Column:
    """What notes of the same text share: its hash, or the note itself where there is none."""
    blank = F.coalesce(F.trim("combined_text_sha256"), F.lit("")) == ""
    return F.when(blank, F.concat(F.lit("note:"), "note_id")).otherwise(F.col("combined_text_sha256"))


def membership(corpus: DataFrame) -> DataFrame:
    """population, note_id, source: all notes, and one of each text: the first by source and id.

    A blank source is ``(no_source)``.  Notes without a text hash stand for
    themselves.  The first of a group is a minimum, so a text that half the
    corpus shares costs one row a task.
    """
    corpus = corpus.select("note_id", T.source_or_none(F.col("source")).alias("source"), text_key().alias("k"))
    first = corpus.groupBy("k").agg(F.min(F.struct("source", "note_id")).alias("m")).select("m.note_id", "m.source")
    every = corpus.select(F.lit(FULL).alias("population"), "note_id", "source")
    return every.unionByName(first.select(F.lit(UNIQUE).alias("population"), "note_id", "source"))


def marked(corpus: DataFrame) -> DataFrame:
    """``corpus`` with blank sources named and unique: 1 for the first note of each text by source and id, else 0.

    What ``membership`` tells as rows.  The firsts come back by note_id, so no
    key of the join is shared by many notes.
    """
    own = corpus.withColumn("source", T.source_or_none(F.col("source")))
    first = own.select("source", "note_id", text_key().alias("k")).groupBy("k").agg(F.min(F.struct("source", "note_id")).alias("m"))
    return own.join(first.select("m.note_id", F.lit(1).alias("unique")), "note_id", "left").withColumn("unique", F.coalesce("unique", F.lit(0)))


def duplicate_audit(corpus: DataFrame) -> DataFrame:
    """One row (notes without a text hash are no duplicates): records, distinct texts, groups of duplicates, records in them, excess, largest group, records without words."""
    groups = corpus.groupBy(text_key().alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("combined_word_count") == 0).alias("zero"))
    more = F.col("n") > 1
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"), F.count("*").alias("distinct_text_count"), F.count_if(more).alias("duplicate_group_count"),
        F.coalesce(F.sum(F.when(more, F.col("n"))), F.lit(0)).alias("records_in_duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_record_count"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_group_size"), F.coalesce(F.sum("zero"), F.lit(0)).alias("zero_word_record_count"),
    )


def screening_audit(corpus: DataFrame) -> DataFrame:
    """The duplicate audit with the modalities of the records, one row."""
    md, ocr = F.col("markdown_present") == 1, F.col("ocr_present") == 1
    flags = corpus.agg(F.count_if(md).alias("markdown_record_count"), F.count_if(ocr).alias("ocr_record_count"), F.count_if(md & ocr).alias("both_record_count"), F.count_if(~md & ~ocr).alias("neither_record_count"))
    return duplicate_audit(corpus).crossJoin(flags)  # two single rows


def presence(coding: DataFrame, members: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """population, code, label, note_id, source: each note that carries a code, in each population it is in."""
    rows = coding.where("present = 1")
    if excluded:
        rows = rows.where(~F.col("code").isin(*excluded))
    return rows.select("note_id", "code", "label").distinct().join(members, "note_id").select("population", "code", "label", "note_id", "source")


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("population").agg(F.count("*").alias("denominator_n"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys of each side the other lacks."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("r").isNull()).alias("missing_n"), F.count_if(F.col("l").isNull()).alias("extra_n"))


def with_codes(notes: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The notes (``coding.carried``) that carry the given code of each family: an intersection of note sets without a join."""
    for family, code in wanted.items():
        notes = notes.where(F.array_contains(F.col(family)["code"], code))
    return notes
