"""Applying a codebook to every note, and the summaries of what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import ship
from .codebook import Code
from .matching import matched

SNIPPETS = 3
KEPT = ("note_id", "source", "markdown_present", "ocr_present")


def code_notes(corpus: DataFrame, codes: list[Code]) -> DataFrame:
    """Every note and code: present, hit_count (all patterns, overlaps too), pattern_count and band, zeros kept.

    A text is read once whatever the number of patterns (``matching``), where
    it lies: a map without a shuffle.  A null text carries no code.
    """
    ship(corpus.sparkSession)
    each = F.array(*[F.struct(F.lit(k).alias("group"), F.lit(c.code).alias("code"), F.lit(c.label).alias("label"), F.lit(c.objective).alias("objective")) for k, c in enumerate(codes)])
    found = matched(F.col("text"), [c.patterns for c in codes])
    hits = F.map_from_entries(F.transform(found, lambda x: F.struct(x["group"], x["hits"])))
    rows = corpus.select(*KEPT, "text_source_count", hits.alias("by_group")).select("*", F.explode(each).alias("x"))
    rows = rows.select(*KEPT, "text_source_count", "x.*", F.coalesce(F.try_element_at("by_group", F.col("x.group")), F.array().cast("array<bigint>")).alias("hits"))
    rows = rows.withColumns({
        "hit_count": F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x),
        "pattern_count": F.size(F.filter("hits", lambda x: x > 0)).cast("long"),
    })
    return rows.select(
        *KEPT, "code", "label", "objective", (F.col("hit_count") > 0).cast("int").alias("present"), "hit_count", "pattern_count",
        T.band(F.col("hit_count"), F.col("pattern_count"), F.col("text_source_count")).alias("rule_match_intensity"),
    )


def carried(corpus: DataFrame, families: dict[str, list[Code]]) -> DataFrame:
    """The notes without their texts, and in a column for each family which of its codes (code, label) they carry.

    What the populations' tables start from: texts are read once for all
    families, and a code is left at its first match.
    """
    ship(corpus.sparkSession)
    every = [(name, c) for name, codes in families.items() for c in codes]
    table = F.array(*[F.struct(F.lit(name).alias("family"), F.lit(c.code).alias("code"), F.lit(c.label).alias("label")) for name, c in every])
    told = F.transform(matched(F.col("text"), [c.patterns for _, c in every], once=True), lambda x: F.element_at(table, x["group"] + 1))
    own = lambda name: F.transform(F.filter("__found", lambda x: x["family"] == name), lambda x: F.struct(x["code"].alias("code"), x["label"].alias("label")))
    kept = [c for c in corpus.columns if c != "text"]
    return corpus.select(*kept, told.alias("__found")).select(*kept, *[own(name).alias(name) for name in families])


def evidence(corpus: DataFrame, codes: list[Code], most: int = SNIPPETS) -> DataFrame:
    """note_id, code, snippet_index, matched, snippet: the first hits by pattern, then place, of those that ``code_notes`` counts."""
    ship(corpus.sparkSession)
    text = F.col("text")
    names = F.array(*[F.lit(c.code) for c in codes])
    rows = corpus.select("note_id", "source", "text", F.explode(matched(text, [c.patterns for c in codes], most)).alias("x"))
    rows = rows.select("note_id", "source", "text", F.element_at(names, F.col("x.group") + 1).alias("code"), F.posexplode("x.places").alias("k", "m"))
    return rows.select("note_id", "source", "code", (F.col("k") + 1).alias("snippet_index"), F.left("m.matched", F.lit(T.MATCHED)).alias("matched"), T.snippet(text, F.col("m.start"), F.col("m.end")).alias("snippet"))


def _banded(name: str) -> Column:
    return F.count_if(F.col("rule_match_intensity") == name).alias(f"{name}_intensity_notes")


def summary(coding: DataFrame) -> DataFrame:
    """By code over notes that carry it; codes that no note carries have no row."""
    rows = coding.where("present = 1").groupBy("code", "label", "objective")
    return rows.agg(F.count("*").alias("note_count"), F.sum("hit_count").alias("hit_count"), _banded("high"), _banded("medium"), _banded("low"))


def summary_by_source(coding: DataFrame) -> DataFrame:
    rows = coding.where("present = 1").groupBy(T.source_or_none(F.col("source")).alias("source"), "code", "label")
    return rows.agg(F.count("*").alias("note_count"), F.sum("hit_count").alias("hit_count"))


def summary_by_objective(coding: DataFrame, excluded: list[str]) -> DataFrame:
    """Rows of notes and codes by objective, without the excluded codes."""
    rows = coding.where((F.col("present") == 1) & ~F.col("code").isin(*excluded) if excluded else F.col("present") == 1)
    return rows.groupBy("objective").agg(F.count("*").alias("note_code_rows"), F.sum("hit_count").alias("hit_count"))


def rollup(by_source: DataFrame) -> DataFrame:
    """Codes over all sources, from a table by source."""
    return by_source.groupBy("code", "label").agg(F.count("*").alias("source_count"), F.sum("note_count").alias("note_count"), F.sum("hit_count").alias("hit_count"))


def ranked(table: DataFrame, by: str = "note_count", within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Places 1 .. n by falling ``by``, ties by code.  The table is a summary: a row a code."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(F.desc(by), "code")))


def top_codes(by_source: DataFrame, most: int = 5, excluded: list[str] | None = None) -> DataFrame:
    """source, dominant_code, top_codes ("code (n notes); ...") of each source."""
    rows = by_source.where(~F.col("code").isin(*excluded)) if excluded else by_source
    rows = ranked(rows, within=["source"], name="place").where(F.col("place") <= most)
    each = F.array_sort(F.collect_list(F.struct("place", "code", "note_count")))
    out = rows.groupBy("source").agg(each.alias("own"))
    told = F.array_join(F.transform("own", lambda x: F.concat(x["code"], F.lit(" ("), x["note_count"].cast("string"), F.lit(" notes)"))), "; ")
    return out.select("source", F.col("own")[0]["code"].alias("dominant_code"), told.alias("top_codes"))


def findings(summaries: DataFrame, narrative: DataFrame, default: str) -> DataFrame:
    """Ranked summaries with their narrative, or the default where none is written."""
    rows = ranked(summaries).join(narrative.select("code", "narrative"), "code", "left")
    return rows.withColumn("narrative", F.coalesce("narrative", F.lit(default)))


def keyword_by_source(keywords: DataFrame) -> DataFrame:
    rows = keywords.groupBy(T.source_or_none(F.col("source")).alias("source"), "keyword")
    return rows.agg(F.sum("present").alias("files_with_hit"), F.sum("count").alias("hit_count"))


def entity_by_source(entities: DataFrame) -> DataFrame:
    rows = entities.groupBy(T.source_or_none(F.col("source")).alias("source"), "entity_type", "entity")
    return rows.agg(F.count("*").alias("note_count"), F.sum("count").alias("hit_count"))


def distinct_snippets(snippets: DataFrame, most: int) -> DataFrame:
    """The first snippets of each code that differ in their first 120 characters, whatever the case; blank ones are passed over."""
    key = F.lower(F.left("snippet", F.lit(120)))
    order = ["note_id", "snippet_index"]
    first = snippets.where(T.filled(F.col("snippet"))).groupBy("code", key.alias("key")).agg(F.min(F.struct(*order, "snippet")).alias("m")).select("code", "m.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(*order))).where(F.col("place") <= most)
