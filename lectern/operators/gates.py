"""Data-quality gates: each returns its violations; ``require`` turns any into an error."""

from __future__ import annotations

import re
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T
from ..sources.shared import cut, remove, rename

#: Parts of names that must not be published, names that must not, and names with such parts that may.
BLOCKED_PARTS = {"path", "text", "snippet", "snippets", "evidence"}
BLOCKED_NAMES = {"note_id", "legacy_note_id", "record_id"}
ALLOWED_NAMES = {
    "unique_text_count", "positive_unique_evidence_rows", "negative_unique_evidence_rows", "evidence_packet_count", "final_insufficient_evidence",
    "final_insufficient_evidence_n", "coder_1_insufficient_evidence_n", "coder_2_insufficient_evidence_n", "unique_combined_text_hashes_n",
    "exact_text_unique_denominator_n", "exact_text_unique_present_n", "exact_text_unique_percent", "exact_text_unique_rank", "exact_text_unique_sensitivity",
}
#: Fixed value: what shows a path of some machine, or a file's address, in a text.
LOCAL_PATH = r"(?:file://|(?:^|[\s\"'=(\x60])(?:[A-Za-z]:[\\/]|/(?:home|Users|mnt|tmp|var|private)/))"
#: The same with borders of lines and white space as they are there.
_SHOWS_PATH = f"(?mdU){LOCAL_PATH}"


class Violation(ValueError):
    pass


def require(violations: DataFrame, what: str) -> None:
    """Raise with up to five violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise Violation(f"{what}: {[r.asDict() for r in found]}")


def unique_key(table: DataFrame, key: str, label: str = "table") -> DataFrame:
    """label, key_value, n, violation: keys that are blank or occur twice."""
    value = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = table.groupBy(value.alias("key_value")).agg(F.count("*").alias("n"))
    bad = F.when(F.col("key_value") == "", "blank").when(F.col("n") > 1, "duplicate")
    return rows.select(F.lit(label).alias("label"), "key_value", "n", bad.alias("violation")).where("violation IS NOT NULL")


def same_keys(left: DataFrame, right: DataFrame, key: str, label: str = "sheet") -> DataFrame:
    """label, key, violation: keys that one side lacks."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    bad = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra")
    return a.join(b, key, "full").select(F.lit(label).alias("label"), key, bad.alias("violation")).where("violation IS NOT NULL")


def same_identity(sheet: DataFrame, reference: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, found, expected: identity cells of a sheet that are filled and differ."""
    ref = reference.select(key, *[F.col(c).alias(f"expected_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c)).alias("found"), F.col(f"expected_{c}").alias("expected")) for c in columns])
    rows = sheet.join(ref, key).select(key, F.explode(each).alias("x")).select(key, "x.*")
    return rows.where("coalesce(found, '') <> '' AND found <> coalesce(expected, '')")


def repeated_decisions(adjudication: DataFrame, coder_1: DataFrame, coder_2: DataFrame) -> DataFrame:
    """Adjudication rows whose copies of the coders' decisions are not what they said.

    Decisions are normalised first; a copy or a decision that is blank, or no
    decision at all, is not compared.
    """
    own = lambda c: T.decision(F.col(c))
    said_1, said_2 = (s.select("record_id", own("decision").alias(f"said_{k}")) for k, s in ((1, coder_1), (2, coder_2)))
    copies = adjudication.select("record_id", own("coder_1_decision").alias("coder_1_decision"), own("coder_2_decision").alias("coder_2_decision"))
    rows = copies.join(said_1, "record_id").join(said_2, "record_id")
    differ = lambda a, b: (F.col(a) != "") & (F.col(b) != "") & (F.col(a) != F.col(b))
    bad = F.coalesce(differ("coder_1_decision", "said_1"), F.lit(False)) | F.coalesce(differ("coder_2_decision", "said_2"), F.lit(False))
    return rows.where(bad).select("record_id", "coder_1_decision", "said_1", "coder_2_decision", "said_2")


def same_within_text(coding: DataFrame, hashes: DataFrame) -> DataFrame:
    """Codes that notes of the same text do not all carry alike."""
    rows = coding.join(hashes.select("note_id", "combined_text_sha256"), "note_id").where("coalesce(combined_text_sha256, '') <> ''")
    return rows.groupBy("combined_text_sha256", "code").agg(F.min("present").alias("lo"), F.max("present").alias("hi"), F.count("*").alias("note_n")).where("lo <> hi").select("combined_text_sha256", "code", "note_n")


def same_carried_within_text(notes: DataFrame, family: str) -> DataFrame:
    """``same_within_text`` of notes with their codes as lists (``coding.carried``): texts are read once, and no row is a note and a code it lacks.

    notes: combined_text_sha256 and ``family``, an array of struct<code, ...>.
    The notes of a text, and those of them with each code, are counted in each
    task first; what meets by text is a row a code.
    """
    marks = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.coalesce(F.col(family)["code"], F.array().cast("array<string>")), lambda x: x))
    rows = notes.where("coalesce(combined_text_sha256, '') <> ''").select("combined_text_sha256", F.explode(marks).alias("code"))
    counts = rows.groupBy("combined_text_sha256", "code").agg(F.count("*").alias("k"))
    by_text = counts.groupBy("combined_text_sha256").agg(F.max(F.when(F.col("code").isNull(), F.col("k"))).alias("note_n"), F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "k"))).alias("own"))
    return by_text.select("combined_text_sha256", "note_n", F.inline("own")).where("k < note_n").select("combined_text_sha256", "code", "note_n")


def orphans(coding: DataFrame, corpus: DataFrame) -> DataFrame:
    """Coded notes that the corpus does not have."""
    return coding.select("note_id").distinct().join(corpus.select("note_id"), "note_id", "left_anti")


def broken_rules(table: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule for every row and rule that does not hold; a rule that is null does not."""
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in rules.items()]), lambda x: ~x["ok"])
    return table.select(*keys, F.explode(each).alias("x")).select(*keys, "x.rule")


#: What lies between -1 and 1 in a reliability table, where it is defined.
COEFFICIENTS = ("nominal_kappa", "nominal_kappa_low", "nominal_kappa_high", "krippendorff_alpha", "binary_kappa", "ac1", "ac1_low", "ac1_high")


def reliability_rules() -> dict[str, Column]:
    """Rules of a published row; coefficients that are undefined break none."""
    adjudicated = F.expr("adjudicated_present_n + adjudicated_absent_n + adjudicated_ambiguous_n + adjudicated_insufficient_text_n + adjudicated_not_applicable_n")
    within = [F.coalesce(F.col(c).between(-1, 1), F.lit(True)) for c in COEFFICIENTS]
    return {
        "pairs_are_agreements_and_disagreements": F.expr("pair_n = agreement_n + disagreement_n"),
        "binary_pairs_are_pairs": F.expr("binary_pair_n <= pair_n"),
        "binary_agreements_are_agreements": F.expr("binary_agreement_n <= least(binary_pair_n, agreement_n)"),
        "adjudicated_are_disagreements": adjudicated == F.col("disagreement_n"),
        "agreement_lies_in_its_interval": F.expr("pair_n = 0 OR (0 <= agreement_low_pct AND agreement_low_pct <= agreement_pct AND agreement_pct <= agreement_high_pct AND agreement_high_pct <= 100)"),
        "agreement_is_its_share": F.expr("agreement_pct = CASE WHEN pair_n = 0 THEN 0 ELSE bround(100D * agreement_n / pair_n, 3) END"),
        "coefficients_lie_within_one": reduce(and_, within),
    }


def counts_against_cells(by_target: DataFrame, cells: DataFrame) -> DataFrame:
    """target, column, found, expected: counts of a reliability table that the matrix of decisions doesn't give; targets that it lacks too."""
    n, same, binary = F.col("n"), F.col("c1") == F.col("c2"), F.col("c1").isin("present", "absent") & F.col("c2").isin("present", "absent")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    names = ("pair_n", "agreement_n", "disagreement_n", "binary_pair_n", "binary_agreement_n")
    own = cells.groupBy(F.col("target").alias("t")).agg(*[total(c).alias(f"x_{name}") for name, c in zip(names, (F.lit(True), same, ~same, binary, binary & same), strict=True)])
    rows = by_target.join(own, F.col("target") == F.col("t"), "full")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("found"), F.when(F.col("target").isNotNull(), F.coalesce(f"x_{c}", F.lit(0))).otherwise(F.col(f"x_{c}")).cast("long").alias("expected")) for c in names])
    return rows.select(F.coalesce("target", "t").alias("target"), F.explode(each).alias("x")).select("target", "x.*").where("NOT (found <=> expected)")


def pair_rules() -> dict[str, Column]:
    return {
        "cells_sum_to_denominator": F.expr("n11_both_present + n10_a_only + n01_b_only + n00_neither = denominator_n"),
        "no_cell_is_negative": F.expr("least(n11_both_present, n10_a_only, n01_b_only, n00_neither) >= 0"),
        "jaccard_is_a_share": F.expr("jaccard BETWEEN 0 AND 1"),
    }


def rate_rules(rate: str, part: str, whole: str) -> dict[str, Column]:
    return {"rate_is_a_percentage": F.col(rate).between(0, 100), "part_is_in_whole": F.col(part) <= F.col(whole)}


def totals_agree(detail: DataFrame, overall: DataFrame, columns: list[str]) -> DataFrame:
    """column, detail, overall: sums of the detail rows that are not the overall row's."""
    d = detail.agg(*[F.sum(c).cast("double").alias(f"d_{c}") for c in columns])
    o = overall.agg(*[F.sum(c).cast("double").alias(f"o_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("detail"), F.col(f"o_{c}").alias("overall")) for c in columns])
    return d.crossJoin(o).select(F.explode(each).alias("x")).select("x.*").where("NOT (detail <=> overall)")


def row_counts_agree(tables: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """table, found, expected: tables whose numbers of rows are not those of the metadata (table, expected), or that one side lacks."""
    found = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("found")).select(F.lit(name).alias("table"), "found")
        found = one if found is None else found.unionByName(one)
    both = found.join(expected.select("table", F.col("expected").cast("long").alias("expected")), "table", "full")
    return both.select("table", "found", "expected").where("NOT (found <=> expected)")


def write_checked(table: DataFrame, path: str, rules: dict[str, Column], sums: dict[str, float] | None = None, rows: int | None = None) -> dict[str, float]:
    """Write a table as Parquet and check it in the same pass; what breaks a rule is never seen under ``path``.

    The plan runs once: rows, rows that break each rule, and sums of the
    columns in ``sums`` are observed while they are written to a folder beside,
    which gets its name when they are as expected.  Returns what was observed.
    """
    watch = Observation()
    counts = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"broken {k}") for k, c in rules.items()]
    totals = [F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(f"sum {c}") for c in sums or {}]
    beside = f"{path.rstrip('/')}.pending-{uuid.uuid4().hex}"
    table.observe(watch, F.count(F.lit(1)).alias("rows"), *counts, *totals).write.parquet(beside)
    found = watch.get
    faults = [f"{name}: {n} rows" for name, n in found.items() if name.startswith("broken ") and n]
    faults += [f"{name} {found[f'sum {name}']}, expected {x}" for name, x in (sums or {}).items() if found[f"sum {name}"] != x]
    if rows is not None and found["rows"] != rows:
        faults.append(f"{found['rows']} rows, expected {rows}")
    if faults:
        remove(table.sparkSession, beside)
        raise Violation(f"{path}: {'; '.join(faults)}")
    rename(table.sparkSession, beside, path)
    return found


def schema_contract(table: DataFrame, columns: list[str]) -> list[str]:
    """What keeps the table's columns from being exactly these, in this order."""
    if table.columns == columns:
        return []
    missing = [c for c in columns if c not in table.columns]
    extra = [c for c in table.columns if c not in columns]
    return [f"missing: {c}" for c in missing] + [f"extra: {c}" for c in extra] or ["order"]


def blocked_fields(schema: types.StructType, prefix: str = "") -> list[str]:
    """Fields, nested ones too, whose names tell of records rather than aggregates."""
    found = []
    for f in schema.fields:
        name, kind = f.name.strip().lstrip("\ufeff").casefold(), f.dataType
        if name not in ALLOWED_NAMES and (name in BLOCKED_NAMES or set(re.split(r"[^a-z0-9]+", name)) & BLOCKED_PARTS):
            found.append(prefix + f.name)
        while isinstance(kind, types.ArrayType):
            kind = kind.elementType
        if isinstance(kind, types.StructType):
            found += blocked_fields(kind, f"{prefix}{f.name}.")
    return found


def blocked_name(name: Column) -> Column:
    """Whether a name tells of records rather than aggregates: ``blocked_fields`` for names that are data."""
    plain = F.lower(F.trim(name))
    parts = F.split(plain, "[^a-z0-9]+")
    return ~plain.isin(*ALLOWED_NAMES) & (plain.isin(*BLOCKED_NAMES) | F.arrays_overlap(parts, F.array(*map(F.lit, sorted(BLOCKED_PARTS)))))


_SHOWN = "array<struct<place:string,kind:string,shown:string>>"


def _shown(cell: Column, kind: types.DataType, place: Column) -> Column | None:
    """What of a value must not be published, with its place; None where its type holds no text."""
    none = F.array().cast(_SHOWN)
    one = lambda what, x: F.array(F.struct(place.alias("place"), F.lit(what).alias("kind"), x.alias("shown")))
    if isinstance(kind, types.StringType):
        return F.when(cell.rlike(_SHOWS_PATH), one("cell", cell)).otherwise(none)
    if isinstance(kind, types.StructType):
        parts = [_shown(cell[f.name], f.dataType, F.concat(place, F.lit(f".{f.name}"))) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, types.ArrayType):
        if _shown(F.lit(None), kind.elementType, place) is None:
            return None
        inner = F.transform(cell, lambda x, i: _shown(x, kind.elementType, F.concat(place, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(inner), none)
    if isinstance(kind, types.MapType):
        name = lambda e: F.concat(place, F.lit("."), e["key"].cast("string"))
        entries = F.coalesce(F.map_entries(cell), F.array().cast(types.ArrayType(types.StructType([types.StructField("key", kind.keyType), types.StructField("value", kind.valueType)]))))
        parts = []
        if isinstance(kind.keyType, types.StringType):
            parts.append(F.transform(F.filter(entries, lambda e: blocked_name(e["key"])), lambda e: F.struct(name(e).alias("place"), F.lit("key").alias("kind"), e["key"].alias("shown"))))
        if _shown(F.lit(None), kind.valueType, place) is not None:
            parts.append(F.flatten(F.transform(entries, lambda e: _shown(e["value"], kind.valueType, name(e)))))
        return F.concat(*parts) if parts else None
    return None


def exposed(table: DataFrame) -> DataFrame:
    """place, kind, shown: what a table must not be published for, nested values included.

    kind is ``cell`` for texts that show a path of some machine, ``key`` for
    blocked keys of maps and of objects in variants.  A place names the column
    and the way from there: ``.name`` into structs, maps and objects, ``[i]``
    (from 0) into lists.  Typed columns are looked at in one pass, and only
    what is found leaves a row; variants are taken apart level by level.
    """
    parts = [_shown(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in table.schema.fields]
    parts = [p for p in parts if p is not None]
    out = table.sparkSession.createDataFrame([], "place string, kind string, shown string")
    if parts:
        out = out.unionByName(table.select(F.inline(F.concat(*parts))))
    for f in table.schema.fields:
        if isinstance(f.dataType, types.VariantType):
            out = out.unionByName(_exposed_in_variant(table.select(F.lit(f.name).alias("place"), F.col(f"`{f.name}`").alias("value"))))
    return out


def _exposed_in_variant(level: DataFrame) -> DataFrame:
    """place, kind, shown of variants (place, value), one level of nesting after the other."""
    shape = F.schema_of_variant("value")
    out = None
    while True:
        level = cut(level.where("value IS NOT NULL").withColumn("shape", shape))
        text = F.expr("try_variant_get(value, '$', 'string')")
        cells = level.where((F.col("shape") == "STRING") & text.rlike(_SHOWS_PATH)).select("place", F.lit("cell").alias("kind"), text.alias("shown"))
        out = cells if out is None else out.unionByName(cells)
        nested = level.where("shape LIKE 'OBJECT%' OR shape LIKE 'ARRAY%'")
        if nested.isEmpty():
            return out
        inner = cut(nested.select("place", F.col("value").alias("whole")).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("whole").outer())).select("place", "pos", "key", "value"))
        out = out.unionByName(inner.where(F.col("key").isNotNull() & blocked_name(F.col("key"))).select(F.concat("place", F.lit("."), "key").alias("place"), F.lit("key").alias("kind"), F.col("key").alias("shown")))
        level = inner.select(F.when(F.col("key").isNotNull(), F.concat("place", F.lit("."), "key")).otherwise(F.concat("place", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).alias("place"), "value")


def local_paths(table: DataFrame) -> DataFrame:
    """column, cell: string cells that show a path of some machine, a file address too; web addresses pass."""
    names = [f.name for f in table.schema.fields if isinstance(f.dataType, types.StringType)]
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("cell")) for c in names])
    return table.select(F.explode(F.filter(each, lambda x: x["cell"].rlike(_SHOWS_PATH))).alias("x")).select("x.*")
