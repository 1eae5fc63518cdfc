"""Sensitivity, co-occurrence, crosswalk, source and concentration tables over two populations.

The tables of codes and pairs of codes come from one ``cube``: each note is
read once, with its codes as a list, and counted into the cells of its source
(the note itself, each of its codes, each pair of them), in both populations
side by side.  Sums over sources come from those cells, not from notes, and
what leaves a source out is the whole minus that source.  Codes are a dimension
of the codebook's size; a note's own pairs are bounded by it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sources.shared import cut
from .coding import ranked
from .populations import FULL, UNIQUE, sizes

CELLS = ["n11_both_present", "n10_a_only", "n01_b_only", "n00_neither"]
FAMILY = "typology"
_KEY = "struct<family:string,code:string>"


# --- the cube ---------------------------------------------------------------------------------------------------


def cube(notes: DataFrame) -> DataFrame:
    """every, source, a, b, label, full_n, unique_n from source, unique (0 or 1) and carried (family, code, label) of each note.

    a and b are (family, code): both null for the notes themselves, equal for
    the notes with a code, a < b for those with both.  every is 1 in the rows
    over all sources.  A source without a note in the second population has
    its cells all the same, with none.  Cells of a source are summed in each
    task before they move, so a source that holds most of the notes is a few
    rows a task; the result is written once.
    """
    null = F.lit(None).cast(_KEY)
    key = lambda x: F.struct(x["family"].alias("family"), x["code"].alias("code"))
    cell = lambda a, b, label: F.struct(a.alias("a"), b.alias("b"), label.alias("label"))
    no_label = F.lit(None).cast("string")
    own = F.transform("carried", lambda x: cell(key(x), key(x), x["label"]))
    keys = F.array_sort(F.array_distinct(F.transform("carried", key)))
    pairs = F.flatten(F.transform("keys", lambda a: F.transform(F.filter("keys", lambda b: b > a), lambda b: cell(a, b, no_label))))
    rows = notes.select("source", "unique", own.alias("own"), keys.alias("keys"))
    rows = rows.select("source", "unique", F.explode(F.concat(F.array(cell(null, null, no_label)), "own", pairs)).alias("c"))
    sums = [F.min("label").alias("label"), F.sum("full_n").alias("full_n"), F.sum("unique_n").alias("unique_n")]
    cells = rows.groupBy("source", F.col("c.a").alias("a"), F.col("c.b").alias("b")).agg(F.min("c.label").alias("label"), F.count("*").alias("full_n"), F.sum("unique").alias("unique_n"))
    both = cells.groupingSets([[F.col("source"), F.col("a"), F.col("b")], [F.col("a"), F.col("b")]], F.col("source"), F.col("a"), F.col("b")).agg(*sums, F.grouping("source").cast("int").alias("every"))
    return cut(both.select("every", "source", "a", "b", "label", F.col("full_n").cast("long").alias("full_n"), F.col("unique_n").cast("long").alias("unique_n")))


def cube_of(presence: DataFrame, members: DataFrame, **more: DataFrame) -> DataFrame:
    """The cube of notes told as ``members`` and ``presence``, further families' presence by name: one shuffle by note."""
    told = presence.where(F.col("population") == FULL).select("note_id", F.lit(FAMILY).alias("family"), "code", "label")
    for name, other in more.items():
        told = told.unionByName(other.where(F.col("population") == FULL).select("note_id", F.lit(name).alias("family"), "code", "label"))
    carried = told.groupBy("note_id").agg(F.collect_set(F.struct("family", "code", "label")).alias("carried"))
    flags = members.groupBy("note_id").agg(F.max("source").alias("source"), F.max((F.col("population") == UNIQUE).cast("int")).alias("unique"))
    rows = flags.join(carried, "note_id", "left")
    return cube(rows.withColumn("carried", F.coalesce("carried", F.array().cast("array<struct<family:string,code:string,label:string>>"))))


def _stacked(rows: DataFrame) -> DataFrame:
    """A row for each population, with its count n."""
    each = F.array(F.struct(F.lit(FULL).alias("population"), F.col("full_n").alias("n")), F.struct(F.lit(UNIQUE).alias("population"), F.col("unique_n").alias("n")))
    return rows.select("*", F.inline(each)).drop("full_n", "unique_n")


def _of_codes(table: DataFrame, family: str, every: int) -> DataFrame:
    return table.where((F.col("every") == every) & (F.col("a") == F.col("b")) & (F.col("a.family") == family)).withColumn("code", F.col("a.code"))


def _of_notes(table: DataFrame, every: int) -> DataFrame:
    return table.where((F.col("every") == every) & F.col("a").isNull())


def _pairs(table: DataFrame, every: int, left: str = FAMILY, right: str = FAMILY) -> DataFrame:
    """population, (source,) code_a, code_b with both margins, the joint count and the denominator: every pair of codes that occur.

    Each cell is told to the pairs that it counts for and they are summed: one
    shuffle of cells, no join.  Pairs of one family are in order.
    """
    keys = ["population"] + ["source"] * (not every)
    same = left == right
    codes = lambda family: F.array_sort(F.collect_set(F.when((F.col("every") == 1) & (F.col("a") == F.col("b")) & (F.col("a.family") == family), F.col("a.code"))))
    known = table.agg(codes(left).alias("left"), codes(right).alias("right"))  # one row, of the codebook's size
    rows = _stacked(table.where(F.col("every") == every)).crossJoin(F.broadcast(known))

    def told(a: Column, b: Column, role: str) -> Column:
        return F.struct(a.alias("code_a"), b.alias("code_b"), F.lit(role).alias("role"))

    after = lambda x: F.filter("right", lambda y: y > x) if same else F.col("right")
    before = lambda y: F.filter("left", lambda x: x < y) if same else F.col("left")
    a, b = F.col("a"), F.col("b")
    none = F.array().cast("array<struct<code_a:string,code_b:string,role:string>>")
    grid = F.when(a.isNull(), F.flatten(F.transform("left", lambda x: F.transform(after(x), lambda y: told(x, y, "n"))))).otherwise(none)
    as_a = F.when((a == b) & (a["family"] == left), F.transform(after(a["code"]), lambda y: told(a["code"], y, "a"))).otherwise(none)
    as_b = F.when((a == b) & (a["family"] == right), F.transform(before(a["code"]), lambda x: told(x, a["code"], "b"))).otherwise(none)
    joint = F.when((a != b) & (a["family"] == left) & (b["family"] == right), F.array(told(a["code"], b["code"], "ab")))
    if not same:
        joint = joint.when((a != b) & (a["family"] == right) & (b["family"] == left), F.array(told(b["code"], a["code"], "ab")))
    rows = rows.select(*keys, "n", F.explode(F.concat(grid, as_a, as_b, joint.otherwise(none))).alias("p")).select(*keys, "n", "p.*")
    own = lambda role, name: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0)).alias(name)
    return rows.groupBy(*keys, "code_a", "code_b").agg(own("n", "denominator_n"), own("a", "code_a_present_n"), own("b", "code_b_present_n"), own("ab", "n11_both_present"))


def _cells(rows: DataFrame) -> DataFrame:
    """The 2 x 2 cells, Jaccard and lift from n11, both margins and the denominator."""
    a, b, n11, n = F.col("code_a_present_n"), F.col("code_b_present_n"), F.col("n11_both_present"), F.col("denominator_n")
    return rows.withColumns({
        "n10_a_only": a - n11, "n01_b_only": b - n11, "n00_neither": n - a - b + n11,
        "jaccard": S.ratio(n11, a + b - n11), "lift": S.lift(n11, a, b, n),
    })


# --- tables from the cube ---------------------------------------------------------------------------------------


def sensitivity_of(table: DataFrame) -> DataFrame:
    """Each code's count, share and rank in both populations, and what duplicates add."""
    whole = _of_notes(table, 1).select(F.col("full_n").alias("full_size"), F.col("unique_n").alias("unique_size"))
    rows = _of_codes(table, FAMILY, 1).select("code", "label", "full_n", "unique_n").crossJoin(F.broadcast(whole))  # one row
    rows = ranked(ranked(rows, "full_n", name="full_rank"), "unique_n", name="unique_rank")
    rows = rows.withColumns({"full_pct": S.percent(F.col("full_n"), F.col("full_size")), "unique_pct": S.percent(F.col("unique_n"), F.col("unique_size"))})
    return rows.select("code", "label", "full_n", "full_pct", "full_rank", "unique_n", "unique_pct", "unique_rank").withColumns({
        "excess_n": F.col("full_n") - F.col("unique_n"),
        "reduction_pct": S.percent(F.col("full_n") - F.col("unique_n"), F.col("full_n")),
        "pct_difference": F.bround(F.col("unique_pct") - F.col("full_pct"), 3),
        "rank_change": F.col("unique_rank") - F.col("full_rank"),
    })


def cooccurrence_of(table: DataFrame) -> DataFrame:
    """Every pair of codes in each population, pairs that never meet too."""
    return _cells(_pairs(table, 1))


def cooccurrence_by_source_of(table: DataFrame) -> DataFrame:
    """Every pair in each population and source."""
    return _cells(_pairs(table, 0))


def leave_source_out_of(table: DataFrame) -> DataFrame:
    """Every pair without each source: the whole less that source, and how Jaccard and lift change."""
    return leave_source_out(cooccurrence_of(table), _pairs(table, 0))


def leave_source_out(whole: DataFrame, by_source: DataFrame) -> DataFrame:
    """The same from the tables of all and of each source."""
    keys = ["population", "code_a", "code_b"]
    sums = ["denominator_n", "code_a_present_n", "code_b_present_n", "n11_both_present"]
    part = by_source.select(*keys, F.col("source").alias("removed_source"), *[F.col(c).alias(f"own_{c}") for c in sums])
    full = whole.select(*keys, *sums, F.col("jaccard").alias("full_jaccard"), F.col("lift").alias("full_lift"))
    rows = part.join(full, keys).select(*keys, "removed_source", "full_jaccard", "full_lift", *[(F.col(c) - F.col(f"own_{c}")).alias(c) for c in sums])
    return _cells(rows).withColumns({
        "jaccard_difference": F.bround(F.col("jaccard") - F.col("full_jaccard"), 6),
        "lift_difference": F.bround(F.col("lift") - F.col("full_lift"), 6),
    })


def crosswalk_of(table: DataFrame, excluded: DataFrame, other: str = "indicator") -> DataFrame:
    """Typology by indicator in each population, without the pairs that are linked by design."""
    rows = _pairs(table, 1, FAMILY, other).join(excluded.select("code_a", "code_b").distinct(), ["code_a", "code_b"], "left_anti")
    n11 = F.col("n11_both_present")
    return _cells(rows).withColumns({"share_of_a": S.ratio(n11, F.col("code_a_present_n")), "share_of_b": S.ratio(n11, F.col("code_b_present_n"))})


def concentration_of(table: DataFrame) -> DataFrame:
    """How far each code rests on few sources: top one and three, their share, and the Herfindahl index."""
    counts = _stacked(_of_codes(table, FAMILY, 0)).where("n > 0").select("population", "code", "source", F.col("n").alias("k"))
    place = F.row_number().over(Window.partitionBy("population", "code").orderBy(F.desc("k"), "source"))
    total = F.sum("k").over(Window.partitionBy("population", "code"))
    rows = counts.withColumns({"place": place, "total": total}).withColumn("share", F.col("k") / F.col("total"))
    out = rows.groupBy("population", "code").agg(
        F.max("total").alias("positive_records_n"), F.count("*").alias("source_groups_with_positive_records_n"),
        F.max(F.when(F.col("place") == 1, F.col("source"))).alias("top_source"), F.max(F.when(F.col("place") == 1, F.col("k"))).alias("top_source_positive_records_n"),
        F.sum(F.when(F.col("place") <= 3, F.col("k")).otherwise(0)).alias("top3"), F.bround(F.sum(F.col("share") * F.col("share")), 6).alias("source_hhi"),
    )
    grid = _stacked(_of_codes(table, FAMILY, 1)).select("population", "code").join(_stacked(_of_notes(table, 1)).select("population", F.col("n").alias("denominator_n")), "population")
    out = grid.join(out, ["population", "code"], "left").fillna(0, ["positive_records_n", "source_groups_with_positive_records_n", "top_source_positive_records_n", "top3", "source_hhi"]).fillna("", ["top_source"])
    out = out.withColumns({"top_source_share": S.ratio(F.col("top_source_positive_records_n"), F.col("positive_records_n")), "top_three_source_share": S.ratio(F.col("top3"), F.col("positive_records_n"))})
    return ranked(out, "positive_records_n", ["population"], "rank_by_record_count").drop("top3")


def leave_source_out_ranks_of(table: DataFrame) -> DataFrame:
    """Each code's count, share and rank without each source, and how the rank changes."""
    n = lambda rows, name: rows.withColumnRenamed("n", name)
    whole = n(_stacked(_of_codes(table, FAMILY, 1)), "k").select("population", "code", "k").join(n(_stacked(_of_notes(table, 1)), "denominator_n").select("population", "denominator_n"), "population")
    whole = ranked(whole, "k", ["population"], "full_rank")
    own_n = n(_stacked(_of_notes(table, 0)), "own_n").select("population", "source", "own_n")
    own = n(_stacked(_of_codes(table, FAMILY, 0)), "own_k").select("population", "source", "code", "own_k")
    rows = own_n.join(whole, "population").join(own, ["population", "source", "code"], "left").fillna(0, ["own_k"])
    rows = rows.select("population", F.col("source").alias("removed_source"), "code", "full_rank", (F.col("denominator_n") - F.col("own_n")).alias("denominator_n"), (F.col("k") - F.col("own_k")).alias("record_n"))
    rows = ranked(rows, "record_n", ["population", "removed_source"], "rank")
    return rows.withColumns({"record_pct": S.percent(F.col("record_n"), F.col("denominator_n")), "rank_change": F.col("rank") - F.col("full_rank")})


# --- the same from presence and members -------------------------------------------------------------------------


def sensitivity(presence: DataFrame, members: DataFrame) -> DataFrame:
    return sensitivity_of(cube_of(presence, members))


def cooccurrence(presence: DataFrame, members: DataFrame) -> DataFrame:
    return cooccurrence_of(cube_of(presence, members))


def cooccurrence_by_source(presence: DataFrame, members: DataFrame) -> DataFrame:
    return cooccurrence_by_source_of(cube_of(presence, members))


def crosswalk(types: DataFrame, indicators: DataFrame, members: DataFrame, excluded: DataFrame) -> DataFrame:
    return crosswalk_of(cube_of(types, members, indicator=indicators), excluded)


def concentration(presence: DataFrame, members: DataFrame) -> DataFrame:
    return concentration_of(cube_of(presence, members))


def leave_source_out_ranks(presence: DataFrame, members: DataFrame) -> DataFrame:
    return leave_source_out_ranks_of(cube_of(presence, members))


# --- tables that look at notes ----------------------------------------------------------------------------------


def _codes(presence: DataFrame) -> DataFrame:
    """Codes that occur anywhere: the grid also where a population or source has none."""
    return presence.groupBy("code").agg(F.min("label").alias("label"))


def _source_grid(members: DataFrame) -> DataFrame:
    """Every source of the corpus in each population."""
    return members.select("source").distinct().join(F.broadcast(members.select("population").distinct()))


def source_normalized(presence: DataFrame, members: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each code's rate in each source, with the source's modalities and its share of all that carry the code."""
    keys = ["population", "source"]
    flags = members.join(corpus.select("note_id", "markdown_present", "ocr_present"), "note_id")
    md, ocr = F.col("markdown_present") == 1, F.col("ocr_present") == 1
    n = flags.groupBy(*keys).agg(F.count("*").alias("source_record_n"), F.count_if(md & ~ocr).alias("markdown_only_n"), F.count_if(ocr & ~md).alias("ocr_only_n"), F.count_if(md & ocr).alias("both_n"), F.count_if(~md & ~ocr).alias("neither_n"))
    counts = presence.groupBy(*keys, "code").agg(F.count("*").alias("positive_records_n"))
    total = presence.groupBy("population", "code").agg(F.count("*").alias("all_positive_n"))
    rows = _source_grid(members).join(n, keys, "left").join(F.broadcast(_codes(presence)))
    rows = rows.join(counts, [*keys, "code"], "left").join(total, ["population", "code"], "left").fillna(0)
    return rows.withColumns({"rate_pct": S.percent(F.col("positive_records_n"), F.col("source_record_n")), "share_of_all_positive": S.ratio(F.col("positive_records_n"), F.col("all_positive_n"))})


def group_union(presence: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Notes with any code of a group; a note with two of them counts once."""
    own = presence.join(groups.select("code", "group"), "code").select("population", "group", "note_id").distinct().groupBy("population", "group").agg(F.count("*").alias("record_n"))
    grid = groups.select("group").distinct().join(F.broadcast(sizes(members)))
    rows = grid.join(own, ["population", "group"], "left").fillna(0, ["record_n"])
    return rows.withColumn("record_pct", S.percent(F.col("record_n"), F.col("denominator_n")))
