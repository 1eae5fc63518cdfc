"""Two coders, an adjudication and a machine: records, agreement, intervals, and machine metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import stats as S
from ..functions import text as T
from ..sources.shared import ship

REPLICATES = 1_000
#: Fixed value: fewer usable estimates give no interval.
LEAST_ESTIMATES = 100
BINARY = ("present", "absent")
TARGET = ["target_type", "code"]


def records(machine: DataFrame, coder_1: DataFrame, coder_2: DataFrame, adjudication: DataFrame | None = None) -> DataFrame:
    """One row a record: target, machine flag, weight, both decisions, the final one.

    Sheets are joined by record id; gates check beforehand that they hold the
    same ids once each.  Weights are null where the machine's sheet has none.
    """
    weight = T.weight(F.col("analysis_weight")) if "analysis_weight" in machine.columns else F.lit(None).cast("double")
    m = machine.select("record_id", *TARGET, T.machine_flag(F.col("model_present")).alias("model_present"), weight.alias("weight"))
    a = coder_1.select("record_id", T.decision(F.col("decision")).alias("decision_1"))
    b = coder_2.select("record_id", T.decision(F.col("decision")).alias("decision_2"))
    rows = m.join(a, "record_id").join(b, "record_id")
    if adjudication is None:
        return rows.withColumn("final", T.final_decision(F.col("decision_1"), F.col("decision_2")))
    own = adjudication.select("record_id", T.decision(F.col("adjudicated_decision")).alias("adjudicated"))
    return rows.join(own, "record_id", "left").withColumn("final", T.final_decision(F.col("decision_1"), F.col("decision_2"), F.col("adjudicated"))).drop("adjudicated")


def _both(first: str, second: str) -> Column:
    return (F.col("decision_1") == first) & (F.col("decision_2") == second)


def counts(rows: DataFrame) -> DataFrame:
    """Overall (blank target) and for each target: decisions, agreement, the 2 x 2 cells, confusion, weighted sums.

    One pass with grouping sets; every later figure is arithmetic on these counts.
    """
    d1, d2, final = F.col("decision_1"), F.col("decision_2"), F.col("final")
    complete = (d1 != "") & (d2 != "")
    binary = final.isin(*BINARY)
    aggs: list[Column] = [F.count("*").alias("record_n")]
    for who, col in (("coder_1", d1), ("coder_2", d2), ("final", final)):
        aggs += [F.count_if(col == d).alias(f"{who}_{d}_n") for d in T.DECISIONS]
    aggs += [
        F.count_if(complete).alias("complete_pair_n"), F.count_if(complete & (d1 == d2)).alias("agreement_n"),
        F.count_if(_both("present", "absent")).alias("present_absent_n"), F.count_if(_both("absent", "present")).alias("absent_present_n"),
        F.count_if(_both("present", "present")).alias("present_present_n"), F.count_if(_both("absent", "absent")).alias("absent_absent_n"),
        F.count_if(complete & (d1 != d2) & ~(d1.isin(*BINARY) & d2.isin(*BINARY))).alias("other_disagreement_n"),
        F.count_if(final == "").alias("unresolved_n"), F.count_if((final != "") & ~binary).alias("excluded_n"),
    ]
    cells = {"tp": ("present", True), "fp": ("absent", True), "tn": ("absent", False), "fn": ("present", False)}
    for name, (d, flag) in cells.items():
        hit = (final == d) & (F.col("model_present") == flag)
        aggs += [F.count_if(hit).alias(name), F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0.0)).alias(f"w_{name}"), F.coalesce(F.sum(F.when(hit, F.pow("weight", F.lit(2.0)))), F.lit(0.0)).alias(f"q_{name}")]
    aggs.append(F.count_if(F.col("weight").isNotNull()).alias("weighted_n"))
    out = rows.groupingSets([[], [F.col("target_type"), F.col("code")]], F.col("target_type"), F.col("code")).agg(*aggs, F.grouping("code").alias("g"))
    return out.withColumns({c: F.when(F.col("g") == 1, F.lit("(all)")).otherwise(F.col(c)) for c in TARGET}).drop("g")


def agreement(table: DataFrame) -> DataFrame:
    """Agreement with Wilson's interval, binary kappa and AC1, from ``counts``."""
    low, high = S.wilson(F.col("agreement_n"), F.col("complete_pair_n"))
    four = [F.col(c) for c in ("present_present_n", "present_absent_n", "absent_present_n", "absent_absent_n")]
    return table.withColumns({
        "agreement": S.share(F.col("agreement_n"), F.col("complete_pair_n")), "agreement_low": low, "agreement_high": high,
        "binary_pair_n": four[0] + four[1] + four[2] + four[3], "kappa": S.kappa_binary(*four), "ac1": S.ac1_binary(*four),
    })


def _metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, tuple[Column, Column]]:
    return {"precision": (tp, tp + fp), "npv": (tn, tn + fn), "sensitivity": (tp, tp + fn), "specificity": (tn, tn + fp), "accuracy": (tp + tn, tp + fp + tn + fn)}


def machine_metrics(table: DataFrame) -> DataFrame:
    """Precision, NPV, sensitivity, specificity, accuracy with intervals, F1 and balanced accuracy."""
    out = {}
    for name, (k, n) in _metrics(*map(F.col, ("tp", "fp", "tn", "fn"))).items():
        low, high = S.wilson(k, n)
        out |= {name: S.share(k, n), f"{name}_low": low, f"{name}_high": high}
    p, r = out["precision"], out["sensitivity"]
    out["f1"] = S.share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    out["balanced_accuracy"] = (r + out["specificity"]) / 2
    del p
    return table.withColumns(out)


def weighted_metrics(table: DataFrame) -> DataFrame:
    """The same metrics over weights, with Wilson's interval on Kish's effective number of each denominator; null without weights."""
    given = F.col("weighted_n") > 0
    w = _metrics(*[F.col(f"w_{c}") for c in ("tp", "fp", "tn", "fn")])
    q = _metrics(*[F.col(f"q_{c}") for c in ("tp", "fp", "tn", "fn")])
    out = {}
    for name, (k, n) in w.items():
        p, eff = S.share(k, n), S.kish(n, q[name][1])
        low, high = S.wilson(p * eff, eff)
        out |= {f"weighted_{name}": F.when(given, p), f"weighted_{name}_effective_n": F.when(given, eff), f"weighted_{name}_low": F.when(given, low), f"weighted_{name}_high": F.when(given, high)}
    return table.withColumns(out)


def cells(rows: DataFrame) -> DataFrame:
    """target, c1, c2, n over complete pairs: at most 25 rows a target."""
    complete = rows.where("decision_1 <> '' AND decision_2 <> ''")
    return complete.groupBy(F.concat_ws("/", *TARGET).alias("target"), F.col("decision_1").alias("c1"), F.col("decision_2").alias("c2")).agg(F.count("*").alias("n"))


def nominal_kappa(table: DataFrame) -> DataFrame:
    """target, pair_n, kappa over all categories of ``cells``; null where agreement by chance is certain."""
    n = table.groupBy("target").agg(F.sum("n").alias("pair_n"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("n")).otherwise(0)).alias("agree"))
    a = table.groupBy("target", F.col("c1").alias("c")).agg(F.sum("n").alias("x"))
    b = table.groupBy("target", F.col("c2").alias("c")).agg(F.sum("n").alias("y"))
    chance = a.join(b, ["target", "c"]).groupBy("target").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    rows = n.join(chance, "target", "left").fillna(0, ["xy"])
    seen, expected = F.col("agree") / F.col("pair_n"), F.col("xy") / (F.col("pair_n").cast("double") * F.col("pair_n"))
    return rows.select("target", "pair_n", F.when(F.abs(1 - expected) >= 1e-9, (seen - expected) / (1 - expected)).alias("kappa"))


def krippendorff_alpha(table: DataFrame) -> DataFrame:
    """target, alpha: Krippendorff's nominal alpha of the pairs in ``cells``.

    Both decisions of a unit enter the coincidence matrix, so categories are
    pooled over the coders; units that one coder left blank have no pair and
    are no part of ``cells``.  Null where chance gives no disagreement: without
    pairs, or with one category alone.
    """
    differ = table.groupBy("target").agg(F.sum("n").alias("pair_n"), F.coalesce(F.sum(F.when(F.col("c1") != F.col("c2"), F.col("n"))), F.lit(0)).alias("differ"))
    told = table.select("target", F.explode(F.array("c1", "c2")).alias("c"), "n").groupBy("target", "c").agg(F.sum("n").cast("double").alias("x"))
    same = told.groupBy("target").agg(F.sum(F.col("x") * (F.col("x") - 1)).alias("same"))
    values = 2 * F.col("pair_n").cast("double")
    chance = values * (values - 1) - F.col("same")
    return differ.join(same, "target").select("target", "pair_n", F.when(chance > 0, 1 - (values - 1) * 2 * F.col("differ") / chance).alias("alpha"))


#: Replicates that one row of work stands for.
BLOCK = 250


def seed_of(label: str, target: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(label), target)), 1, 7), 16, 10).cast("long")


def _statistics(cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cohen's kappa over k categories, and Gwet's AC1 over the first two, of each row of k * k cells; nan where undefined."""
    square = cells.reshape(-1, k, k).astype(np.float64)
    n = square.sum((1, 2))
    with np.errstate(invalid="ignore", divide="ignore"):
        seen = np.trace(square, axis1=1, axis2=2) / n
        chance = ((square.sum(2) / n[:, None]) * (square.sum(1) / n[:, None])).sum(1)
        kappa = np.where(np.abs(1 - chance) >= 1e-9, (seen - chance) / (1 - chance), np.nan)
        share = (square[:, 0, :].sum(1) / n + square[:, :, 0].sum(1) / n) / 2
        chance = 2 * share * (1 - share)
        ac1 = np.where(np.abs(1 - chance) >= 1e-9, (seen - chance) / (1 - chance), np.nan)
    return kappa, ac1


def estimates(table: DataFrame, categories: tuple[str, ...], replicates: int, label: str) -> DataFrame:
    """target, pair_n, kappa, ac1 of each replicate of each target: as many pairs of ``categories`` drawn with replacement as there are.

    A replicate is drawn as counts of the categories' cells (``functions.draws``), so its work doesn't depend on the
    number of pairs; replicates are dealt in blocks, so one target is no single task.  AC1 is of the first two
    categories, and only meant where there are no others.
    """
    k = len(categories)
    inside = table.where(F.col("c1").isin(*categories) & F.col("c2").isin(*categories))
    counts = [F.coalesce(F.sum(F.when((F.col("c1") == x) & (F.col("c2") == y), F.col("n"))), F.lit(0)).cast("long") for x in categories for y in categories]
    own = inside.groupBy("target").agg(F.array(*counts).alias("counts")).withColumn("seed", seed_of(label, F.col("target")))
    blocks = own.withColumn("first", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(BLOCK)))).repartition("target", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reps = np.arange(r["first"], min(r["first"] + BLOCK, replicates + 1))
                kappa, ac1 = _statistics(draws.resampled(r["counts"], r["seed"], reps), k)
                told = [pa.array([v] * len(reps), t) for v, t in ((r["target"], pa.string()), (sum(r["counts"]), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*told, *[pa.array(x, pa.float64(), from_pandas=True) for x in (kappa, ac1)]], ["target", "pair_n", "kappa", "ac1"])

    ship(table.sparkSession)
    return blocks.select("target", "counts", "seed", "first").mapInArrow(run, "target string, pair_n long, kappa double, ac1 double")


def intervals(drawn: DataFrame, names: tuple[str, ...], least_pairs: int, least: int) -> DataFrame:
    """target, and the 2.5 and 97.5 percentiles of the named estimates where there are ``least`` ones and ``least_pairs`` pairs."""
    enough = lambda name: (F.count(name) >= least) & (F.max("pair_n") >= least_pairs)
    bounds = [F.when(enough(name), F.percentile(name, F.lit(p))).alias(f"{name}_{side}") for name in names for side, p in (("low", 0.025), ("high", 0.975))]
    return drawn.groupBy("target").agg(*bounds)


def bootstrap(table: DataFrame, replicates: int = REPLICATES, label: str = "bootstrap") -> DataFrame:
    """target, and the interval of binary kappa and of AC1 over resampled binary pairs.

    table: ``cells`` or any counts of two decisions.  Fewer than two pairs, or
    than LEAST_ESTIMATES replicates in which the statistic is defined, give no
    interval; every target of ``table`` has a row.
    """
    found = intervals(estimates(table, BINARY, replicates, label), ("kappa", "ac1"), 2, LEAST_ESTIMATES)
    return table.select("target").distinct().join(found, "target", "left")


def bootstrap_by_target(table: DataFrame, replicates: int = REPLICATES, label: str = "bootstrap") -> DataFrame:
    """target, and the intervals of its own table: nominal kappa over all complete pairs, AC1 over the binary ones.

    Here one defined replicate is enough; only a target without any has no interval.
    """
    nominal = intervals(estimates(table, T.DECISIONS, replicates, f"{label}-nominal"), ("kappa",), 1, 1).withColumnsRenamed({"kappa_low": "nominal_kappa_low", "kappa_high": "nominal_kappa_high"})
    drawn = estimates(table, BINARY, replicates, label)
    strict = intervals(drawn, ("kappa",), 2, LEAST_ESTIMATES).withColumnsRenamed({"kappa_low": "binary_kappa_low", "kappa_high": "binary_kappa_high"})
    return table.select("target").distinct().join(nominal, "target", "left").join(intervals(drawn, ("ac1",), 1, 1), "target", "left").join(strict, "target", "left")


BOUNDS = [f"{s}_{side}" for s in ("nominal_kappa", "binary_kappa", "ac1") for side in ("low", "high")]


def reliability_by_target(rows: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Each target: agreement in percent with interval, nominal kappa with interval, Krippendorff's alpha, binary subset, AC1 with interval, adjudication.

    Without replicates the bounds are null and cost nothing.
    """
    table = cells(rows)
    if replicates:
        drawn = bootstrap_by_target(table, replicates)
    else:
        drawn = table.select("target").distinct().withColumns({c: F.lit(None).cast("double") for c in BOUNDS})
    base = rows.groupBy(F.concat_ws("/", *TARGET).alias("target")).agg(
        F.count_if((F.col("decision_1") != "") & (F.col("decision_2") != "")).alias("pair_n"),
        F.count_if((F.col("decision_1") != "") & (F.col("decision_1") == F.col("decision_2"))).alias("agreement_n"),
        *[F.count_if(_both(x, y)).alias(f"{x[0]}{y[0]}") for x in BINARY for y in BINARY],
        *[F.count_if((F.col("decision_1") != F.col("decision_2")) & (F.col("decision_1") != "") & (F.col("decision_2") != "") & (F.col("final") == d)).alias(f"adjudicated_{d}_n") for d in T.DECISIONS],
    )
    low, high = S.wilson(F.col("agreement_n"), F.col("pair_n"))
    four = [F.col(c) for c in ("pp", "pa", "ap", "aa")]
    out = base.join(nominal_kappa(table).select("target", "kappa"), "target", "left").join(krippendorff_alpha(table).select("target", "alpha"), "target", "left").join(drawn, "target", "left")
    six = lambda c: F.bround(c, 6)
    return out.select(
        "target", "pair_n", "agreement_n", (F.col("pair_n") - F.col("agreement_n")).alias("disagreement_n"),
        S.percent(F.col("agreement_n"), F.col("pair_n")).alias("agreement_pct"), F.bround(100 * low, 3).alias("agreement_low_pct"), F.bround(100 * high, 3).alias("agreement_high_pct"),
        six(F.col("kappa")).alias("nominal_kappa"), six(F.col("alpha")).alias("krippendorff_alpha"), (four[0] + four[1] + four[2] + four[3]).alias("binary_pair_n"), (four[0] + four[3]).alias("binary_agreement_n"),
        S.percent(four[0] + four[3], four[0] + four[1] + four[2] + four[3]).alias("binary_agreement_pct"), six(S.kappa_binary(*four)).alias("binary_kappa"), six(S.ac1_binary(*four)).alias("ac1"),
        *[six(F.col(c)).alias(c) for c in BOUNDS], *[f"adjudicated_{d}_n" for d in T.DECISIONS],
    )


def totals(by_target: DataFrame) -> DataFrame:
    adjudicated = sum((F.col(f"adjudicated_{d}_n") for d in T.DECISIONS[1:]), F.col(f"adjudicated_{T.DECISIONS[0]}_n"))
    return by_target.agg(F.count("*").alias("target_n"), F.sum("pair_n").alias("pair_n"), F.sum("disagreement_n").alias("disagreement_n"), F.sum(adjudicated).alias("adjudicated_n"))


def adjudication_gaps(by_target: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """Targets that only one table has, or whose adjudicated rows are not their disagreements."""
    both = by_target.select("target", "disagreement_n").join(adjudicated.select("target", "adjudicated_n"), "target", "full")
    bad = F.when(F.col("adjudicated_n").isNull(), "no_adjudication").when(F.col("disagreement_n").isNull(), "no_reliability").when(F.col("adjudicated_n") != F.col("disagreement_n"), "counts_differ")
    return both.select("target", bad.alias("violation")).where("violation IS NOT NULL")
