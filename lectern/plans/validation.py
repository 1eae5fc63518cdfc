"""Queries over rankings, sets, human validation, and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws as D
from ..functions import stats as S
from ..functions import text as T
from ..operators import coding, derived, extract, gates, populations, quantiles, reliability, resolve
from ..sources import files
from . import model as M
from . import notes as N
from .registry import query


def c(name: str):
    return F.col(name)


# --- human validation -------------------------------------------------------------------------------------------

def _count_if(condition: str, name: str) -> str:
    return f"count(*) FILTER ({condition}) AS {name}"


_COUNTS = ["count(*) AS record_n"]
for _who, _col in (("coder_1", "decision_1"), ("coder_2", "decision_2"), ("final", "final")):
    _COUNTS += [_count_if(f"{_col} = '{d}'", f"{_who}_{d}_n") for d in T.DECISIONS]
_BIN = "('present', 'absent')"
_COUNTS += [
    _count_if("decision_1 <> '' AND decision_2 <> ''", "complete_pair_n"), _count_if("decision_1 <> '' AND decision_1 = decision_2", "agreement_n"),
    _count_if("decision_1 = 'present' AND decision_2 = 'absent'", "present_absent_n"), _count_if("decision_1 = 'absent' AND decision_2 = 'present'", "absent_present_n"),
    _count_if("decision_1 = 'present' AND decision_2 = 'present'", "present_present_n"), _count_if("decision_1 = 'absent' AND decision_2 = 'absent'", "absent_absent_n"),
    _count_if(f"decision_1 <> decision_2 AND NOT (decision_1 IN {_BIN} AND decision_2 IN {_BIN})", "other_disagreement_n"),
    _count_if("final = ''", "unresolved_n"), _count_if(f"final <> '' AND final NOT IN {_BIN}", "excluded_n"),
]
for _name, _cond in (("tp", "final = 'present' AND model_present"), ("fp", "final = 'absent' AND model_present"), ("tn", "final = 'absent' AND NOT model_present"), ("fn", "final = 'present' AND NOT model_present")):
    _COUNTS += [_count_if(_cond, _name), f"coalesce(sum(weight) FILTER ({_cond}), 0) AS w_{_name}", f"coalesce(sum(weight * weight) FILTER ({_cond}), 0) AS q_{_name}"]
_COUNTS.append("count(weight) AS weighted_n")
COUNTS = M.SHEETS_SQL + f""", counts AS (SELECT CASE GROUPING(code) WHEN 1 THEN '(all)' ELSE target_type END AS target_type, CASE GROUPING(code) WHEN 1 THEN '(all)' ELSE code END AS code, {', '.join(_COUNTS)} FROM records GROUP BY GROUPING SETS ((), (target_type, code)))"""


def _counts(spark, sf):
    return reliability.counts(M.records(spark, sf))


def _wilson(k: str, n: str, side: str) -> str:
    z = S.Z
    n = f"nullif(CAST({n} AS DOUBLE), 0)"
    middle = f"((({k}) / {n} + {z * z} / (2 * {n})) / (1 + {z * z} / {n}))"
    half = f"({z} * sqrt((({k}) / {n}) * (1 - ({k}) / {n}) / {n} + {z * z} / (4 * {n} * {n})) / (1 + {z * z} / {n}))"
    bound = f"greatest({middle} - {half}, 0)" if side == "low" else f"least({middle} + {half}, 1)"
    return f"CASE WHEN {n} IS NOT NULL THEN round({bound}, 9) END"


_FOUR = ("present_present_n", "present_absent_n", "absent_present_n", "absent_absent_n")


def _kappa(pp: str, pa: str, ap: str, aa: str) -> str:
    n = f"nullif(CAST({pp} + {pa} + {ap} + {aa} AS DOUBLE), 0)"
    chance = f"((({pp} + {pa}) / {n}) * (({pp} + {ap}) / {n}) + (({ap} + {aa}) / {n}) * (({pa} + {aa}) / {n}))"
    return f"CASE WHEN abs(1 - {chance}) >= 1e-9 THEN (({pp} + {aa}) / {n} - {chance}) / (1 - {chance}) END"


def _ac1(pp: str, pa: str, ap: str, aa: str) -> str:
    n = f"nullif(CAST({pp} + {pa} + {ap} + {aa} AS DOUBLE), 0)"
    p = f"((({pp} + {pa}) / {n} + ({pp} + {ap}) / {n}) / 2)"
    return f"CASE WHEN {n} IS NOT NULL THEN (({pp} + {aa}) / {n} - 2 * {p} * (1 - {p})) / (1 - 2 * {p} * (1 - {p})) END"


def nine(table):
    """Doubles with nine places: what two engines' sums agree on."""
    return table.select(*[F.round(n, 9).alias(n) if kind == "double" else c(n) for n, kind in table.dtypes])


@query("a26_groups_and_total", "SELECT target_type, code, record_n FROM counts", COUNTS)
def a26(spark, sf):
    return _counts(spark, sf).select("target_type", "code", "record_n")


@query("a27_decision_counts", "SELECT * FROM counts", COUNTS)
def a27(spark, sf):
    return _counts(spark, sf)


def _agreement(names):
    return lambda spark, sf: nine(reliability.agreement(_counts(spark, sf)).select("target_type", "code", *names))


query("a28_wilson_interval", f"SELECT target_type, code, round(agreement_n / nullif(CAST(complete_pair_n AS DOUBLE), 0), 9) AS agreement, {_wilson('agreement_n', 'complete_pair_n', 'low')} AS agreement_low, {_wilson('agreement_n', 'complete_pair_n', 'high')} AS agreement_high FROM counts", COUNTS)(_agreement(["agreement", "agreement_low", "agreement_high"]))
query("a29_binary_kappa", f"SELECT target_type, code, {' + '.join(_FOUR)} AS binary_pair_n, round({_kappa(*_FOUR)}, 9) AS kappa FROM counts", COUNTS)(_agreement(["binary_pair_n", "kappa"]))
query("a31_gwet_ac1", f"SELECT target_type, code, round({_ac1(*_FOUR)}, 9) AS ac1 FROM counts", COUNTS)(_agreement(["ac1"]))

NOMINAL = N.CELLS_SQL + """, nominal AS (SELECT target, pair_n, CASE WHEN abs(1 - e) >= 1e-9 THEN (s - e) / (1 - e) END AS kappa FROM (
  SELECT target, pair_n, CAST(agree AS DOUBLE) / pair_n AS s, coalesce(xy, 0) / (CAST(pair_n AS DOUBLE) * pair_n) AS e FROM (SELECT target, CAST(sum(n) AS BIGINT) AS pair_n, coalesce(sum(n) FILTER (c1 = c2), 0) AS agree FROM cells GROUP BY target)
  LEFT JOIN (SELECT target, sum(CAST(x AS DOUBLE) * y) AS xy FROM (SELECT target, c1 AS k, sum(n) AS x FROM cells GROUP BY ALL) JOIN (SELECT target, c2 AS k, sum(n) AS y FROM cells GROUP BY ALL) USING (target, k) GROUP BY target) USING (target)))"""


@query("a30_nominal_kappa", "SELECT target, pair_n, round(kappa, 9) AS kappa FROM nominal", NOMINAL)
def a30(spark, sf):
    return nine(reliability.nominal_kappa(reliability.cells(M.records(spark, sf))))


@query("a32_percentile", "SELECT source, quantile_cont(CAST(n_chars AS DOUBLE), 0.025) AS low, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS middle, quantile_cont(CAST(n_chars AS DOUBLE), 0.975) AS high FROM documents GROUP BY source")
def a32(spark, sf):
    return quantiles.percentiles(M.table(spark, sf, "documents"), ["source"], "n_chars", {"low": 0.025, "middle": 0.5, "high": 0.975})


REPLICATES = reliability.REPLICATES
def _uniform(draw: str) -> str:
    u = f"(seed + rep * 1000003 + ({draw}) * 7919) % {D.MODULUS}"
    for factor, shift in D.STEPS:
        u = f"(({u}) * {factor} % {D.MODULUS})"
        u = f"xor({u}, {u} >> {shift})"
    return f"((({u}) + 0.5::DOUBLE) / {D.MODULUS + 1}.0::DOUBLE)"


def _stirling(k: str) -> str:
    table = "[" + ", ".join(f"{x!r}::DOUBLE" for x in D.STIRLING) + "]"
    above = f"(greatest({k}, 10) + 1.0::DOUBLE)"
    return f"CASE WHEN {k} < 10 THEN {table}[CAST({k} AS BIGINT) + 1] ELSE (1::DOUBLE / 12 - (1::DOUBLE / 360 - 1::DOUBLE / 1260 / ({above} * {above})) / ({above} * {above})) / {above} END"


def _resampled(x: str, categories: tuple[str, ...], label: str) -> str:
    """CTEs up to {x}_hits (target, pair_n, rep, d0, d1, ...): the counts of the categories' cells in each replicate, cell by cell."""
    cells = [(a, b) for a in categories for b in categories]
    inside = ", ".join(f"'{a}'" for a in categories)
    ns = [f"n{j}" for j in range(len(cells))]
    parts = [
        f"{x}_own AS MATERIALIZED (SELECT target, CAST('0x' || substr(md5('{label}|' || target), 1, 7) AS BIGINT) AS seed, CAST(sum(n) AS BIGINT) AS pair_n, "
        + ", ".join(f"CAST(coalesce(sum(n) FILTER (c1 = '{a}' AND c2 = '{b}'), 0) AS BIGINT) AS n{j}" for j, (a, b) in enumerate(cells))
        + f" FROM cells WHERE c1 IN ({inside}) AND c2 IN ({inside}) GROUP BY target)",
        f"{x}_s0 AS MATERIALIZED (SELECT *, pair_n AS spare FROM {x}_own CROSS JOIN range(1, {REPLICATES + 1}) r(rep))",
    ]
    for j in range(len(cells)):
        rest, base = " + ".join(ns[j:]), j * D.A_CELL
        parts.append(f"{x}_t{j} AS MATERIALIZED (SELECT target, rep, seed, spare AS n, p, least(p, 1 - p) AS r, {_uniform(str(base))} AS u0 FROM (SELECT target, rep, seed, spare, CAST(n{j} AS DOUBLE) / ({rest}) AS p FROM {x}_s{j} WHERE n{j} > 0 AND n{j} < {rest}))")
        parts.append(
            f"{x}_c{j} AS MATERIALIZED (SELECT target, n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(r) + (n - k) * ln(1 - r))) OVER (PARTITION BY target, n ORDER BY k) AS upto "
            f"FROM (SELECT DISTINCT target, n, r FROM {x}_t{j} WHERE n * r < {D.SMALL_MEAN}) CROSS JOIN range(0, {D.MOST}) q(k) WHERE k < n)"
        )
        parts.append(f"{x}_a{j} AS (SELECT t.target, t.rep, count(c.k) AS k FROM {x}_t{j} t LEFT JOIN {x}_c{j} c ON c.target = t.target AND c.n = t.n AND t.u0 > c.upto WHERE t.n * r < {D.SMALL_MEAN} GROUP BY ALL)")
        shape = f"""SELECT *, floor((2 * a / us + b) * u + n * r + 0.5::DOUBLE) AS k FROM (SELECT *, 0.5::DOUBLE - abs(u) AS us, -0.0873::DOUBLE + 0.0248::DOUBLE * b + 0.01::DOUBLE * r AS a, (2.83::DOUBLE + 5.1::DOUBLE / b) * root AS alpha, 0.92::DOUBLE - 4.2::DOUBLE / b AS sure FROM (
  SELECT *, r / (1 - r) AS odds, floor((n + 1) * r) AS m, 1.15::DOUBLE + 2.53::DOUBLE * root AS b, {_uniform(f'{base} + 1 + 2 * attempt')} - 0.5::DOUBLE AS u, {_uniform(f'{base} + 2 + 2 * attempt')} AS v FROM (SELECT *, sqrt(n * r * (1 - r)) AS root FROM {x}_t{j} WHERE n * r >= {D.SMALL_MEAN}) CROSS JOIN range(0, {D.ATTEMPTS}) q(attempt)))"""
        likely = f"(m + 0.5::DOUBLE) * ln((m + 1) / (odds * (n - m + 1))) + (n + 1) * ln((n - m + 1) / (n - k + 1)) + (k + 0.5::DOUBLE) * ln(odds * (n - k + 1) / (k + 1)) + {_stirling('m')} + {_stirling('(n - m)')} - {_stirling('k')} - {_stirling('(n - k)')}"
        fits = f"(us >= 0.07::DOUBLE AND v <= sure) OR ln(v * alpha / (a / (us * us) + b)) <= {likely}"
        parts.append(f"{x}_b{j} AS (SELECT target, rep, CAST(coalesce(arg_min(k, attempt) FILTER (fits), max(m)) AS BIGINT) AS k FROM (SELECT *, CASE WHEN k BETWEEN 0 AND n THEN {fits} ELSE false END AS fits FROM ({shape})) GROUP BY target, rep)")
        parts.append(
            f"{x}_s{j + 1} AS MATERIALIZED (SELECT * EXCLUDE (spare, k, p), CASE WHEN n{j} = 0 THEN 0 WHEN n{j} = {rest} THEN spare WHEN p > 0.5 THEN spare - k ELSE k END AS d{j}, spare - CASE WHEN n{j} = 0 THEN 0 WHEN n{j} = {rest} THEN spare WHEN p > 0.5 THEN spare - k ELSE k END AS spare "
            f"FROM (SELECT s.*, t.p, coalesce(a.k, b.k) AS k FROM {x}_s{j} s LEFT JOIN {x}_t{j} t USING (target, rep) LEFT JOIN {x}_a{j} a USING (target, rep) LEFT JOIN {x}_b{j} b USING (target, rep)))"
        )
    parts.append(f"{x}_hits AS MATERIALIZED (SELECT target, pair_n, rep, {', '.join(f'd{j}' for j in range(len(cells)))} FROM {x}_s{len(cells)})")
    return ", ".join(parts)


def _nominal_of(d: list[list[str]]) -> str:
    """Kappa of a table of counts."""
    n = f"CAST({' + '.join(x for row in d for x in row)} AS DOUBLE)"
    seen = f"(({' + '.join(row[i] for i, row in enumerate(d))}) / {n})"
    chance = " + ".join(f"(({' + '.join(row)}) / {n}) * (({' + '.join(r[i] for r in d)}) / {n})" for i, row in enumerate(d))
    return f"CASE WHEN abs(1 - ({chance})) >= 1e-9 THEN ({seen} - ({chance})) / (1 - ({chance})) END"


def _bounds(name: str, least: int, least_pairs: int, out: str) -> str:
    return ", ".join(f"CASE WHEN count({name}) >= {least} AND max(pair_n) >= {least_pairs} THEN quantile_cont({name}, {q}) END AS {out}_{w}" for w, q in (("low", 0.025), ("high", 0.975)))


_SQUARE = [[f"d{i * len(T.DECISIONS) + j}" for j in range(len(T.DECISIONS))] for i in range(len(T.DECISIONS))]
DRAWN = _resampled("bin", reliability.BINARY, "bootstrap") + f""", stats AS (SELECT target, pair_n, {_kappa('d0', 'd1', 'd2', 'd3')} AS kappa, {_ac1('d0', 'd1', 'd2', 'd3')} AS ac1 FROM bin_hits),
boot AS (SELECT target, {_bounds('kappa', reliability.LEAST_ESTIMATES, 2, 'kappa')}, {_bounds('ac1', reliability.LEAST_ESTIMATES, 2, 'ac1')} FROM stats GROUP BY target)"""
BOOT = N.CELLS_SQL + ", " + DRAWN
OWN_BOOT = _resampled("nom", T.DECISIONS, "bootstrap-nominal") + f""", own_boot AS (SELECT target, nominal_kappa_low, nominal_kappa_high, binary_kappa_low, binary_kappa_high, ac1_low, ac1_high FROM (SELECT DISTINCT target FROM cells)
  LEFT JOIN (SELECT target, {_bounds('kappa', 1, 1, 'nominal_kappa')} FROM (SELECT target, pair_n, {_nominal_of(_SQUARE)} AS kappa FROM nom_hits) GROUP BY target) USING (target)
  LEFT JOIN (SELECT target, {_bounds('kappa', reliability.LEAST_ESTIMATES, 2, 'binary_kappa')}, {_bounds('ac1', 1, 1, 'ac1')} FROM stats GROUP BY target) USING (target))"""


@query("a33_bootstrap_interval", "SELECT target, round(kappa_low, 9) AS kappa_low, round(kappa_high, 9) AS kappa_high, round(ac1_low, 9) AS ac1_low, round(ac1_high, 9) AS ac1_high FROM (SELECT DISTINCT target FROM cells) LEFT JOIN boot USING (target)", BOOT)
def a33(spark, sf):
    return nine(reliability.bootstrap(reliability.cells(M.records(spark, sf)), REPLICATES))


@query("a33_nominal_interval", "SELECT target, round(nominal_kappa_low, 9) AS nominal_kappa_low, round(nominal_kappa_high, 9) AS nominal_kappa_high, round(binary_kappa_low, 9) AS binary_kappa_low, round(binary_kappa_high, 9) AS binary_kappa_high, round(ac1_low, 9) AS ac1_low, round(ac1_high, 9) AS ac1_high FROM own_boot", BOOT + ", " + OWN_BOOT)
def a33_nominal(spark, sf):
    return nine(reliability.bootstrap_by_target(reliability.cells(M.records(spark, sf)), REPLICATES))


@query("a34_confusion", "SELECT target_type, code, tp, fp, tn, fn FROM counts", COUNTS)
def a34(spark, sf):
    return _counts(spark, sf).select("target_type", "code", "tp", "fp", "tn", "fn")


_METRICS = {"precision": ("tp", "tp + fp"), "npv": ("tn", "tn + fn"), "sensitivity": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"), "accuracy": ("tp + tn", "tp + fp + tn + fn")}
_share = lambda k, n: f"(({k}) / nullif(CAST({n} AS DOUBLE), 0))"
_PLAIN = [x for m, (k, n) in _METRICS.items() for x in (f"round({_share(k, n)}, 9) AS {m}", f"{_wilson(k, n, 'low')} AS {m}_low", f"{_wilson(k, n, 'high')} AS {m}_high")]
_PLAIN += [f"round({_share('2 * tp', '2 * tp + fp + fn')}, 9) AS f1", f"round(({_share('tp', 'tp + fn')} + {_share('tn', 'tn + fp')}) / 2, 9) AS balanced_accuracy"]


@query("a35_machine_metrics", f"SELECT target_type, code, {', '.join(_PLAIN)} FROM counts", COUNTS)
def a35(spark, sf):
    table = reliability.machine_metrics(_counts(spark, sf))
    return nine(table.select("target_type", "code", *[f"{m}{s}" for m in _METRICS for s in ("", "_low", "_high")], "f1", "balanced_accuracy"))


@query("a36_kish_effective_n", "SELECT target_type, code, round(sum(weight) * sum(weight) / sum(weight * weight), 9) AS effective_n FROM records GROUP BY ALL", M.SHEETS_SQL)
def a36(spark, sf):
    rows = M.records(spark, sf).groupBy("target_type", "code").agg(F.sum("weight").alias("w"), F.sum(F.pow("weight", F.lit(2.0))).alias("q"))
    return nine(rows.select("target_type", "code", S.kish(c("w"), c("q")).alias("effective_n")))


def _prefixed(e: str, p: str) -> str:
    return " + ".join(f"{p}_{x}" for x in e.split(" + "))


_WEIGHTED = []
for _m, (_k, _n) in _METRICS.items():
    _kw, _nw, _nq = _prefixed(_k, "w"), _prefixed(_n, "w"), _prefixed(_n, "q")
    _eff = f"(pow({_nw}, 2) / nullif({_nq}, 0))"
    _WEIGHTED += [f"round({_share(_kw, _nw)}, 9) AS weighted_{_m}", f"round({_eff}, 9) AS weighted_{_m}_effective_n", f"{_wilson(f'{_share(_kw, _nw)} * {_eff}', _eff, 'low')} AS weighted_{_m}_low", f"{_wilson(f'{_share(_kw, _nw)} * {_eff}', _eff, 'high')} AS weighted_{_m}_high"]


@query("a37_weighted_metrics", f"SELECT target_type, code, {', '.join(_WEIGHTED)} FROM counts", COUNTS)
def a37(spark, sf):
    table = reliability.weighted_metrics(_counts(spark, sf))
    return nine(table.select("target_type", "code", *[f"weighted_{m}{s}" for m in _METRICS for s in ("", "_effective_n", "_low", "_high")]))


#: Every decision of a complete pair is a row here; the pairs of unequal ones among all pairs of rows are what chance gives.
ALPHA = """, alpha AS (SELECT target, pair_n, CASE WHEN apart > 0 THEN 1 - (2.0::DOUBLE * pair_n - 1) * 2 * differ / apart END AS alpha
  FROM (SELECT target, count(*) AS pair_n, count(*) FILTER (decision_1 <> decision_2) AS differ FROM complete GROUP BY target)
  JOIN (SELECT target, sum(CASE WHEN a.c = b.c THEN 0 ELSE CAST(a.m AS DOUBLE) * b.m END) AS apart FROM told a JOIN told b USING (target) GROUP BY target) USING (target))"""
TOLD = """, complete AS (SELECT target_type || '/' || code AS target, decision_1, decision_2 FROM records WHERE decision_1 <> '' AND decision_2 <> ''),
told AS (SELECT target, c, count(*) AS m FROM (SELECT target, unnest([decision_1, decision_2]) AS c FROM complete) GROUP BY ALL)"""


@query("a38_krippendorff_alpha", "SELECT target, pair_n, round(alpha, 9) AS alpha FROM alpha", M.SHEETS_SQL + TOLD + ALPHA)
def a38_alpha(spark, sf):
    return nine(reliability.krippendorff_alpha(reliability.cells(M.records(spark, sf))))


_ADJ = [_count_if(f"decision_1 <> decision_2 AND decision_1 <> '' AND decision_2 <> '' AND final = '{d}'", f"adjudicated_{d}_n") for d in T.DECISIONS]
BY_TARGET = BOOT + ", " + OWN_BOOT + TOLD + ALPHA + ", " + NOMINAL.split(", ", 1)[1][NOMINAL.split(", ", 1)[1].index("nominal AS"):] + f""", base AS (SELECT target_type || '/' || code AS target, count(*) FILTER (decision_1 <> '' AND decision_2 <> '') AS pair_n, count(*) FILTER (decision_1 <> '' AND decision_1 = decision_2) AS agreement_n,
  {', '.join(_count_if(f"decision_1 = '{x}' AND decision_2 = '{y}'", x[0] + y[0]) for x in reliability.BINARY for y in reliability.BINARY)}, {', '.join(_ADJ)} FROM records GROUP BY ALL),
by_target AS (SELECT target, b.pair_n, agreement_n, b.pair_n - agreement_n AS disagreement_n, CASE b.pair_n WHEN 0 THEN 0 ELSE round_even(100.0::DOUBLE * agreement_n / b.pair_n, 3) END AS agreement_pct,
  round_even(100 * {_wilson('agreement_n', 'b.pair_n', 'low')}, 3) AS agreement_low_pct, round_even(100 * {_wilson('agreement_n', 'b.pair_n', 'high')}, 3) AS agreement_high_pct, round_even(n.kappa, 6) AS nominal_kappa, round_even(l.alpha, 6) AS krippendorff_alpha, pp + pa + ap + aa AS binary_pair_n, pp + aa AS binary_agreement_n, CASE pp + pa + ap + aa WHEN 0 THEN 0 ELSE round_even(100.0::DOUBLE * (pp + aa) / (pp + pa + ap + aa), 3) END AS binary_agreement_pct,
  round_even({_kappa('pp', 'pa', 'ap', 'aa')}, 6) AS binary_kappa, round_even({_ac1('pp', 'pa', 'ap', 'aa')}, 6) AS ac1, {', '.join(f'round_even({c}, 6) AS {c}' for c in reliability.BOUNDS)},
  {', '.join(f'adjudicated_{d}_n' for d in T.DECISIONS)} FROM base b LEFT JOIN nominal n USING (target) LEFT JOIN alpha l USING (target) LEFT JOIN own_boot USING (target))"""


def _by_target(spark, sf, replicates: int = 0):
    return reliability.reliability_by_target(M.records(spark, sf), replicates)


@query("a38_reliability_by_target", "SELECT * FROM by_target", BY_TARGET)
def a38(spark, sf):
    return _by_target(spark, sf, REPLICATES)


@query("a39_reliability_totals", f"SELECT count(*) AS target_n, CAST(sum(pair_n) AS BIGINT) AS pair_n, CAST(sum(disagreement_n) AS BIGINT) AS disagreement_n, CAST(sum({' + '.join(f'adjudicated_{d}_n' for d in T.DECISIONS)}) AS BIGINT) AS adjudicated_n FROM by_target", BY_TARGET)
def a39(spark, sf):
    return reliability.totals(_by_target(spark, sf))


# --- ranking ----------------------------------------------------------------------------------------------------

@query("w01_ordinal_rank", "SELECT population, code, k AS record_n, rank FROM ranks", M.PRESENCE_SQL + N.COUNTED)
def w01(spark, sf):
    p = M.over_populations(spark, sf).types
    grid = p.select("code").distinct().join(F.broadcast(p.select("population").distinct()))
    counts = p.groupBy("population", "code").agg(F.count("*").alias("record_n"))
    return coding.ranked(grid.join(counts, ["population", "code"], "left").fillna(0, ["record_n"]), "record_n", ["population"])


@query("w02_indicator_rank", f"SELECT *, row_number() OVER (ORDER BY note_count DESC, code) AS rank FROM ({N.ROLLUP_SQL})", M.INDICATED_SQL)
def w02(spark, sf):
    return coding.ranked(coding.rollup(coding.summary_by_source(M.coded(spark, sf, "indicator"))))


@query("w03_top_codes_by_source", f"""SELECT source, max(code) FILTER (r = 1) AS dominant_code, string_agg(code || ' (' || note_count || ' notes)', '; ' ORDER BY r) AS top_codes
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY note_count DESC, code) AS r FROM ({N.BY_SOURCE.format('coding')}) WHERE code <> 'T9_quality') WHERE r <= 5 GROUP BY source""", M.CODED_SQL)
def w03(spark, sf):
    return coding.top_codes(coding.summary_by_source(M.coded(spark, sf)), 5, M.QUALITY)


@query("w04_top_prices", "SELECT currency, amount, count(*) AS mention_count FROM mentions GROUP BY ALL ORDER BY mention_count DESC, currency, amount LIMIT 50", M.PRICES_SQL)
def w04(spark, sf):
    return populations.top_prices(extract.price_mentions(M.priced(spark, sf)), 50)


@query("w05_top_source_rows", f"SELECT * FROM ({N.BY_SOURCE.format('indicating')}) ORDER BY note_count DESC, source, code LIMIT 20", M.INDICATED_SQL)
def w05(spark, sf):
    return coding.summary_by_source(M.coded(spark, sf, "indicator")).orderBy(F.desc("note_count"), "source", "code").limit(20)


@query("w06_distinct_snippets", "SELECT code, note_id, place FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY note_id) AS place FROM (SELECT source AS code, lower(left(text, 120)) AS k, min(note_id) AS note_id FROM notes WHERE lang <> 'en' GROUP BY ALL)) WHERE place <= 4", M.NOTES_SQL.replace("text, len(", "lang, text, len(").replace("AS raw_path, text", "AS raw_path, lang, text"))
def w06(spark, sf):
    langs = M.table(spark, sf, "documents").select("doc_id", "lang")
    rows = M.notes(spark, sf).join(langs, "doc_id").select(c("source").alias("code"), "note_id", F.lit(1).alias("snippet_index"), F.when(c("lang") == "en", " ").otherwise(c("text")).alias("snippet"))
    return coding.distinct_snippets(rows, 4).select("code", "note_id", "place")


@query("w07_ordered_output", "SELECT source, note_id, word_count FROM notes ORDER BY source, note_id", M.NOTES_SQL)
def w07(spark, sf):
    return resolve.in_order(M.notes(spark, sf).select("source", "note_id", "word_count"), ["source", "note_id"])


@query("w06_evidence_texts", f"""SELECT code, note_id, CAST(snippet_index AS INTEGER) AS snippet_index, sha256(snippet) AS snippet, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY note_id, snippet_index) AS place FROM (
  SELECT * FROM (SELECT note_id, code, r AS snippet_index, {N._SNIPPET} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY note_id, code ORDER BY pattern, start) AS r FROM ({N._PLACES})) JOIN lowered USING (note_id) WHERE r <= 3)
  WHERE snippet <> '' QUALIFY row_number() OVER (PARTITION BY code, lower(left(snippet, 120)) ORDER BY note_id, snippet_index) = 1)) WHERE place <= 4""", M.CODED_SQL)
def w06_evidence(spark, sf):
    """The first snippets of each code that say something else, from the evidence of all notes."""
    rows = coding.distinct_snippets(coding.evidence(M.corpus(spark, sf), M.codes(spark, "typology")), 4)
    return rows.select("code", "note_id", "snippet_index", F.sha2("snippet", 256).alias("snippet"), "place")


# --- sets -------------------------------------------------------------------------------------------------------

@query("u01_both_codes", "SELECT note_id FROM coding WHERE code = 'T5_near' AND present = 1 INTERSECT SELECT note_id FROM indicating WHERE code = 'I3_common' AND present = 1", M.INDICATED_SQL)
def u01(spark, sf):
    return populations.with_codes(M.carried(spark, sf), {"typology": "T5_near", "indicator": "I3_common"}).select("note_id").distinct()


@query("u02_any_code", "SELECT DISTINCT note_id FROM coding WHERE code IN ('T2_mail', 'T3_host', 'T4_secret') AND present = 1", M.CODED_SQL)
def u02(spark, sf):
    return M.coded(spark, sf).where("code IN ('T2_mail', 'T3_host', 'T4_secret') AND present = 1").select("note_id").distinct()


@query("u03_stacked_populations", "SELECT population, source, count(*) AS record_n FROM members GROUP BY ALL", M.PRESENCE_SQL)
def u03(spark, sf):
    own = M.over_populations(spark, sf).members
    full = own.where(c("population") == populations.FULL)
    return full.unionByName(own.where(c("population") == populations.UNIQUE)).groupBy("population", "source").agg(F.count("*").alias("record_n"))


@query("u04_set_equality", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing_n, (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))) AS extra_n")
def u04(spark, sf):
    return populations.set_difference(M.table(spark, sf, "documents"), M.table(spark, sf, "labels"), "doc_id")


# --- gates ------------------------------------------------------------------------------------------------------

@query("g01_unique_key", "SELECT 'notes' AS label, source AS key_value, count(*) AS n, 'duplicate' AS violation FROM documents GROUP BY source HAVING count(*) > 1")
def g01(spark, sf):
    return gates.unique_key(M.table(spark, sf, "documents"), "source", "notes")


@query("g02_unique_record_id", "SELECT 'coder_1' AS label, '' AS key_value, count(*) AS n, 'blank' AS violation FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id % 9 = 0 HAVING count(*) > 0")
def g02(spark, sf):
    sheet = M.sheets(spark, sf)["coder_1"].withColumn("record_id", F.when(F.substring("record_id", 2, 20).cast("long") % 9 == 0, "  ").otherwise(c("record_id")))
    return gates.unique_key(sheet, "record_id", "coder_1")


@query("g03_same_records", "SELECT 'coder_2' AS label, 'r' || doc_id AS record_id, 'missing' AS violation FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id % 13 = 5")
def g03(spark, sf):
    s = M.sheets(spark, sf)
    return gates.same_keys(s["machine"], s["coder_2"].where(F.substring("record_id", 2, 20).cast("long") % 13 != 5), "record_id", "coder_2")


@query("g04_identity_columns", "SELECT record_id, 'code' AS \"column\", 'C9' AS found, code AS expected FROM records WHERE doc_id % 17 = 2", M.SHEETS_SQL)
def g04(spark, sf):
    machine = M.sheets(spark, sf)["machine"]
    k = F.substring("record_id", 2, 20).cast("long") % 17
    sheet = machine.select("record_id", F.when(k == 2, " C9").when(k == 3, "").otherwise(c("code")).alias("code"), "target_type")
    return gates.same_identity(sheet, machine, "record_id", ["code", "target_type"])


@query("g05_repeated_decisions", "SELECT record_id, decision_1 AS coder_1_decision, CASE decision_1 WHEN 'present' THEN 'absent' ELSE 'present' END AS said_1, decision_2 AS coder_2_decision, decision_2 AS said_2 FROM records WHERE doc_id % 19 = 4", M.SHEETS_SQL)
def g05(spark, sf):
    """Every nineteenth decision is another one, others stand in other letters or are blank."""
    s = M.sheets(spark, sf)
    k = F.substring("record_id", 2, 20).cast("long") % 19
    other = F.when(F.lower("decision") == "present", "Absent").otherwise(" present")
    c1 = s["coder_1"].withColumn("decision", F.when(k == 4, other).when(k == 5, "").when(k == 6, F.upper("decision")).otherwise(c("decision")))
    return gates.repeated_decisions(s["adjudication"], c1, s["coder_2"])


@query("g06_same_within_text", "SELECT combined_text_sha256, code, count(*) AS note_n FROM (SELECT combined_text_sha256, code, CAST(present = 1 AND source <> 'src1' AS INTEGER) AS p FROM coding JOIN corpus USING (note_id, source)) GROUP BY ALL HAVING min(p) <> max(p)", M.CODED_SQL)
def g06(spark, sf):
    own = F.when(c("source") != "src1", c("typology")).otherwise(F.filter("typology", lambda x: F.lit(False)))
    return gates.same_carried_within_text(M.carried(spark, sf).withColumn("typology", own), "typology")


@query("g07_reliability_rules", "SELECT target, 'adjudicated_are_disagreements' AS rule FROM by_target WHERE adjudicated_present_n + adjudicated_absent_n + adjudicated_ambiguous_n + adjudicated_insufficient_text_n + adjudicated_not_applicable_n <> disagreement_n", BY_TARGET)
def g07(spark, sf):
    return gates.broken_rules(_by_target(spark, sf), ["target"], gates.reliability_rules())


_SPOILED = """spoiled AS (SELECT * REPLACE (CASE WHEN target LIKE '%C1' THEN nominal_kappa + 3 ELSE nominal_kappa END AS nominal_kappa, CASE WHEN target LIKE '%C2' THEN agreement_pct + 1 ELSE agreement_low_pct END AS agreement_low_pct,
  CASE WHEN target LIKE '%C3' THEN pair_n ELSE agreement_n END AS agreement_n) FROM by_target)"""


def _spoiled(spark, sf):
    """The table by target with a coefficient, an interval and a count that cannot be."""
    of = lambda k: c("target").endswith(f"C{k}")
    return _by_target(spark, sf).withColumns({
        "nominal_kappa": F.when(of(1), c("nominal_kappa") + 3).otherwise(c("nominal_kappa")),
        "agreement_low_pct": F.when(of(2), c("agreement_pct") + 1).otherwise(c("agreement_low_pct")),
        "agreement_n": F.when(of(3), c("pair_n")).otherwise(c("agreement_n")),
    })


@query("g07_spoiled_table", """SELECT target, unnest(CASE WHEN target LIKE '%C1' THEN ['coefficients_lie_within_one'] WHEN target LIKE '%C2' THEN ['agreement_lies_in_its_interval'] WHEN target LIKE '%C3' AND disagreement_n > 0 THEN ['pairs_are_agreements_and_disagreements', 'agreement_is_its_share'] ELSE [] END
  || CASE WHEN adjudicated_present_n + adjudicated_absent_n + adjudicated_ambiguous_n + adjudicated_insufficient_text_n + adjudicated_not_applicable_n <> disagreement_n THEN ['adjudicated_are_disagreements'] ELSE [] END) AS rule FROM spoiled""", BY_TARGET + ", " + _SPOILED)
def g07_spoiled(spark, sf):
    return gates.broken_rules(_spoiled(spark, sf), ["target"], gates.reliability_rules())


@query("g07_counts_against_cells", """SELECT target, 'agreement_n' AS "column", CAST(sum(n) AS BIGINT) AS found, CAST(coalesce(sum(n) FILTER (c1 = c2), 0) AS BIGINT) AS expected FROM cells WHERE target LIKE '%C3' GROUP BY target HAVING count(*) FILTER (c1 <> c2) > 0""", N.CELLS_SQL)
def g07_cells(spark, sf):
    return gates.counts_against_cells(_spoiled(spark, sf), reliability.cells(M.records(spark, sf)))


@query("g08_rate_rules", """SELECT population, source, code, unnest(CASE WHEN k > 0 THEN ['part_is_in_whole'] ELSE [] END || CASE WHEN n = 0 THEN [] WHEN code < 'T4' THEN ['rate_is_a_percentage'] ELSE [] END) AS rule FROM (
  SELECT z.population, s.source, l.code, (SELECT count(*) FROM members m WHERE m.population = z.population AND m.source = s.source) AS n, (SELECT count(*) FROM presence p WHERE p.population = z.population AND p.source = s.source AND p.code = l.code) AS k
  FROM sizes z CROSS JOIN sources s CROSS JOIN labels_of l)""", M.PRESENCE_SQL)
def g08_rates(spark, sf):
    """Rates of some codes above a hundred, and more notes that carry a code than there are wherever there are any."""
    over = M.over_populations(spark, sf)
    table = derived.source_normalized(over.types, over.members, over.notes)
    high = (c("code") < "T4") & (c("source_record_n") > 0)
    spoiled = table.withColumns({"rate_pct": c("rate_pct") + F.when(high, 101.0).otherwise(0.0), "positive_records_n": F.when(c("positive_records_n") > 0, c("source_record_n") + 1).otherwise(c("positive_records_n"))})
    return gates.broken_rules(spoiled, ["population", "source", "code"], gates.rate_rules("rate_pct", "positive_records_n", "source_record_n"))


@query("g08_pair_rules", "SELECT population, code_a, code_b, 'cells_sum_to_denominator' AS rule FROM joint WHERE n11_both_present > 0", M.PRESENCE_SQL + N.FLAGS + N.WHOLE)
def g08(spark, sf):
    over = M.over_populations(spark, sf)
    table = derived.cooccurrence(over.types, over.members)
    spoiled = table.withColumn("denominator_n", c("denominator_n") + (c("n11_both_present") > 0).cast("int"))
    return gates.broken_rules(spoiled, ["population", "code_a", "code_b"], gates.pair_rules())


@query("g09_totals_agree", "SELECT 'record_n' AS \"column\", CAST(count(*) AS DOUBLE) AS detail, CAST(count(*) + 1 AS DOUBLE) AS overall FROM records", M.SHEETS_SQL)
def g09(spark, sf):
    table = _counts(spark, sf)
    overall = table.where("code = '(all)'").withColumn("record_n", c("record_n") + 1)
    return gates.totals_agree(table.where("code <> '(all)'"), overall, ["record_n", "tp", "fp"])


@query("g09_row_counts", "SELECT 'documents' AS \"table\", count(*) AS found, count(*) + 1 AS expected FROM documents UNION ALL SELECT 'pages', count(*), NULL FROM pages UNION ALL SELECT 'gone', NULL, count(*) FROM benchmark")
def g09_rows(spark, sf):
    """Metadata that is right for one table, off by one for another, lacks a third, and knows one that is not there."""
    n = lambda name, told, more=0: M.table(spark, sf, name).agg((F.count("*") + more).alias("expected")).select(F.lit(told).alias("table"), "expected")
    expected = n("documents", "documents", 1).unionByName(n("labels", "labels")).unionByName(n("benchmark", "gone"))
    return gates.row_counts_agree({name: M.table(spark, sf, name) for name in ("documents", "labels", "pages")}, expected)


@query("g11_blocked_fields", "SELECT source, count(*) AS tables, 'note_id,s.combined_text,ranked_snippets' AS blocked FROM documents GROUP BY source")
def g11(spark, sf):
    """The gate looks at names alone: those of a table made of notes."""
    rows = M.table(spark, sf, "documents")
    table = rows.select(c("doc_id").alias("note_id"), F.struct(c("text").alias("combined_text"), c("lang").alias("k")).alias("s"), c("n_chars").alias("ranked_snippets"), c("n_chars").alias("unique_text_count"), c("n_chars").alias("evidence_packet_count"))
    return rows.groupBy("source").agg(F.count("*").alias("tables")).withColumn("blocked", F.lit(",".join(gates.blocked_fields(table.schema))))


@query("g12_local_paths", "SELECT 'cell' AS \"column\", cell FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'at C:' || chr(92) || left(text, 40) WHEN 1 THEN left(text, 40) || ' `/home/u/' || doc_id || '`' WHEN 2 THEN 'file://' || doc_id END AS cell FROM documents) WHERE cell IS NOT NULL")
def g12(spark, sf):
    """Texts with a path after them, in front of them, or none."""
    k, head = c("doc_id") % 5, F.left("text", F.lit(40))
    cell = F.when(k == 0, F.concat(F.lit("at C:\\"), head)).when(k == 1, F.concat(head, F.lit(" `/home/u/"), "doc_id", F.lit("`"))).when(k == 2, F.concat(F.lit("file://"), "doc_id")).when(k == 3, F.concat(F.lit("see https://a.b/home/u/"), "doc_id")).otherwise(head)
    return gates.local_paths(M.table(spark, sf, "documents").select("doc_id", "lang", cell.alias("cell")))


@query("g12_nested_values", """SELECT place, kind, shown FROM (SELECT *, left(text, 30) AS head FROM documents), LATERAL (SELECT unnest([
    {'place': 'deep.inner[0].cell', 'kind': 'cell', 'shown': CASE WHEN doc_id % 3 = 0 THEN 'in /tmp/' || doc_id END}, {'place': 'deep.inner[1].cell', 'kind': 'cell', 'shown': CASE WHEN doc_id % 5 = 0 THEN 'file://' || doc_id END},
    {'place': 'named.note_id', 'kind': 'key', 'shown': CASE WHEN doc_id % 7 = 0 THEN 'note_id' END}, {'place': 'named.k', 'kind': 'cell', 'shown': CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN '(/home/' || doc_id END},
    {'place': 'named.note_id', 'kind': 'cell', 'shown': CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN '(/home/' || doc_id END},
    {'place': 'loose.list[1].path', 'kind': 'key', 'shown': CASE WHEN doc_id % 11 = 0 THEN 'path' END}, {'place': 'loose.list[1].path', 'kind': 'cell', 'shown': CASE WHEN doc_id % 11 = 0 AND doc_id % 2 = 0 THEN '=/var/' || doc_id END},
    {'place': 'loose.list[1].plain', 'kind': 'cell', 'shown': CASE WHEN doc_id % 11 <> 0 AND doc_id % 2 = 0 THEN '=/var/' || doc_id END}]) AS x) t(x), LATERAL (SELECT x.place, x.kind, x.shown) y(place, kind, shown) WHERE shown IS NOT NULL""")
def g12_nested(spark, sf):
    """Paths in structs in lists, behind keys of maps, and in objects of a variant; blocked keys of both."""
    i, k, said = c("doc_id").cast("string"), c("doc_id"), F.lit("nothing to see")
    told = lambda when, what: F.when(when, F.concat(F.lit(what), i)).otherwise(said)
    deep = F.struct(F.array(F.struct(told(k % 3 == 0, "in /tmp/").alias("cell"), k.alias("n")), F.struct(told(k % 5 == 0, "file://").alias("cell"), k.alias("n"))).alias("inner"))
    named = F.create_map(F.when(k % 7 == 0, "note_id").otherwise("k"), told(k % 2 == 0, "(/home/"))
    loose = F.parse_json(F.concat(F.lit('{"list": [1, {"'), F.when(k % 11 == 0, "path").otherwise("plain"), F.lit('": "'), told(k % 2 == 0, "=/var/"), F.lit('"}]}')))
    return gates.exposed(M.table(spark, sf, "documents").select("doc_id", deep.alias("deep"), named.alias("named"), loose.alias("loose")))


@query("s08_run_metrics", """SELECT 'notes_rows' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'references_rows', count(*) FROM joined_refs UNION ALL SELECT 'references_distinct_path', count(DISTINCT path) FROM joined_refs UNION ALL SELECT 'references_distinct_sha256', count(DISTINCT sha256) FROM joined_refs
  UNION ALL SELECT 'references_ocr_status_' || ocr_status, count(*) FROM joined_refs GROUP BY ocr_status UNION ALL SELECT 'coding_rows', count(*) FROM coding UNION ALL SELECT 'coding_rule_match_intensity_' || rule_match_intensity, count(*) FROM coding GROUP BY rule_match_intensity""", M.CODED_SQL)
def s08(spark, sf):
    tables = {"notes": M.notes(spark, sf), "references": M.joined_refs(spark, sf), "coding": M.coded(spark, sf)}
    return files.run_metrics(tables, {"references": "ocr_status", "coding": "rule_match_intensity"}, {"references": ["path", "sha256"]})
