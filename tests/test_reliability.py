"""Resampled intervals and Krippendorff's alpha against plain Python and published values."""

import random
import time

import numpy as np
import pytest

from lectern.functions import draws
from lectern.functions import text as T
from lectern.operators import reliability as R

RECORDS = "target_type string, code string, decision_1 string, decision_2 string, final string"


def records(spark, pairs, code="c"):
    return spark.createDataFrame([("t", code, a, b, a if a == b else "present") for a, b in pairs], RECORDS)


def kappa(pairs):
    n = len(pairs)
    seen = sum(a == b for a, b in pairs) / n
    chance = sum(sum(a == c for a, _ in pairs) * sum(b == c for _, b in pairs) for c in T.DECISIONS) / n**2
    return None if abs(1 - chance) < 1e-9 else (seen - chance) / (1 - chance)


def test_alpha_of_a_published_example_and_with_a_blank_coder(spark):
    # Krippendorff, "Computing Krippendorff's Alpha-Reliability", nominal data of two observers: 0.692
    names = dict(zip("abcde", T.DECISIONS))
    pairs = [(names[a], names[b]) for a, b in zip("aabbdcccedda", "babbbcccedd" + "d")]
    for more in ([], [("present", ""), ("", "absent"), ("", "")]):
        row = R.krippendorff_alpha(R.cells(records(spark, pairs + more))).collect()[0]
        assert row.pair_n == 12 and round(row.alpha, 3) == 0.692


@pytest.mark.parametrize(("pairs", "alpha"), [([("present", "present")] * 4, None), ([("present", "absent")], 0.0), ([("present", "present"), ("absent", "absent")], 1.0)])
def test_alpha_of_few_pairs(spark, pairs, alpha):
    # one unit, two values that differ: 1 - (2 - 1) * 2 / 2 = 0
    assert R.krippendorff_alpha(R.cells(records(spark, pairs))).collect()[0].alpha == alpha


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (7, 0.9), (40, 0.2), (40, 0.5), (500, 0.03), (500, 0.7), (10**6, 0.4)])
def test_counts_are_binomial(n, p):
    reps = np.arange(1, 40_001)
    found = draws.binomial(np.full(len(reps), n), p, lambda i: draws.uniforms(991, reps, i))
    expected = np.random.default_rng(3).binomial(n, p, len(reps))
    assert found.min() >= 0 and found.max() <= n
    assert abs(found.mean() - n * p) < 5 * (n * p * (1 - p) / len(reps)) ** 0.5
    assert abs(found.std() / expected.std() - 1) < 0.03
    for q in (0.025, 0.3, 0.7, 0.975):
        assert abs(np.quantile(found, q) - np.quantile(expected, q)) <= max(1, 0.06 * expected.std())


def test_resampled_cells_hold_as_many_pairs_and_empty_ones_stay_empty():
    found = draws.resampled([30, 0, 12, 0, 58], 5, np.arange(1, 2_001))
    assert (found.sum(1) == 100).all() and not found[:, [1, 3]].any()
    assert np.allclose(found.mean(0), [30, 0, 12, 0, 58], atol=0.6)
    # cells are drawn together: the covariance of two of them is -n p q
    assert abs(np.cov(found[:, 0], found[:, 4])[0, 1] + 100 * 0.3 * 0.58) < 2.5


def test_intervals_are_those_of_resampled_pairs(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(150):
        a = rng.choices(T.DECISIONS, (50, 30, 10, 5, 5))[0]
        pairs.append((a, a if rng.random() < 0.75 else rng.choice(T.DECISIONS)))
    row = R.bootstrap_by_target(R.cells(records(spark, pairs)), 2_000).collect()[0]
    plain = sorted(k for k in (kappa(rng.choices(pairs, k=len(pairs))) for _ in range(2_000)) if k is not None)
    assert abs(row.nominal_kappa_low - np.quantile(plain, 0.025)) < 0.02 and abs(row.nominal_kappa_high - np.quantile(plain, 0.975)) < 0.02
    assert row.nominal_kappa_low < kappa(pairs) < row.nominal_kappa_high


def test_rules_of_the_two_tables(spark):
    one = R.cells(records(spark, [("present", "absent")]))  # one pair: kappa is 0 in every replicate
    own, overall = R.bootstrap_by_target(one, 50).collect()[0], R.bootstrap(one, 500).collect()[0]
    assert own.nominal_kappa_low == own.nominal_kappa_high == 0.0 and own.ac1_low is not None and own.binary_kappa_low is None
    assert overall.kappa_low is None and overall.ac1_low is None
    same = R.cells(records(spark, [("present", "present")] * 9))  # chance is certain: kappa is never defined, AC1 is 1
    own = R.bootstrap_by_target(same, 200).collect()[0]
    assert own.nominal_kappa_low is None and own.ac1_low == own.ac1_high == 1.0
    other = R.cells(records(spark, [("ambiguous", "not_applicable")] * 3))
    own = R.bootstrap_by_target(other, 200).collect()[0]
    assert own.ac1_low is None and own.nominal_kappa_low == 0.0
    assert R.bootstrap_by_target(R.cells(records(spark, [])), 200).count() == 0


def test_a_million_pairs_take_the_time_of_a_hundred():
    def took(n):
        start = time.process_time()
        draws.resampled([n // 2, n // 4, n // 8, n // 16, n // 16] * 5, 3, np.arange(1, 4_001))
        return time.process_time() - start

    took(100)
    assert took(1_000_000) < 3 * took(100) + 0.2


def test_table_by_target_has_the_interval_and_alpha(spark):
    rows = records(spark, [("present", "present")] * 30 + [("absent", "absent")] * 20 + [("present", "absent")] * 4 + [("ambiguous", "present")] * 2)
    r = R.reliability_by_target(rows, 200).collect()[0]
    assert r.nominal_kappa_low < r.nominal_kappa < r.nominal_kappa_high and 0 < r.krippendorff_alpha < 1
    assert (r.binary_pair_n, r.binary_agreement_n, r.binary_agreement_pct) == (54, 50, 92.593)
    assert R.reliability_by_target(rows, 0).collect()[0].nominal_kappa_low is None
