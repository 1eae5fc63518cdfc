"""Random draws by arithmetic on (seed, replicate, draw): the same on every cluster, and in SQL.

Counts of resampled pairs are drawn cell by cell: the first cell's count is
binomial over all pairs, the next one's over those that are left, and so on, so
a replicate costs the same whatever the number of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Multipliers and shifts of the draws, and their modulus: all products fit 64 bits.
MODULUS, STEPS = 2_147_483_647, ((48_271, 15), (69_621, 13), (16_807, 16))
#: Draws that a cell of a replicate may use.
A_CELL = 64
#: Below this mean a count is found by adding up probabilities, up to MOST of them (beyond, less than 2 ** -60 is left); above it by rejection.
SMALL_MEAN, MOST = 10, 60
#: Points that rejection tries; each is taken with a chance of 0.7 at least, and the likeliest count stands for none.
ATTEMPTS = 24
#: What Stirling's formula for ln k! lacks, for k below 10.
STIRLING = [math.lgamma(k + 1) - ((k + 0.5) * math.log(k + 1) - (k + 1) + 0.5 * math.log(2 * math.pi)) for k in range(10)]


def uniforms(seed: int, replicates: np.ndarray, draw: int) -> np.ndarray:
    """A number between 0 and 1, both excluded, for each replicate."""
    u = (seed + replicates.astype(np.int64) * 1_000_003 + draw * 7_919) % MODULUS
    for factor, shift in STEPS:
        u = u * factor % MODULUS
        u ^= u >> shift
    return (u + 0.5) / (MODULUS + 1.0)


def stirling(k: np.ndarray) -> np.ndarray:
    above = np.maximum(k, 10) + 1.0
    series = (1 / 12 - (1 / 360 - 1 / 1260 / (above * above)) / (above * above)) / above
    return np.where(k < 10, np.array(STIRLING)[np.clip(k, 0, 9)], series)


def binomial(n: np.ndarray, p: float, uniform: Callable[[int], np.ndarray]) -> np.ndarray:
    """A count of ``n`` trials with chance ``p`` for each replicate; ``uniform`` gives the numbers of a draw."""
    if p <= 0 or p >= 1:
        return n.copy() if p >= 1 else np.zeros_like(n)
    r = min(p, 1 - p)
    small = n * r < SMALL_MEAN
    out = np.where(small, _by_adding(n, r, uniform(0), small), _by_rejection(n, r, uniform, ~small))
    return n - out if p > 0.5 else out


def _by_adding(n: np.ndarray, r: float, u: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    k = np.zeros_like(n)
    chance = np.exp(n * math.log(1 - r))
    upto = chance.copy()
    for step in range(MOST):
        on = wanted & (u > upto) & (k == step) & (step < n)
        if not on.any():
            break
        k[on] += 1
        chance = chance * (n - step) / (step + 1) * (r / (1 - r))
        upto = upto + chance
    return k


def _by_rejection(n: np.ndarray, r: float, uniform: Callable[[int], np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Transformed rejection with squeeze (Hoermann's BTRS)."""
    odds, root = r / (1 - r), np.sqrt(n * r * (1 - r))
    b = 1.15 + 2.53 * root
    a = -0.0873 + 0.0248 * b + 0.01 * r
    alpha, sure = (2.83 + 5.1 / b) * root, 0.92 - 4.2 / b
    m = np.floor((n + 1) * r).astype(np.int64)
    out, left = m.copy(), wanted.copy()
    for attempt in range(ATTEMPTS):
        if not left.any():
            break
        u, v = uniform(1 + 2 * attempt) - 0.5, uniform(2 + 2 * attempt)
        us = 0.5 - np.abs(u)
        k = np.floor((2 * a / us + b) * u + n * r + 0.5).astype(np.int64)
        within = (k >= 0) & (k <= n)
        held = np.where(within, k, m)
        likely = (m + 0.5) * np.log((m + 1) / (odds * (n - m + 1))) + (n + 1) * np.log((n - m + 1) / (n - held + 1)) + (held + 0.5) * np.log(odds * (n - held + 1) / (held + 1))
        likely = likely + stirling(m) + stirling(n - m) - stirling(held) - stirling(n - held)
        fits = ((us >= 0.07) & (v <= sure)) | (within & (np.log(v * alpha / (a / (us * us) + b)) <= likely))
        now = left & fits & within
        out[now] = k[now]
        left &= ~now
    return out


def resampled(counts: list[int], seed: int, replicates: np.ndarray) -> np.ndarray:
    """Counts of each cell, one row a replicate, of as many pairs drawn with replacement as the cells hold."""
    rest = int(sum(counts))
    left = np.full(len(replicates), rest, np.int64)
    out = np.zeros((len(replicates), len(counts)), np.int64)
    for cell, own in enumerate(counts):
        if rest > 0:
            out[:, cell] = binomial(left, own / rest, lambda i: uniforms(seed, replicates, cell * A_CELL + i))  # noqa: B023
            left -= out[:, cell]
            rest -= own
    return out
