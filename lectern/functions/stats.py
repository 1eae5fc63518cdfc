"""Ratios, intervals and agreement as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054


def ratio(n: Column, d: Column, places: int = 6) -> Column:
    """n / d rounded half even, 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.bround(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), places))


def percent(n: Column, d: Column) -> Column:
    """100 n / d with three places, 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * n / F.nullif(d.cast("double"), F.lit(0.0)), 3))


def share(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Low and high of Wilson's interval, within 0 and 1; null where n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low, high = F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))
    return F.when(n.isNotNull(), low), F.when(n.isNotNull(), high)


def kappa_binary(pp: Column, pa: Column, ap: Column, aa: Column) -> Column:
    """Cohen's kappa of a 2 x 2 table; null without pairs or where agreement by chance is certain."""
    n = F.nullif((pp + pa + ap + aa).cast("double"), F.lit(0.0))
    seen = (pp + aa) / n
    chance = ((pp + pa) / n) * ((pp + ap) / n) + ((ap + aa) / n) * ((pa + aa) / n)
    return F.when(F.abs(1 - chance) >= 1e-9, (seen - chance) / (1 - chance))


def ac1_binary(pp: Column, pa: Column, ap: Column, aa: Column) -> Column:
    """Gwet's AC1 of a 2 x 2 table; null without pairs."""
    n = F.nullif((pp + pa + ap + aa).cast("double"), F.lit(0.0))
    seen = (pp + aa) / n
    p = ((pp + pa) / n + (pp + ap) / n) / 2
    chance = 2 * p * (1 - p)
    return F.when(F.abs(1 - chance) >= 1e-9, (seen - chance) / (1 - chance))


def lift(n11: Column, na: Column, nb: Column, n: Column) -> Column:
    """Observed over expected joint count, 0 where none is expected."""
    expected = na.cast("double") * nb / F.nullif(n.cast("double"), F.lit(0.0))
    return F.when(F.coalesce(expected, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.bround(n11 / expected, 6))


def kish(total: Column, squares: Column) -> Column:
    """Effective number of weighted records."""
    return F.pow(total, 2) / F.nullif(squares, F.lit(0.0))
