"""Exact percentiles of groups of any size, by selection.

No task ever holds a group, nor its distinct values: numbers are told as
integers of the same order, and the places that a percentile falls on are
narrowed digit by digit.  A round counts, for each group and each range still
in question, the next digit of the values that lie in the range; counts are
summed in each task before they move, and of a range there are at most
2 ** DIGIT of them.  After 64 / DIGIT rounds a range is one value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, ship

#: Bits that a round tells apart.
DIGIT = 16
#: Ranges in question up to which they are sent to every task; more are joined by group.
MOST_RANGES = 200_000
_NAN = float("nan")


def in_order(value: Column) -> Column:
    """A long for each double, in the same order: -0.0 is 0.0, and nan is the largest, as Spark has it."""

    @F.arrow_udf("bigint")
    def told(values: pa.Array) -> pa.Array:
        plain = np.array(pc.fill_null(values.cast(pa.float64()), 0.0), dtype=np.float64) + 0.0
        plain[np.isnan(plain)] = _NAN
        bits = plain.view(np.int64)
        return pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF)), pa.int64(), mask=np.array(values.is_null()))

    return told(value)


def of_order(key: Column) -> Column:
    """The double that ``in_order`` gives the long."""

    @F.arrow_udf("double")
    def told(keys: pa.Array) -> pa.Array:
        bits = np.array(pc.fill_null(keys, 0), dtype=np.int64)
        bits = bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))
        return pa.array(bits.view(np.float64), pa.float64(), mask=np.array(keys.is_null()))

    return told(key)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and a column for each of ``shares``: the value at (n - 1) * share of the group's values in order, linear in between.

    Nulls are no values; a group without any has nulls; a null group is a group
    of its own; an empty table gives none.  The same values as F.percentile.
    """
    if not shares or any(not 0 <= p <= 1 for p in shares.values()):
        raise ValueError("shares lie between 0 and 1")
    ship(rows.sparkSession)
    names = [f"g{i}" for i in range(len(by))]
    keyed = cut(rows.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], in_order(F.col(value).cast("double")).alias("v")))
    sizes = keyed.groupBy(*names).agg(F.count("v").alias("n"))

    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    each = F.array(*[F.struct(F.lit(name).alias("share"), F.lit(side).alias("side"), (F.floor(place(p)) if side == "low" else F.ceil(place(p))).cast("long").alias("left")) for name, p in shares.items() for side in ("low", "high")])
    # a place: which range of values it is in, and how many of the range's values come before it
    places = cut(sizes.where("n > 0").select(*names, F.explode(each).alias("x")).select(*names, "x.*", F.lit(None).cast("long").alias("range")))
    for done in range(0, 64, DIGIT):
        places = cut(_narrowed(keyed, places, names, 64 - done))
    found = places.select(*names, "share", "side", of_order(F.col("range")).alias("x")).groupBy(*names).agg(
        *[F.max(F.when((F.col("share") == name) & (F.col("side") == side), F.col("x"))).alias(f"{side}{i}") for i, name in enumerate(shares) for side in ("low", "high")]
    )
    same = [F.col(f"s.{n}").eqNullSafe(F.col(f"f.{n}")) for n in names]
    joined = sizes.alias("s").join(found.alias("f"), same or F.lit(True), "left")
    between = lambda i, p: F.when(F.floor(place(p)) == F.ceil(place(p)), F.col(f"low{i}")).otherwise((F.ceil(place(p)) - place(p)) * F.col(f"low{i}") + (place(p) - F.floor(place(p))) * F.col(f"high{i}"))
    return joined.select(*[F.col(f"s.{n}").alias(c) for c, n in zip(by, names)], *[between(i, p).alias(name) for i, (name, p) in enumerate(shares.items())])


def _narrowed(keyed: DataFrame, places: DataFrame, names: list[str], bits: int) -> DataFrame:
    """``places`` with ranges narrower by a digit; a range is told by the digits that its values have in common."""
    upper, digit = F.shiftright("v", bits) if bits < 64 else F.lit(None).cast("long"), F.shiftright("v", bits - DIGIT)
    ranges = places.select(*[F.col(n).alias(f"r_{n}") for n in names], F.col("range").alias("r")).distinct()
    rows = keyed.where("v IS NOT NULL").withColumn("upper", upper)
    wanted = [F.col(n).eqNullSafe(F.col(f"r_{n}")) for n in names] + [F.col("upper").eqNullSafe(F.col("r"))]
    if bits < 64:  # at first all values are in range
        few = ranges.limit(MOST_RANGES + 1).count() <= MOST_RANGES
        rows = rows.join(F.broadcast(ranges) if few else ranges, wanted, "left_semi")
    counts = rows.groupBy(*names, "upper", digit.alias("digit")).agg(F.count("*").alias("k"))
    within = Window.partitionBy(*names, "upper").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("k").over(within), F.lit(0)))
    c, p = counts.select(*[F.col(n).alias(f"c_{n}") for n in names], "upper", "digit", "k", "before"), places
    inside = [F.col(n).eqNullSafe(F.col(f"c_{n}")) for n in names] + [F.col("range").eqNullSafe(F.col("upper"))]
    hit = (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("k"))
    for x in inside:
        hit = hit & x
    return p.join(c, hit).select(*names, "share", "side", (F.col("left") - F.col("before")).alias("left"), F.col("digit").alias("range"))
