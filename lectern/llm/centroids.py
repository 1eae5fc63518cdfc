"""Exact k-means on integer vectors by equal-average equal-variance search.

With d components, sum S and deviation V (the root of the summed squares about
the mean), d times the squared distance of two vectors is at least the square
of their sums' difference, and at least that plus d times the square of their
deviations' difference.  Centroids lie in order of their sums, that is of their
means; a vector's search goes outward from its own mean, stops where the first
bound passes the best distance, skips centroids by the second, and computes
the rest in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, ship

#: Magnitude of components up to which 64-bit integers hold all squared distances of vectors of DIMENSIONS components.
NARROW = 1 << 27
DIMENSIONS = 64
#: Share of a bound that is given away for the rounding of floating numbers.
SLACK = 1e-9
#: Vectors that are searched at once, and rows into which a task's sums are dealt before they are added up.
SLICE, DEALT = 8_192, 64
LARGEST = (1 << 63) - 1


class Centroids:
    """Centroids in order of their sums, ready for searches."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.rows = [list(map(int, r)) for r in rows]
        self.narrow = all(abs(x) <= NARROW for r in self.rows for x in r)
        self.sums = [sum(r) for r in self.rows]
        self.order = sorted(range(len(rows)), key=lambda c: (self.sums[c], c))
        if self.narrow and rows:
            self.by_mean = np.array([self.rows[c] for c in self.order], np.int64)
            self.means = self.by_mean.sum(1).astype(np.float64)
            self.deviations = deviation(self.by_mean)
            self.numbers = np.array(self.order)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each row, and how many distances were computed.

        Of equally near centroids the smaller number counts.  Distances are
        Python integers where 64 bits may not hold them.
        """
        if not self.narrow or x.dtype == object:
            return self._nearest_wide(x)
        n, k, d = len(x), len(self.order), x.shape[1]
        sums, devs = x.sum(1).astype(np.float64), deviation(x)
        right = np.searchsorted(self.means, sums)
        left = right - 1
        best, chosen = np.full(n, LARGEST), np.full(n, k)
        live, computed = np.arange(n), 0
        for _ in range(k):
            lo, hi = left[live], right[live]
            to_left = np.where(lo >= 0, sums[live] - self.means[np.maximum(lo, 0)], np.inf)
            to_right = np.where(hi < k, self.means[np.minimum(hi, k - 1)] - sums[live], np.inf)
            use_left = to_left <= to_right
            gap = np.where(use_left, to_left, to_right)
            most = best[live].astype(np.float64) * d * (1 + SLACK)
            open_ = gap * gap <= most  # beyond, all others are further still
            live, use_left, gap, most = live[open_], use_left[open_], gap[open_], most[open_]
            if not len(live):
                break
            at = np.where(use_left, left[live], right[live])
            left[live] -= use_left
            right[live] += ~use_left
            spread = devs[live] - self.deviations[at]
            # a deviation is known to a share of its own size, so that share is taken off the difference
            spread = np.maximum(np.abs(spread) - SLACK * (devs[live] + self.deviations[at]), 0)
            near = gap * gap + d * spread * spread <= most
            rows, cents = live[near], at[near]
            diff = x[rows] - self.by_mean[cents]
            own, number = np.einsum("ij,ij->i", diff, diff), self.numbers[cents]
            computed += len(rows)
            better = (own < best[rows]) | ((own == best[rows]) & (number < chosen[rows]))
            best[rows[better]], chosen[rows[better]] = own[better], number[better]
        return chosen, best, computed

    def _nearest_wide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The same in Python integers, with the bound of the means alone."""
        chosen, best, computed, d = [], [], 0, x.shape[1]
        for row in x.tolist():
            total, own, number = sum(row), None, len(self.rows)
            for c in sorted(self.order, key=lambda c: abs(self.sums[c] - total)):
                if own is not None and (self.sums[c] - total) ** 2 > d * own:
                    break
                dist = sum((a - b) ** 2 for a, b in zip(row, self.rows[c]))
                computed += 1
                if own is None or (dist, c) < (own, number):
                    own, number = dist, c
            chosen.append(number)
            best.append(own)
        return np.array(chosen, np.int64), np.array(best, object), computed


def deviation(x: np.ndarray) -> np.ndarray:
    """Root of the summed squares about the mean, of each row."""
    x = x.astype(np.float64)
    return np.sqrt(np.square(x - x.mean(1, keepdims=True)).sum(1))


def integers(column: pa.ListArray, scale: int) -> np.ndarray:
    """floor(scale * x) of the lists' components, as 64-bit integers where all are narrow, else as Python integers."""
    lists = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        scaled = np.floor(lists * scale)
    if not len(column) or np.abs(scaled).max() <= NARROW:
        return scaled.astype(np.int64)
    return np.array([[a * scale // b for a, b in map(float.as_integer_ratio, row)] for row in lists.tolist()], dtype=object)


def kept(vectors: DataFrame, dimensions: int) -> DataFrame:
    """vec_id, x (floats as they are, other numbers as doubles): the vectors of exactly that many components, none null or non-finite."""
    rows = pick(vectors, "vec_id", "embedding")
    kind = rows.schema["embedding"].dataType.simpleString()
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("x"))
    return rows.where(F.size("x") == dimensions).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _searched(batches: Iterator[pa.RecordBatch], cents: Centroids, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            x = integers(part.column(1), scale)
            chosen, best, _ = cents.nearest(x)
            yield part, x, chosen, best


def _added(sums: dict[int, list], cluster: int, count: int, total: list[int]) -> None:
    own = sums.setdefault(cluster, [0, [0] * len(total)])
    own[0] += count
    own[1] = [a + b for a, b in zip(own[1], total)]


def moved(rows: DataFrame, cents: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after one round: the floor of each one's mean; one without vectors stays.

    Every task adds up its own vectors; the sums of all tasks are added in two
    steps, so that the driver gets at most DEALT rows a centroid.
    """
    found = Centroids(cents)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for _, x, chosen, _ in _searched(batches, found, scale):
            for c in np.unique(chosen).tolist():
                own = x[chosen == c]
                _added(sums, c, len(own), own.sum(0).tolist())
        yield from out(sums)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                _added(sums, r["cluster"], r["n"], list(map(int, r["sums"])))
        yield from out(sums)

    def out(sums: dict[int, list]) -> Iterator[pa.RecordBatch]:
        if sums:  # sums are text, as they have no bound
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(sums, pa.int32()), "n": pa.array([n for n, _ in sums.values()], pa.int64()), "sums": pa.array([list(map(str, s)) for _, s in sums.values()], pa.list_(pa.string()))})

    schema = "cluster int, n long, sums array<string>"
    dealt = rows.mapInArrow(parts, schema).withColumn("__deal", F.spark_partition_id() % DEALT)
    total: dict[int, list] = {}
    for r in dealt.repartition(DEALT, "cluster", "__deal").drop("__deal").mapInArrow(both, schema).collect():  # at most DEALT rows a centroid
        _added(total, r.cluster, r.n, list(map(int, r.sums)))
    return [[s // total[c][0] for s in total[c][1]] if c in total else row for c, row in enumerate(cents)]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1_024, dimensions: int = DIMENSIONS, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Components become floor(scale * x).  Centroids start as the k vectors of
    smallest sha256 of ``seed:vec_id``; rows that share a vec_id are vectors of
    their own and start in order of their components, and rows without vec_id
    are clustered but never started from.  With fewer than k vectors there are
    as many centroids; without any, and from an empty table, no rows.  Vectors
    that are null, of another length, or hold null or non-finite components
    take no part.  Whatever passes 64 bits is summed exactly; a distance or sum
    that no long holds comes out null.  Other columns are ignored.
    """
    ship(vectors.sparkSession)
    rows = cut(kept(vectors, dimensions))
    first = rows.where("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy("h", "x").limit(k)
    start = pa.array([list(r.x) for r in first.collect()], pa.list_(pa.float64()))  # k rows
    cents = integers(start, scale).tolist() if len(start) else []
    schema = "vec_id long, cluster int, distance long"
    if not cents:
        empty = rows.sparkSession.createDataFrame([], schema)
        return empty.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        cents = moved(rows, cents, scale)
    found = Centroids(cents)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, chosen, best in _searched(batches, found, scale):
            held = [None if b > LARGEST else b for b in best.tolist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(chosen, pa.int32()), pa.array(held, pa.int64())], ["vec_id", "cluster", "distance"])

    done = cut(rows.mapInArrow(assigned, schema))
    # null where one of the distances is: a sum without it would be another one
    summed = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("unknown")).collect()  # k rows
    inertia = {r.cluster: None if r.unknown else int(r.s) for r in summed}
    whole = None if None in inertia.values() else sum(inertia.values())
    fits = lambda v: v if v is not None and v <= LARGEST else None
    told = [(c, fits(inertia[c]), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for c in inertia]
    each = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")
    return done.join(F.broadcast(each), "cluster").select(*done.columns, "cluster_inertia", F.lit(fits(whole)).cast("long").alias("inertia"), "centroid_sha256")
