"""Clustering against plain integer rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from lectern.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=8, rounds=10, d=64):
    """vec_id, cluster, distance, cluster_inertia, inertia, hash by searching all centroids."""
    rows = [(i, v) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    vecs = [(i, [a * 1024 // b for a, b in (x.as_integer_ratio() for x in v)]) for i, v in rows]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v, x) for (i, x), (_, v) in zip(vecs, rows) if i is not None)
    cents = [x for _, _, x in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(cents)) for _, x in vecs]

    for _ in range(rounds):
        own = assign()
        for c in range(len(cents)):
            mine = [x for (_, x), (_, n) in zip(vecs, own) if n == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    by = [sum(d for d, n in own if n == c) for c in range(len(cents))]
    return [(i, n, dist, by[n], sum(by), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for (i, _), (dist, n) in zip(vecs, own)]


def got(df):
    return sorted([tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()], key=str)


def test_op12_equals_plain_rounds(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.op12_centroid_clustering(spark, sf_dir)) == sorted(plain(rows), key=str)


def test_odd_vectors_copies_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 3.0]) for _ in range(4)]) for i in range(60)]
    rows += [rows[3], rows[3], (5, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0, 1.0])] + [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30)]
    odd = [(200, None), (201, [1.0]), (202, [1.0, 2.0, float("nan"), 1.0]), (203, [1.0, None, 1.0, 1.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [])]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS cluster", "'x' AS Distance", "2 AS x", "3 AS h")
    assert got(centroids.cluster(df, dimensions=4)) == sorted(plain(rows, d=4), key=str)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [float(i)] * 4) for i in range(3)]
    assert got(centroids.cluster(spark.createDataFrame(rows, SCHEMA), dimensions=4)) == sorted(plain(rows, d=4), key=str)
    none = centroids.cluster(spark.createDataFrame([], SCHEMA), dimensions=4)
    assert none.count() == 0 and "centroid_sha256" in none.columns


def test_wide_components_are_summed_exactly(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 5]) for _ in range(4)]) for i in range(40)]
    assert got(centroids.cluster(spark.createDataFrame(rows, SCHEMA), dimensions=4)) == sorted(plain(rows, d=4), key=str)
    far = centroids.cluster(spark.createDataFrame([*rows, (99, [1e300, 0.0, 0.0, 0.0])], SCHEMA), k=2, dimensions=4).collect()
    assert len(far) == 41 and any(r.distance is None for r in far) == any(r.inertia is None for r in far)


def test_search_equals_all_distances_and_leaves_some_out():
    rng = np.random.default_rng(1)
    for trial in range(60):
        k, d, size = int(rng.integers(1, 12)), int(rng.choice([4, 64])), int(rng.choice([3, 1000, 1 << 26]))
        cents, x = rng.integers(-size, size, (k, d)), rng.integers(-size, size, (200, d))
        if trial % 3 == 0:
            x[:k], cents[-1] = cents, cents[0]
        dists = np.square(x[:, None, :] - cents[None]).sum(2)
        for search in (centroids.Centroids(cents.tolist()).nearest, lambda v: centroids.Centroids(cents.tolist())._nearest_wide(v.astype(object))):
            chosen, best, _ = search(x)
            assert (best == dists.min(1)).all() and (chosen == dists.argmin(1)).all()
    spread = np.arange(50)[:, None] * np.full((1, 64), 1_000)
    x = spread[rng.integers(0, 50, 500)] + rng.integers(-9, 9, (500, 64))
    assert centroids.Centroids(spread.tolist()).nearest(x)[2] < 3 * 500  # of 50 * 500


@pytest.mark.parametrize("value", [0.0009765, -0.0000001, 1023.9999, -3.3])
def test_components_are_floors(value):
    import pyarrow as pa

    assert centroids.integers(pa.array([[value]], pa.list_(pa.float64())), 1024).tolist() == [[math.floor(1024 * value)]]
