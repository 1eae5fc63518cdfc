import random
from collections import defaultdict

import numpy as np

from lectern.llm import ann, queries


def brute(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, q in asked:
        scores = (x * np.array(q, dtype=np.float64)).sum(axis=1)
        out[i] = sorted((-s, j) for s, j in zip(scores.tolist(), ids.tolist()) if j != i)[:k]
    return out


def recall(got, want, k):
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, true in want.items():
        mine = sorted(by[q])
        assert [r for r, *_ in mine] == list(range(1, len(true) + 1))
        assert [(-s, j) for _, j, s in mine] == sorted((-s, j) for _, j, s in mine)
        hit += len({j for _, j, _ in mine} & {j for _, j in true})
        total += len(true)
    assert set(by) == set(want)
    return hit / total


def test_op8_recall(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.op8_nearest_neighbours(spark, sf_dir).collect()
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert recall(got, want, 20) >= 0.9
    exact = {(q, j): -s for q, x in brute(rows, [r for r in rows if r[0] % 20 == 0], len(rows)).items() for s, j in x}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in got)


def test_many_lists_uneven_norms_and_a_third_of_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 40)
    monkeypatch.setattr(ann, "CHUNK", 100)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 20)
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(30, 12))
    x = (middles[rng.integers(0, 30, 1_500)] + 0.4 * rng.normal(size=(1_500, 12))) * rng.uniform(0.2, 3, size=(1_500, 1))
    x[:500] = x[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(table, table.where("vec_id % 7 = 0"), 10).collect()
    assert recall(got, brute(rows, [r for r in rows if r[0] % 7 == 0], 10), 10) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [1.0, 0.0]), (9, [0.5, 0.5]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(table, table, 5).collect())
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, 0.5), (8, 1, 0, 1.0), (8, 2, 9, 0.5), (9, 1, 0, 0.5), (9, 2, 8, 0.5)]
    assert ann.nearest(table.limit(0), table, 5).count() == 0 == ann.nearest(table, table.limit(0), 5).count()


def best_ids(rows, asked, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, q in asked:
        best = out.setdefault(i, {})
        for j, s in zip(ids.tolist(), (x * np.array(q, dtype=np.float64)).sum(axis=1).tolist()):
            if j != i:
                best[j] = max(s, best.get(j, s))
    return {i: sorted((-s, j) for j, s in best.items())[:k] for i, best in out.items()}


def test_repeated_rows_leave_room_for_other_ids():
    rng = np.random.default_rng(3)
    own = [(i, rng.normal(size=6)) for i in range(60)] + [(100 + i, np.full(6, 2.0)) for i in range(30)]
    for rows in (own * 2, own * 25, own + own[60:61] * 21, own + [(7, v + rng.normal(size=6) / 9) for _, v in own for _ in range(25)]):
        asked = [r for r in own if r[0] % 9 == 0]
        got = {q: list(zip(scores, ids)) for q, ids, scores in ann.nearest_in(np.array([i for i, _ in rows]), np.stack([v for _, v in rows]), np.array([i for i, _ in asked]), np.stack([v for _, v in asked]), 20)}
        want = best_ids(rows, asked, 20)
        assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}


def test_tables_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 100)
    rng = np.random.default_rng(5)
    own = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 6)))]
    for times in (2, 25):
        table = spark.createDataFrame(own * times, "vec_id long, embedding array<double>").repartition(3)
        got = ann.nearest(table, table.where("vec_id % 9 = 0"), 20).collect()
        assert recall(got, best_ids(own, [r for r in own if r[0] % 9 == 0], 20), 20) >= 0.9


def test_lengths_of_queries_and_clashing_names(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], "x", "y"), (2, [0.5, 0.5], "x", "y")], "vec_id long, embedding array<double>, VEC_ID string, list string")
    queries_of = spark.createDataFrame([(7, [1.0, 2.0, 3.0]), (8, [2.0, 0.0]), (9, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(table, queries_of, 5).collect())
    assert got == [(8, 1, 1, 2.0), (8, 2, 2, 1.0)]


def test_recall_over_the_table_in_many_lists(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 25)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.op8_nearest_neighbours(spark, sf_dir).collect()
    assert recall(got, brute(rows, [r for r in rows if r[0] % 20 == 0], 20), 20) >= 0.9
