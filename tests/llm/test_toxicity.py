import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.llm import queries
from lectern.llm import toxicity as X

BAD = ["vile", "scumrot", "filthor", "wretchen", "idiotar"]


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "de", "ki", "lo", "nu", "sa", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 80))]
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_rows_are_told_apart(spark):
    rows = corpus(1_500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.score_documents(docs, labels.where(~X.held_out())).collect()}
    assert len(got) == len(rows)
    held = [(got[i].score, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and all((s >= 0.5) == bool(y) for s, y in held)
    assert all(0 <= s <= 1 for s, _ in held)
    assert all(e["doc_id"] in got for r in got.values() for e in r.evidence)


def test_index_equals_brute_force():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        terms = sorted(rng.choice(60, rng.integers(0, 9), replace=False).tolist())
        rows.append((i, terms, rng.integers(1, 4, len(terms)).tolist(), int(rng.random() < 0.4)))
    index = X.BlockMaxIndex(rows, 1 + rng.random(60), (1.0, 1.0))
    for _, terms, counts, _ in [r for r in rows if r[1]][:150]:
        x = index.vector(terms, counts)
        cosine = np.round(x @ index.weights[terms], 12)
        want = sorted((-c, j) for j, c in enumerate(cosine.tolist()) if c > 0)[: X.NEIGHBOURS]
        got = [(-c, j) for c, j in index.nearest(terms, counts)]
        assert got == want


TOXIC_DIR = os.environ.get("TEST_TOXIC_DIR", "/root/testdata/sf0.01")


def plain_scores(docs, labels):
    """The whole operator told again with dense matrices: (doc_id, score before calibration, toxic) by brute force."""
    known = {}
    for d, y in labels:
        if d is not None and y in (0, 1):
            known[d] = max(y, known.get(d, 0))
    words = {}
    for d, text in docs:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        words.setdefault(d, []).append(Counter(found + [w[: X.STEM] + "-" for w in found if len(w) > X.STEM]))
    learned = [(d, words[d][0], y) for d, y in known.items() if d in words]
    n = [sum(y == k for *_, y in learned) for k in (0, 1)]
    terms = sorted({t for _, c, _ in learned for t in c})
    place = {t: i for i, t in enumerate(terms)}

    def matrix(counters):
        out = np.zeros((len(counters), len(terms)))
        for i, c in enumerate(counters):
            for t, k in c.items():
                if t in place:
                    out[i, place[t]] = k
        return out

    ex, y = matrix([c for _, c, _ in learned]), np.array([y for *_, y in learned])
    every = matrix([c for own in words.values() for c in own])
    df = (every > 0).sum(axis=0)
    has = (ex > 0).astype(float)
    a, b = has[y == 1].sum(axis=0), has[y == 0].sum(axis=0)
    m = a + b
    under = n[0] * n[1] * m * (sum(n) - m)
    phi = np.where(under > 0, (a * (n[0] - b) - b * (n[1] - a)) ** 2 / np.maximum(under, 1), 0)
    weight = np.log((len(every) + 1) / (df + 1)) * (np.maximum(0, phi - 1 / (sum(n) - 1)) + X.PLAIN)

    def unit(x):
        x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * weight
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)

    return [d for d, own in words.items() for _ in own], np.round(unit(every) @ unit(ex).T, 12), [d for d, *_ in learned], y


def test_op9_finds_what_brute_force_over_all_terms_finds(spark):
    """Evidence of every document against dense cosines over all terms, on a table that has toxic documents."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TOXIC_DIR}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{TOXIC_DIR}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    ids, cosines, examples, toxic = plain_scores(docs, labels)
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, TOXIC_DIR).collect()}
    assert len(got) == len(docs)
    of = dict(zip(examples, toxic.tolist(), strict=True))
    for d, row in zip(ids, cosines, strict=True):
        best = np.sort(row[row > 0])[::-1][:3]
        assert np.allclose([e.cosine for e in got[d].evidence], best, atol=1e-9), d
        assert all(of[e.doc_id] == e.toxic and abs(row[examples.index(e.doc_id)] - e.cosine) < 1e-9 for e in got[d].evidence)
    held = [(got[d].score, y) for d, y in [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{TOXIC_DIR}/labels.parquet").collect()] if got[d].held_out]
    clean = [s for s, y in held if not y]
    assert len(set(got[d].score for d in got)) > 20 and sum(s >= 0.5 for s in clean) <= 0.05 * len(clean)


def test_exact_copies_find_examples_whose_words_tell_nothing(spark):
    """Every word is of one example alone: none tells the classes apart, and each copy goes with its example all the same."""
    text = lambda i: " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{w}" for w in ("ox", "uq", "ep", "yz", "im", "ad"))
    docs = spark.createDataFrame([(i, text(i)) for i in range(100)] + [(1_000 + i, text(i)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.score_documents(docs, labels).collect()}
    for i in range(100):
        found = got[1_000 + i].evidence
        assert found[0].doc_id == i and abs(found[0].cosine - 1) < 1e-9 and found[0].toxic == i % 2
    even, odd = ([got[1_000 + i].score for i in range(k, 100, 2)] for k in (0, 1))
    assert max(even) <= min(odd) and np.mean(odd) >= np.mean(even)


def test_frequent_terms_are_multiplied_out_exactly():
    rng = np.random.default_rng(8)
    rows = [(i, (t := np.unique(np.concatenate([np.flatnonzero(rng.random(12) < 0.6), rng.integers(12, 900, 20)]))), rng.integers(1, 5, len(t)), int(i % 7 == 0)) for i in range(1_500)]
    index = X.BlockMaxIndex(rows, 0.1 + rng.random(900), (1.0, 1.0))
    assert 0 < len(index.most) <= 12
    weights = index.weights
    for found, (_, terms, counts, _) in zip(index.nearest_of([(t, c, None) for _, t, c, _ in rows[:200]]), rows[:200]):
        cosine = index.vector(terms, counts) @ weights[terms]
        assert np.allclose([c for c, _ in found], np.sort(cosine)[::-1][: X.NEIGHBOURS], atol=1e-11)


def test_flipped_labels_of_held_out_rows_change_no_score(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = lambda flip: spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    one, two = ({r.doc_id: r.score for r in X.score_documents(docs, labels(f).where(~X.held_out())).collect()} for f in (False, True))
    assert one == two and len(set(one.values())) > 5


def test_scores_do_not_depend_on_labels_of_held_out_rows(spark, sf_dir):
    rows = queries.op9_toxicity(spark, sf_dir).collect()
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(rows) == n
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1), (99, 1), (3, 7)], "doc_id long, toxic int").withColumn("score", F.lit("x"))
    rows = X.score_documents(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.score for r in X.score_documents(odd_docs, none).collect()} == {0.0}
    assert X.score_documents(no_docs, labels).count() == 0


def test_sums_in_single_precision_lose_no_neighbour():
    """Cosines that differ by less than single precision tells, in frequent and in rare terms, and more equal ones than neighbours."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(2_000):
        terms = np.unique(np.concatenate([np.flatnonzero(rng.random(20) < 0.5), rng.integers(20, 400, 15)]))
        rows.append((i, terms, rng.integers(1, 3, len(terms)), int(i % 3 == 0)))
    for i in range(2_000, 2_100):  # one text with counts of a million, and one more or less of one term
        rows.append((i, np.arange(0, 60, 2), np.where(np.arange(30) == i % 30, 1_000_000 + i % 2, 1_000_000), i % 2))
    index = X.BlockMaxIndex(rows, 1 + rng.random(400), (1.0, 1.0))
    assert index.most.dtype == np.float32 and index.blocks > X.NEIGHBOURS
    place, weights = {d: j for j, d in enumerate(index.ids)}, index.weights
    asked = [rows[i] for i in (*range(60), *range(2_000, 2_100))]
    for skip in (False, True):
        found = index.nearest_of([(t, c, place[d] if skip else None) for d, t, c, _ in asked])
        for got, (d, terms, counts, _) in zip(found, asked, strict=True):
            cosine = np.round(index.vector(terms, counts) @ weights[terms], 12)
            if skip:
                cosine[place[d]] = 0
            best = np.sort(cosine)[::-1][: X.NEIGHBOURS]
            assert np.allclose([c for c, _ in got], best, atol=2e-12, rtol=0)
            assert all(abs(cosine[j] - c) < 2e-12 for c, j in got) and len({j for _, j in got}) == X.NEIGHBOURS


def test_words_are_hashed_by_themselves_alone(monkeypatch):
    """Neither the words beside one, nor where it lies, nor what stands after it in memory changes its hash; zero bytes and lengths do."""
    words = ["a", "ab", "abcdefgh", "abcdefghi", "ä" * 4, "ä" * 5, "x" * 63, "x" * 64, "x" * 65, "y" * 5_000, "b", "ba", "a\0", "a\0\0", "a\0\0\0\0\0\0\0\0"]
    each = [int(X.hashes(pa.array([w], pa.large_string()))[0]) for w in words]
    assert len({*each, 0}) == len(words) + 1
    assert X.hashes(pa.array(words, pa.large_string())).tolist() == each
    assert X.hashes(pa.array(words[::-1] + [None], pa.string())).tolist() == [*each[::-1], 0]
    assert X.hashes(pa.array(["q", None, *words, "r"], pa.large_string()).slice(2, len(words))).tolist() == each
    assert X.hashes(pa.array([], pa.large_string())).tolist() == []
    monkeypatch.setattr(X, "xxhash", None)  # words of usual length are not hashed one by one
    many = pa.array([f"w{i}" for i in range(200_000)], pa.large_string())
    own = X.hashes(many)
    assert len(np.unique(own)) == 200_000
    assert all(abs(np.mean(own >> b & 1) - 0.5) < 0.01 for b in range(64))
