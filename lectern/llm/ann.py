"""Approximate nearest neighbours by largest inner product over balanced posting lists.

One more component, sqrt(max norm^2 - norm^2), turns largest inner products
into smallest distances, so lists are built by distance.  Centroids are fitted
on a bounded sample with balanced sizes and linked into a graph that every task
holds.  Each vector goes to its nearest list and, near a border, to further
ones.  A query walks the graph from its nearest centroid outwards and reads the
lists whose distance is within a ratio of the nearest one's; the ratio is fitted
so that a bounded set of probe queries finds the wanted share of its true
neighbours.  Lists and the queries on them are dealt in chunks, so a dense spot
is no single task.  Scores are exact inner products in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, ship

#: Vectors that the centroids are fitted on at most.
SAMPLE = 16_384
#: Vectors a list is meant to hold, and lists at most.
LIST, MOST_LISTS = 512, 2_048
#: Vectors, and queries, that meet in one chunk at most, or nearly.
CHUNK, QUERY_CHUNK = 4_096, 2_048
#: Lists a vector goes to at most, and how much farther than the nearest the others may be.
COPIES, BORDER = 2, 1.15
#: Queries that the ratio is fitted on, and the share of true neighbours that they must find.
PROBES, WANTED = 96, 0.97
EDGES = 12


def balanced_centroids(points: np.ndarray, lists: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """k-means whose assignment charges full lists, so that sizes stay near each other."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(points)))
    centroids = points[rng.choice(len(points), lists, replace=False)].astype(np.float64)
    charge = np.zeros(lists)
    for _ in range(rounds):
        near = distances(points, centroids)
        owner = (near + charge).argmin(axis=1)
        sizes = np.bincount(owner, minlength=lists)
        charge += 0.3 * near.min(axis=1).mean() * (sizes * lists / len(points) - 1)
        charge -= charge.min()
        for k in np.flatnonzero(sizes):
            centroids[k] = points[owner == k].mean(axis=0)
    return centroids


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1))


@dataclass
class Lists:
    """What every task holds: at most MOST_LISTS centroids, their graph, and the ratio."""

    top: float
    centroids: np.ndarray
    ratio: float = 1.0
    sizes: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        near = distances(self.centroids, self.centroids)
        edges = np.argsort(near, axis=1, kind="stable")[:, 1 : EDGES + 1]
        out = [set(map(int, e)) for e in edges]
        for i, e in enumerate(edges):  # edges lead both ways
            for j in e:
                out[j].add(i)
        for i in range(1, len(out)):  # and every centroid is reached from the first
            nearest = int(near[i, :i].argmin())
            out[i].add(nearest)
            out[nearest].add(i)
        self.graph = [np.array(sorted(x - {i}), dtype=np.int64) for i, x in enumerate(out)]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.top - (x * x).sum(axis=1)))[:, None]])

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of vectors: the nearest list and those about as near, but none hidden behind a nearer one."""
        near = np.sqrt(distances(self.lifted(x), self.centroids))
        order = np.argsort(near, axis=1, kind="stable")[:, : 2 * COPIES]
        rows, lists = [np.arange(len(x))], [order[:, 0]]
        taken = np.ones(len(x), dtype=int)
        apart = np.sqrt(distances(self.centroids, self.centroids))
        for k in range(1, order.shape[1]):
            own = near[np.arange(len(x)), order[:, k]]
            ok = (own <= BORDER * near[np.arange(len(x)), order[:, 0]]) & (apart[order[:, 0], order[:, k]] > 0.5 * own) & (taken < COPIES)
            rows.append(np.flatnonzero(ok))
            lists.append(order[ok, k])
            taken += ok
        return np.concatenate(rows), np.concatenate(lists)

    def search(self, q: np.ndarray, least: int) -> list[int]:
        """Lists within the ratio of the nearest one's distance, found along the graph; more until they hold ``least`` ids."""
        q = np.append(q, 0.0)

        def far(ids: np.ndarray) -> np.ndarray:
            return np.sqrt(((self.centroids[ids] - q) ** 2).sum(axis=1))

        seen = {0}
        heap = [(float(far(np.array([0]))[0]), 0)]
        beam: list[float] = []  # the nearest so far, negated: the walk goes on while it may still get nearer
        reached: list[tuple[float, int]] = []
        while heap:
            d, at = heapq.heappop(heap)
            if len(beam) >= 2 * EDGES and d > -beam[0] and d > self.ratio * min(x for x, _ in reached) * 1.05 and sum(self.sizes.get(k, 0) for _, k in reached) >= 2 * least:
                break
            reached.append((d, at))
            heapq.heappush(beam, -d)
            if len(beam) > 2 * EDGES:
                heapq.heappop(beam)
            new = np.array([j for j in self.graph[at] if j not in seen], dtype=np.int64)
            if len(new):
                seen.update(new.tolist())
                for d2, j in zip(far(new).tolist(), new.tolist(), strict=True):
                    heapq.heappush(heap, (d2, j))
        reached.sort()
        out, held = [], 0
        for d, at in reached:
            if d > self.ratio * reached[0][0] and held >= least:
                break
            out.append(at)
            held += self.sizes.get(at, 0)
        return out


def as_matrix(column: list[bytes] | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1)


def nearest_in(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[float]]]:
    """For each query the k best ids of these vectors other than itself; equal scores by id.

    Equal vectors are scored once, with their k + 1 smallest different ids; an
    id of several vectors counts once, with its best one.  Products
    choose among distinct vectors with room to spare; what they choose is then
    scored row by row, so equal vectors get equal scores.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    kinds, kind = np.unique(x, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    members: list[list[int]] = [[] for _ in kinds]
    for i, c in zip(ids.tolist(), kind.tolist(), strict=True):
        if len(members[c]) <= k and members[c][-1:] != [i]:
            members[c].append(i)
    # so many of the best vectors have k + 1 ids at least, however many vectors one id has
    most = int(np.unique(np.unique(np.stack([ids, kind]), axis=1)[0], return_counts=True)[1].max(initial=1))
    rough = q @ kinds.T
    spare = min(len(kinds), (k + 1) * most + 16)
    for row, qid, own in zip(rough, query_ids.tolist(), q, strict=True):
        chosen = np.argpartition(-row, spare - 1)[:spare]
        exact = (kinds[chosen] * own).sum(axis=1)
        found = sorted((-s, i) for s, c in zip(exact.tolist(), chosen.tolist(), strict=True) for i in members[c] if i != qid)
        best: dict[int, float] = {}
        for s, i in found:
            if len(best) == k:
                break
            best.setdefault(i, -s)
        yield qid, list(best), list(best.values())


def sound(table: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, e): vectors that are not null, empty or zero, have no null or non-finite component, and have an id."""
    base = pick(table, key, column).toDF("vec_id", "e").select(F.col("vec_id").cast("long"), F.col("e").cast("array<double>")).where("vec_id IS NOT NULL AND size(e) > 0")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    return base.where(F.coalesce(fine, F.lit(False)))


def usual_length(table: DataFrame) -> int:
    """The most frequent length of the ``sound`` vectors, the smallest of these; 0 without any."""
    first = table.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return first["d"] if first else 0


def vectors(table: DataFrame, length: int) -> DataFrame:
    """(vec_id, v): those of this length, as little-endian doubles, equal rows once."""
    base = table.where(F.size("e") == length)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            rows = flat.reshape(len(b), -1) if len(b) else flat.reshape(0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "v"])

    return base.mapInArrow(packed, "vec_id long, v binary").dropDuplicates(["vec_id", "v"])


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query.

    ``queries`` is a table like ``table``; a query finds no vector of its own
    id.  Vectors that are not ``sound``, or not of the table's usual length,
    take no part, as query or candidate.  Rows that repeat an id count once,
    with whichever of their vectors scores best.  Fewer than k candidates are
    all returned.  The two columns are found by exact name before any other
    spelling; other columns are ignored.  Empty tables give no rows.
    """
    spark = table.sparkSession
    ship(spark)
    known = sound(table, key, column)
    length = usual_length(known)
    base = cut(vectors(known, length))
    asked = cut(vectors(sound(queries, key, column), length))
    out = "query_id long, rank int, vec_id long, score double"
    n = base.count()
    if not n or not asked.limit(1).count():
        return spark.createDataFrame([], out)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 0.0
        for b in batches:
            if len(b):
                x = as_matrix(b.column(0).to_pylist())
                top = max(top, float((x * x).sum(axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array([top])], ["top"])

    top = base.select("v").mapInArrow(norms, "top double").agg(F.max("top")).first()[0]
    sample = as_matrix([r.v for r in base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()])
    lists = Lists(top, np.zeros((1, sample.shape[1] + 1)))
    lists = Lists(top, balanced_centroids(lists.lifted(sample), min(MOST_LISTS, -(-n // LIST))))
    lists.ratio = fitted_ratio(lists, base, asked, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                rows, own = lists.homes(as_matrix(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], ["list", "vec_id", "v"])

    posted = cut(base.mapInArrow(assign, "list int, vec_id long, v binary"))
    rows = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows at most
    homes = cut(posted.select("list", "vec_id").distinct())
    lists.sizes = {r["list"]: r["n"] for r in homes.groupBy("list").agg(F.count("*").alias("n")).collect()}
    # lists that hold 2 * k ids for each list that one id may be in hold 2 * k different ones
    spread = homes.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    least = 2 * k * max(COPIES, spread)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                hits = [lists.search(q, least) for q in as_matrix(b.column(1).to_pylist())]
                rows = np.repeat(np.arange(len(b)), [len(h) for h in hits])
                yield pa.RecordBatch.from_arrays([pa.array([x for h in hits for x in h], pa.int32()), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], ["list", "query_id", "q"])

    probes = cut(asked.mapInArrow(walk, "list int, query_id long, q binary"))
    chunks = spark.createDataFrame([(i, -(-c // CHUNK)) for i, c in sorted(rows.items())], "list int, parts int")
    counts = probes.groupBy("list").agg(F.count("*").alias("n"))
    plan = cut(chunks.join(counts, "list").select("list", "parts", F.ceil(F.col("n") / QUERY_CHUNK).cast("int").alias("query_parts")))
    plan = F.broadcast(plan)  # MOST_LISTS rows at most
    to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = posted.join(plan, "list").select("list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), to("query_parts").alias("query_part"), "vec_id", "v")
    right = probes.join(plan, "list").select("list", to("parts").alias("part"), F.pmod(F.xxhash64("query_id"), "query_parts").cast("int").alias("query_part"), "query_id", "q")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        found = nearest_in(x["vec_id"].to_numpy(), as_matrix(x["v"]), y["query_id"].to_numpy(), as_matrix(y["q"]), k)
        return pd.DataFrame(found, columns=["query_id", "ids", "scores"])

    keys = ["list", "part", "query_part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, ids array<long>, scores array<double>")
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda z: F.struct((-z["scores"]).alias("s"), z["ids"].alias("vec_id")))
    return _best(met.select("query_id", pairs.alias("found")), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, found) over all lists; a vector that several hold counts once."""
    every = F.array_sort(F.flatten(F.collect_list("found")))  # k entries for each list that the query read

    def add(kept, x):
        full = (F.size(kept) >= k) | F.exists(kept, lambda y: y["vec_id"] == x["vec_id"])
        return F.when(full, kept).otherwise(F.concat(kept, F.array(x)))

    merged = found.groupBy("query_id").agg(every.alias("every"))
    best = merged.select("query_id", F.aggregate("every", F.slice("every", 1, 0), add).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def exact(base: DataFrame, probes: list[tuple[int, bytes]], k: int) -> DataFrame:
    """Brute force for a bounded list of queries: one pass over all vectors."""
    ids = np.array([i for i, _ in probes], dtype=np.int64)
    q = as_matrix([v for _, v in probes])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                found = list(nearest_in(b.column(0).to_numpy(), as_matrix(b.column(1).to_pylist()), ids, q, k))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([[{"s": -s, "vec_id": i} for i, s in zip(f[1], f[2], strict=True)] for f in found], pa.list_(pa.struct([("s", pa.float64()), ("vec_id", pa.int64())])))], ["query_id", "found"])

    return _best(base.mapInArrow(scan, "query_id long, found array<struct<s: double, vec_id: long>>"), k)


def fitted_ratio(lists: Lists, base: DataFrame, asked: DataFrame, k: int) -> float:
    """The distance ratio at which PROBES queries find the WANTED share of their true neighbours."""
    probes = [(r.vec_id, r.v) for r in asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(PROBES).collect()]
    truth = exact(base, probes, k).select("query_id", "vec_id")
    rows = truth.join(base, "vec_id").select("query_id", "v").collect()  # PROBES * k rows
    if not rows:
        return 1.0
    own = {i: v for i, v in probes}
    q = np.hstack([as_matrix([own[r.query_id] for r in rows]), np.zeros((len(rows), 1))])
    at, homes = lists.homes(as_matrix([r.v for r in rows]))
    near = np.sqrt(distances(q, lists.centroids))
    ratio = np.full(len(rows), np.inf)
    np.minimum.at(ratio, at, near[at, homes] / np.maximum(near.min(axis=1)[at], 1e-12))
    return float(np.quantile(ratio, WANTED)) * (1 + 1e-9)
