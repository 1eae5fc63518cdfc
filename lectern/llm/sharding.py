"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick

#: Items that one task differences at most; above that, items are first joined into larger ones.
LEAF = 32_768
#: Largest and, apart from them, evenly chosen items that go up a level unjoined: they even out what the joined ones leave.
WHOLE = 2_048
#: Rows that are numbered together, or nearly.
BUCKET = 100_000


def differencing(weights: list[int], ways: int) -> list[int]:
    """Karmarkar-Karp: the part (0 .. ways - 1) of each weight.

    A partial partition is ``ways`` sums, largest first.  The two with the
    largest spread are combined oppositely ordered, until one is left.
    """
    if not weights:
        return []
    # node: (-spread, number, sums); how each was made is kept apart, to read the parts off from the top
    heap = [(-w, i, (w, *[0] * (ways - 1))) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    made: list[tuple[int, int, list[int]]] = []  # children and the order of their joined sums
    n = len(weights)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        joined = [x[i] + y[ways - 1 - i] for i in range(ways)]
        order = sorted(range(ways), key=joined.__getitem__, reverse=True)
        sums = tuple(joined[i] for i in order)
        heapq.heappush(heap, (sums[-1] - sums[0], n + len(made), sums))
        made.append((a, b, order))
    # slot j of a joined node is slot order[j] of its first child and the opposite one of its second
    slots: dict[int, list[int]] = {heap[0][1]: list(range(ways))}
    parts = [0] * n
    for k in range(len(made) - 1, -1, -1):
        part_of = slots.pop(n + k)
        a, b, order = made[k]
        first, second = [0] * ways, [0] * ways
        for j, i in enumerate(order):
            first[i] = part_of[j]
            second[ways - 1 - i] = part_of[j]
        for child, own in ((a, first), (b, second)):
            if child < n:
                parts[child] = own[0]
            else:
                slots[child] = own
    if not made:
        parts[0] = 0
    return parts


def _part(pdf: pd.DataFrame, ways: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["weight", "item"], ascending=[False, True])
    return pd.DataFrame({"item": pdf["item"], "bin": pdf["bin"], "part": differencing(pdf["weight"].tolist(), ways)})


def partition_items(items: DataFrame, ways: int, leaf: int = LEAF, whole: int = WHOLE) -> DataFrame:
    """item -> part for items (item string, weight long) of any number.

    Up to ``leaf`` items are differenced at once.  More are dealt by hash into
    bins of about ``leaf`` items; each bin is differenced into ``ways`` joined
    items, and these, with the largest items and a share of the others left as
    they are, go up a level.  A level has ``leaf`` / (4 * ways) times fewer
    items than the one below, so no task differences more than about ``leaf``.
    """
    if leaf < 8 * ways or leaf < 6 * whole:
        raise ValueError("a leaf must be larger, for levels to get smaller")
    ups: list[DataFrame] = []
    n = items.count()
    while n > leaf:
        # about a quarter of a leaf in each bin, but at most a joined item for every two
        bins = max(1, min(-(-n // leaf) * 4, n // (2 * ways)))
        top = F.broadcast(items.orderBy(F.desc("weight"), "item").limit(whole).select("item").withColumn("top", F.lit(True)))
        h = F.xxhash64("item", F.lit(len(ups)))
        few = F.pmod(h, F.lit(1_000_003)) < int(1_000_003 * whole / n)
        dealt = items.join(top, "item", "left").withColumn("bin", F.when(F.col("top") | few, F.lit(-1)).otherwise(F.pmod(F.xxhash64("item", F.lit("bin"), F.lit(len(ups))), F.lit(bins)).cast("int")))
        joined = dealt.where("bin >= 0").groupBy("bin").applyInPandas(lambda pdf: _part(pdf, ways), "item string, bin int, part int")
        up = joined.select("item", F.concat_ws("/", F.lit(f"level{len(ups)}"), "bin", "part").alias("up"))
        up = cut(up.unionByName(dealt.where("bin < 0").select("item", F.col("item").alias("up"))))
        ups.append(up)
        items = cut(items.join(up, "item").groupBy(F.col("up").alias("item")).agg(F.sum("weight").alias("weight")))
        n = items.count()
    parts = items.select("item", "weight", F.lit(0).alias("bin")).groupBy("bin").applyInPandas(lambda pdf: _part(pdf, ways), "item string, bin int, part int").select("item", "part")
    for up in reversed(ups):
        parts = up.join(parts.withColumnRenamed("item", "up"), "up").select("item", "part")
    return parts


def numbered(rows: DataFrame, key: str, order: list[str], to: str, n: int) -> DataFrame:
    """Gapless numbers from 0 within each ``key``, though a key may hold most of the ``n`` rows.

    Rows of a key are dealt by a hash of ``order`` into buckets, a thousand or
    one for every BUCKET rows, numbered in each, and moved by the sizes of the
    buckets before.
    """
    buckets = max(1_024, n // BUCKET)
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(key, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    at = Window.partitionBy(key, "__b").orderBy(*order)
    return dealt.withColumn("__at", F.row_number().over(at)).join(starts, [key, "__b"]).withColumn(to, F.col("__start") + F.col("__at") - 1).drop("__b", "__at", "__start")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: near-equal bytes, equal texts together.

    The law is ``bytes``: shards differ as little in bytes as differencing
    finds, though a group of equal texts is never split, so one that is larger
    than its share makes its shard larger.  size is the text's UTF-8 bytes plus
    1; a null text counts as empty and goes with the empty ones.  slot runs
    from 0 without gaps in each shard.  Null and repeated doc_ids are rows like
    any other; other columns are ignored, whatever their names.  An empty table
    gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", *[f.alias(n) for n, f in measures(text).items()])
    rows = cut(rows)
    placed = cut(rows.join(parts_of(rows, shards), "item").select("doc_id", "size", "text_crc32", F.col("part").alias("shard")))
    return numbered(placed, "shard", ["doc_id"], "slot", placed.count()).select("doc_id", "size", "text_crc32", "shard", "slot")


def measures(text: Column) -> dict[str, Column]:
    return {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "item": F.md5(text)}


def parts_of(rows: DataFrame, shards: int) -> DataFrame:
    """item -> part for rows (item, size): a group of equal texts is one item."""
    return partition_items(cut(rows.groupBy("item").agg(F.sum("size").alias("weight"))), shards)


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """The documents with all their columns as Parquet, one folder a shard; files in it are in order of slot.

    Shards and slots are those of ``shard``.  A row goes where its own text
    does, so null and repeated doc_ids are each written once; columns named
    shard or slot give way.
    """
    extra = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "shard", "slot")]
    names = [f"__{i}" for i in range(len(extra))]
    rows = pick(docs, "doc_id", "text", *extra).toDF("doc_id", "text", *names)
    rows = rows.withColumns({f"__{n}": f for n, f in measures(F.coalesce("text", F.lit(""))).items()})
    parts = cut(parts_of(rows.select(F.col("__item").alias("item"), F.col("__size").alias("size")), shards))
    placed = rows.join(parts.select(F.col("item").alias("__item"), F.col("part").alias("shard")), "__item")
    full = numbered(placed, "shard", ["doc_id"], "slot", rows.count()).select("doc_id", "text", *[F.col(n).alias(c) for n, c in zip(names, extra, strict=True)], "shard", "slot")
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)

