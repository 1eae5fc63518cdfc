"""Merkle manifest of a dataset: a tree over the rows of each language, and one over their roots.

Nodes are labelled with the interval of leaf ranks that they cover.  Levels are
taken in bands: a node at the foot of a band falls into the bucket whose
interval contains its own, a bucket's nodes are hashed up to the one node that
covers it, and that node stands at the foot of the next band.  On the way back
each bucket is joined with the node of the band above whose interval contains
it, which brings all further ancestors.  The siblings of a node are what is
left of its parent's interval without its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, ship

#: Children of a node, and levels of a band: a bucket holds RUN ** BAND nodes at most.
RUN, BAND = 2, 9
Node = tuple[int, int, str]  # first rank, last rank, digest
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """Digest of a row: of each column ``-`` if it is null, else its UTF-8 byte count, a colon, and its value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told), 256)


def levels_above(foot: list[Node], width: int, whole: bool, run: int = RUN, band: int = BAND) -> list[list[Node]]:
    """The nodes of a bucket level by level, its foot first.

    Nodes of the foot cover ``width`` ranks each (the last one fewer, perhaps).
    The levels end with a single node if the bucket is the ``whole`` tree, and
    after ``band`` further ones otherwise, where a last run of one child is a
    parent all the same.
    """
    levels = [foot]
    while len(levels) <= band and not (whole and len(levels[-1]) == 1):
        width *= run
        up: list[Node] = []
        children: list[Node] = []
        for node in levels[-1]:
            if children and node[0] // width != children[0][0] // width:
                up.append(parent(children))
                children = []
            children.append(node)
        levels.append([*up, parent(children)])
    return levels


def parent(children: list[Node]) -> Node:
    return children[0][0], children[-1][1], digest(*[c[2] for c in children])


def siblings(levels: list[list[Node]]) -> list[list[tuple[str, str]]]:
    """For each node of the foot, level by level: the siblings before and after it, digests put together.

    A node's siblings are the nodes that cover its parent's interval without its own.
    """
    above: list[list[tuple[str, str]]] = [[]]
    for level, parents in zip(levels[-2::-1], levels[:0:-1]):
        own, at = [], 0
        for (lo, hi, _), path in zip(parents, above, strict=True):
            covered = []
            while at < len(level) and lo <= level[at][0] and level[at][1] <= hi:
                covered.append(level[at])
                at += 1
            for child in covered:
                before = "".join([d for _, last, d in covered if last < child[0]])
                after = "".join([d for first, _, d in covered if first > child[1]])
                own.append([(before, after), *path])
        above = own
    return above


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with rank (from 0, gapless) in each tree by the order's columns, and n (rows of the tree).

    Ranges of the order are sorted on their own, counted, and moved by the
    counts of the ranges before them, so no tree has to fit into one task.
    Rows that are alike in all of it are dealt at random, as one of them may
    be most of a tree.  Nulls come first.
    """
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [tree, *order, "__tie"]
    ordered = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(ordered.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).drop("__tie"))
    counts = placed.groupBy(tree, "__range").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("of_tree").orderBy("at_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select(F.col(tree).alias("of_tree"), F.col("__range").alias("at_range"), "first", "rows")
    moved = moved.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).withColumn("n", F.sum("rows").over(Window.partitionBy("of_tree")))
    # a range is one task's rows: joined on it, a large tree is as many keys as it has ranges
    joined = placed.join(moved.drop("first", "rows"), (F.col("__range") == F.col("at_range")) & F.col(tree).eqNullSafe(F.col("of_tree")))
    return joined.withColumn("rank", F.col("__at") + F.col("base")).drop("__range", "__at", "of_tree", "at_range", "base")


def bucketed(nodes: DataFrame, width: int, run: int, band: int, *carried: str) -> DataFrame:
    """tree, n, bucket, foot (nodes in order of their intervals, with what they carry) for tree, n, lo, hi, digest."""
    node = F.struct("lo", "hi", "digest", *carried)
    bucket = F.expr(f"lo div {width * run**band}")
    return nodes.groupBy("tree", "n", bucket.alias("bucket")).agg(F.sort_array(F.collect_list(node)).alias("foot"))


def tops(buckets: DataFrame, width: int, run: int, band: int) -> DataFrame:
    """tree, n, lo, hi, digest: the node that covers each bucket."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, foot in zip(batch.column(1).to_pylist(), batch.column(2)):
                nodes = [(x["lo"], x["hi"], x["digest"]) for x in foot.as_py()]
                out.append(levels_above(nodes, width, n <= width * run**band, run, band)[-1][0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*out) if out else [[], [], []], (pa.int64(), pa.int64(), pa.string()))]], ["tree", "n", "lo", "hi", "digest"])

    return buckets.select("tree", "n", F.transform("foot", lambda x: F.struct(x["lo"], x["hi"], x["digest"])).alias("foot")).mapInArrow(up, "tree string, n long, lo long, hi long, digest string")


class Trees:
    """Trees over leaves (tree, n, lo, hi, digest and further columns), hashed band by band.

    ``bands`` keeps the buckets of each band, ``roots`` (tree, digest) the node
    that each tree ends with; a tree of one leaf ends with that leaf.
    """

    def __init__(self, leaves: DataFrame, run: int = RUN, band: int = BAND, carried: tuple[str, ...] = ()) -> None:
        self.run, self.band, self.bands, self.widths, self.carried = run, band, [], [], carried
        nodes, width, ended, own = leaves, 1, [], carried
        while True:
            buckets = cut(bucketed(nodes, width, run, band, *own))
            found = cut(tops(buckets, width, run, band))
            self.bands.append(buckets)
            self.widths.append(width)
            width *= run**band
            ended.append(found.where(F.col("n") <= width))
            nodes, own = found.where(F.col("n") > width), ()
            if nodes.isEmpty():
                break
        self.roots = ended[0]
        for more in ended[1:]:
            self.roots = self.roots.unionByName(more)

    def paths(self, upper: DataFrame) -> DataFrame:
        """tree, lo, hi, digest, path (siblings from the leaf up), root, subroot and carried columns of every leaf.

        ``upper`` has utree, root, subroot and path: for each tree the root of
        all, its own one, and the path between them.
        """
        run, band = self.run, self.band
        above = None
        for level in range(len(self.bands) - 1, -1, -1):
            width, buckets = self.widths[level], self.bands[level]
            top = buckets.where(F.col("n") <= width * run**band).join(upper, F.col("tree").eqNullSafe(F.col("utree")), "left").drop("utree")
            if above is not None:
                # the node whose interval contains the bucket's: its first rank is the bucket's
                inner = buckets.where(F.col("n") > width * run**band).withColumn("first", F.element_at("foot", 1)["lo"]).withColumn("last", F.element_at("foot", -1)["hi"])
                contained = (F.expr(f"first div {width * run**band}") == F.col("ubucket")) & (F.col("first") >= F.col("ulo")) & (F.col("last") <= F.col("uhi")) & F.col("tree").eqNullSafe(F.col("utree"))
                inner = inner.join(above, contained, "inner")
                top = top.unionByName(inner.select(*top.columns))
            if level:
                above = cut(self._attached(top, width, ()).select(F.col("tree").alias("utree"), F.expr(f"lo div {width}").alias("ubucket"), F.col("lo").alias("ulo"), F.col("hi").alias("uhi"), "path", "root", "subroot"))
        return self._attached(top, width, self.carried)

    def _attached(self, buckets: DataFrame, width: int, carried: tuple[str, ...]) -> DataFrame:
        run, band = self.run, self.band
        kinds = {f.name: f.dataType.simpleString() for f in buckets.schema["foot"].dataType.elementType.fields}
        schema = f"tree string, lo long, hi long, digest string, path {PATH}, root string, subroot string" + "".join(f", {c} {kinds[c]}" for c in carried)

        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    tree, n, foot, path, root, subroot = (c[i] for c in batch.columns)
                    nodes = foot.values
                    cols = {f.name: nodes.field(k) for k, f in enumerate(nodes.type)}
                    own = list(zip(*(cols[c].to_pylist() for c in ("lo", "hi", "digest"))))
                    rest = [(p["before"], p["after"]) for p in path.as_py() or []]
                    paths = [[*p, *rest] for p in siblings(levels_above(own, width, n.as_py() <= width * run**band, run, band))]
                    ends = list(accumulate(map(len, paths), initial=0))
                    steps = pa.StructArray.from_arrays([pa.array([s[k] for p in paths for s in p], pa.string()) for k in (0, 1)], ["before", "after"])
                    told = [pa.array([x.as_py()] * len(own), pa.string()) for x in (tree, root, subroot)]
                    out = [told[0], cols["lo"], cols["hi"], cols["digest"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps), told[1], told[2], *[cols[c] for c in carried]]
                    yield pa.RecordBatch.from_arrays(out, ["tree", "lo", "hi", "digest", "path", "root", "subroot", *carried])

        return buckets.select("tree", "n", "foot", "path", "root", "subroot").mapInArrow(down, schema)


def manifest(leaves: DataFrame, carried: tuple[str, ...] = (), run: int = RUN, band: int = BAND) -> DataFrame:
    """doc_id, tree, rank, leaf, subroot, root, path (and ``carried`` columns) of each row of doc_id, tree, leaf.

    ``path`` lists from the leaf up, through the root of its tree to that of
    all trees, the siblings before and after the node on the way.  In a tree
    leaves are in order of doc_id, rows without one first; rows that share a
    doc_id are in order of their digests.  Rows of a null tree are a tree of
    their own, the first one.  Repeated rows are a leaf each, and an empty
    table gives none.
    """
    ship(leaves.sparkSession)
    thin = cut(pick(leaves, "doc_id", "tree", "leaf", *carried))
    nodes = lambda rows, digest, *rest: rows.select("tree", "n", F.col("rank").alias("lo"), F.col("rank").alias("hi"), F.col(digest).alias("digest"), *rest)
    rest = ("doc_id", *carried)
    trees = Trees(nodes(ranked(thin, "tree", "doc_id", "leaf"), "leaf", *rest), run, band, rest)
    tops_ = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    over = Trees(nodes(ranked(tops_, "tree", "name"), "digest", "name"), run, band, ("name",))
    start = over.roots.select(F.col("tree").alias("utree"), F.lit(None).cast(PATH).alias("path"), F.col("digest").alias("root"), F.col("digest").alias("subroot"))
    upper = cut(over.paths(start).select(F.col("name").alias("utree"), "path", "root", F.col("digest").alias("subroot")))
    return trees.paths(upper).select("doc_id", "tree", F.col("lo").alias("rank"), F.col("digest").alias("leaf"), "subroot", "root", "path", *carried)


def proof_of(path: Column) -> Column:
    """Digest of all siblings of a path, put together in its order, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def root_from(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["before"], own, s["after"]), 256))
