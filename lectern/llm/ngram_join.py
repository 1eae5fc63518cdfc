"""N-gram Jaccard join: which documents' shingle sets are linked, and through whom.

The incidence matrix of different texts by n-grams is multiplied with its
transpose in blocks.  With sizes n and m, 100 * overlap >= pct * union needs an
overlap of pct % of either size at least (``needed``).  All n-grams have one
order, from rare to frequent, and of two linked texts the first
size - needed + 1 + e (the head) have t = min(e, e') + 1 in common.

A first, slim product over heads alone counts how many n-grams each text
shares with any other, and discards texts below t.  What is left is dealt into
blocks: of the texts with an n-gram in their heads the most central one is its
leader, and a leader's block is everyone whose head has one of its n-grams.
Leaders that have most of their n-grams under another leader give their blocks
to it.  A text counts its n-grams under each leader and leaves those under
which it has fewest, as long as they are no more than (t - 1) / 2 in all:
linked texts then still have an n-gram, and so a block, in common, while chance
overlaps of long texts are gone.  A block is multiplied tile by tile, CHUNK by
CHUNK texts, its
overlap counts accumulated over stretches of n-grams; pairs below the bound are
discarded, and a pair that meets in several blocks counts in the one of
smallest leader.  Components follow from a spanning forest of each tile.

How rare an n-gram is, is told from a sketch of fixed size (``Rarity``).  It
only orders n-grams, so the result doesn't depend on its precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import added_up, cut, pick, ship, small, stretches, turn
from .components import components
from .shingles import BUCKETS, Rarity, as_lists, sets_of, shingle_sets, signature, sketch, sliced, words_of

#: Rows of ids (some 100 bytes each) up to which candidates are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 250_000
#: Texts on a side of a tile, and n-grams that are multiplied at once.
CHUNK, COLUMNS = 512, 4_096
#: e: per thousand of a set, how many n-grams its head has beyond those that hold one in common.
SPARE = 40


def needed(n: int, pct: int) -> int:
    """The least overlap of a set of ``n`` with any set it links to."""
    return -(-pct * n // 100)


def spare(n: int) -> int:
    return SPARE * n // 1_000


def least_shared(n: int, pct: int) -> int:
    """Of the n-grams in its head, how many a set of ``n`` shares with any set it links to."""
    return min(spare(needed(n, pct)) + 1, needed(n, pct))


def sizes_and_sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, node (64 bits of the set), text_key of each row; and (at, counts) of each task's sketch, in rows of their own."""
    names = ["doc_id", "n", "node", "text_key", "at", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("ngram_join")
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            for part in sliced(batch):
                word, counts = words_of(part.column(1))
                sets = sets_of(word, counts, width)
                total += sketch(word, sets)
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s)[0] for s in sets], pa.int64()), part.column(2), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)
        if total.any():
            at, rows = stretches(total)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, at, rows], names)

    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc_id long, n long, node long, text_key long, at int, counts array<long>")


def heads(docs: DataFrame, width: int, pct: int, rarity: Rarity) -> DataFrame:
    """(g, node, n): the n-grams of each row's head."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)  # 2 * BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("ngram_join")
        for batch in batches:
            for part in sliced(batch):
                sets = [s for s in sets_of(*words_of(part.column(1)), width, shared.value) if len(s)]
                if not sets:
                    continue
                sizes = [min(len(s), len(s) - needed(len(s), pct) + 1 + spare(len(s))) for s in sets]
                columns = [np.concatenate([s[:k] for s, k in zip(sets, sizes, strict=True)]).view(np.int64), np.repeat([signature(s)[0] for s in sets], sizes), np.repeat([len(s) for s in sets], sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "node", "n"])

    return docs.mapInArrow(run, "g long, node long, n long")


def shared_only(rows: DataFrame) -> DataFrame:
    """The rows of ``heads`` whose n-gram occurs in different texts, once for each text.

    Rows come sorted by n-gram and text.  Of an n-gram only its first row
    waits for a second text, so one that many rows have takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("ngram_join")
        held: pa.RecordBatch | None = None  # the last row, not given out yet if its n-gram has shown one text so far
        waits = False
        for batch in batches:
            if not len(batch):
                continue
            both = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            g, node = both.column(0).to_numpy(), both.column(1).to_numpy()
            same = np.r_[False, g[1:] == g[:-1]]
            new = ~(same & np.r_[False, node[1:] == node[:-1]])  # the first row of a text under an n-gram
            start = np.flatnonzero(~same)
            of = np.cumsum(~same) - 1
            texts = np.add.reduceat(new, start)
            if held is not None and not waits:
                texts[0] += 1
            give = new & (texts[of] > 1)
            if held is not None and not waits:
                give[0] = False
            waits = bool(texts[-1] <= 1)
            # what waits is its n-gram's only text: all its rows are the same
            held = both.slice(len(both) - 1)
            yield both.filter(pa.array(give))

    return rows.repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, rows.schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("ngram_join")
        for batch in batches:
            for part in sliced(batch):
                sets = shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([signature(s)[0] for s in sets], pa.int64()), as_lists(sets)], ["rep", "node", "hashes"])

    return docs.mapInArrow(run, "rep long, node long, hashes array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set on the left has in common with each one on the right."""
    sizes = [len(x) for x in (*left, *right)]
    out = np.zeros((len(left), len(right)), np.float64)
    if not sum(sizes):
        return out.astype(np.int64)
    codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1].reshape(-1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # a column of one side alone adds nothing
    top = int(codes.max()) + 1
    ours, theirs = np.zeros(top, bool), np.zeros(top, bool)
    ours[codes[owner < len(left)]] = True
    theirs[codes[owner >= len(left)]] = True
    both = ours & theirs
    kept = both[codes]
    codes, owner = (np.cumsum(both) - 1)[codes[kept]], owner[kept]
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    for low in range(0, int(both.sum()), COLUMNS):
        some = slice(*np.searchsorted(codes, [low, low + COLUMNS]))
        x = np.zeros((len(sizes), min(COLUMNS, int(both.sum()) - low)), np.float32)
        x[owner[some], codes[some] - low] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest place in the component of each row of a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        best = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _tiles(members: DataFrame, pct: int, pairs: bool) -> DataFrame:
    """Links in the tiles of blocks, each one counted once.

    (a, a_n, b, b_n, overlap) of each, or (node, links, root): how many rows a
    text links to within a tile, and a text that it is connected with there.
    """
    dealt = members.repartition("leader", "p", "q").sortWithinPartitions("leader", "p", "q")

    def told(rows: list[tuple]) -> pa.RecordBatch | None:
        leader, p, q = rows[0][:3]
        rows = list({r[4]: r for r in rows}.values())  # rows of one doc_id and text are one text
        one = [i for i, r in enumerate(rows) if r[3] == p]
        two = one if p == q else [i for i, r in enumerate(rows) if r[3] == q]
        n = np.array([r[5] for r in rows])
        if not one or not two or 100 * min(n[one].max(), n[two].max()) < pct * max(n[one].min(), n[two].min()):
            return None
        common = overlaps([rows[i][8] for i in one], [rows[i][8] for i in two])
        ok = 100 * common >= pct * (n[one][:, None] + n[two][None, :] - common)
        if one is two:
            ok = np.triu(ok, 1)
        if not ok.any():
            return None
        nodes = np.array([r[4] for r in rows])
        # a pair that also meets under a smaller leader counts there
        lesser = [[x for x in r[7] if x < leader] for r in rows]
        home = ok & (overlaps([np.array(lesser[i], np.int64) for i in one], [np.array(lesser[i], np.int64) for i in two]) == 0)
        x, y = np.nonzero(home)
        at_x, at_y = np.array(one)[x], np.array(two)[y]
        if pairs:
            columns = (nodes[at_x], n[at_x], nodes[at_y], n[at_y], common[x, y])
            return pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in columns], ["a", "a_n", "b", "b_n", "overlap"])
        links, weight = np.zeros(len(rows), np.int64), np.array([r[6] for r in rows])
        np.add.at(links, at_x, weight[at_y])
        np.add.at(links, at_y, weight[at_x])
        linked = np.zeros((len(rows), len(rows)), bool)
        linked[np.ix_(one, two)] |= ok
        linked |= linked.T
        some = np.flatnonzero(linked.any(axis=1))
        top = roots(linked)
        return pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in (nodes[some], links[some], nodes[top[some]])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("ngram_join")
        rows: list[tuple] = []
        for batch in batches:
            offsets = batch.column(8).offsets.to_numpy()
            values = batch.column(8).values.to_numpy(zero_copy_only=False)
            plain = [batch.column(k).to_pylist() for k in range(8)]
            for i, row in enumerate(zip(*plain, strict=True)):
                if rows and rows[0][:3] != row[:3]:
                    if (done := told(rows)) is not None:
                        yield done
                    rows = []
                # a copy, so that a batch is let go of once it is read
                rows.append((*row, values[offsets[i] : offsets[i + 1]].copy()))
        if rows and (done := told(rows)) is not None:
            yield done

    return dealt.mapInArrow(run, "a long, a_n long, b long, b_n long, overlap long" if pairs else "node long, links long, root long")


def _least(n: str, pct: int) -> Column:
    """``least_shared`` of a column."""
    need = F.ceil(F.col(n) * pct / 100 - 1e-9)
    return F.least(F.floor(need * SPARE / 1_000 + 1e-9) + 1, need)


def _members(docs: DataFrame, width: int, pct: int, broadcast_ids: int, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of all rows; texts (node, n, rep, rows); and what ``_tiles`` takes."""
    docs = pick(docs, "doc_id", "text")
    ship(docs.sparkSession)
    both = cut(sizes_and_sketch(docs, width))
    sizes = both.where("at IS NULL").select("doc_id", "n", "node", "text_key")
    texts = sizes.where("n > 0 AND doc_id IS NOT NULL").groupBy("node", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    known = docs.where("doc_id IS NOT NULL")

    # the slim product: n-grams of heads that different texts have, counted by text
    shared = cut(shared_only(heads(known, width, pct, Rarity(added_up(both.where("at IS NOT NULL"), 2 * BUCKETS)))))
    found = shared.groupBy("node", "n").agg(F.count("*").alias("found")).where(F.col("found") >= _least("n", pct))
    left = shared.join(found.select("node"), "node")
    # once more among those that are left, which gives how central each of them is
    twice = left.groupBy("g").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("g")
    left = cut(left.join(twice, "g"))
    found = left.groupBy("node", "n").agg(F.count("*").alias("found")).where(F.col("found") >= _least("n", pct))
    found = cut(found.select("node", (F.col("found") / F.col("n")).alias("central")))
    rows = left.join(found, "node")
    led = rows.groupBy("g").agg(F.max(F.struct("central", "node")).alias("top"), F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    counted = cut(rows.join(led.select("g", F.col("top.node").alias("leader")), "g").groupBy("node", "n", "leader").agg(F.count("*").alias("common")))
    # leaders with most of their n-grams under one leader give their blocks to it
    best = counted.groupBy("node").agg(F.max(F.struct("common", "leader")).alias("most"), F.sum("common").alias("all")).where("2 * most.common >= all AND most.leader <> node")
    given = best.select(F.col("node").alias("leader"), F.col("most.leader").alias("to"))
    merged = counted.join(given, "leader", "left").groupBy("node", "n", F.coalesce("to", "leader").alias("leader")).agg(F.sum("common").alias("common"))
    fewest = Window.partitionBy("node").orderBy("common", "leader").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    star = merged.withColumn("upto", F.sum("common").over(fewest)).where(2 * F.col("upto") > _least("n", pct) - 1).select("node", "leader")
    star = cut(star)
    parts = star.groupBy("leader").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"), F.count("*").alias("members")).where("members > 1")
    homes = star.groupBy("node").agg(F.sort_array(F.collect_list("leader")).alias("homes"))  # no more than a head has n-grams
    dealt = star.join(parts, "leader").join(homes, "node").join(texts, "node").withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = cut(dealt.select("leader", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "n", "rows", "homes", "rep"))

    # sets of whole texts come last, and go straight to their tiles
    reps = dealt.select(F.col("rep").alias("doc_id")).distinct()
    few = small(dealt, broadcast_ids)
    hint = F.broadcast if few else (lambda x: x)
    sets = _sets(known.join(hint(reps), "doc_id", "left_semi"), width)
    members = sets.join(hint(dealt), ["node", "rep"]).select("leader", "p", "q", "own", "node", "n", "rows", "homes", "hashes")
    return sizes, texts, members


def ngram_pairs(docs: DataFrame, width: int = 5, pct: int = 80, broadcast_ids: int = BROADCAST_IDS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """All links between different texts, and who has these texts.

    Pairs (a, b, a_class, b_class, a_n, b_n, overlap) of classes, each once; a
    and b are their smallest doc_ids.  Membership (doc_id, class, n_shingles),
    class null for a row that has no link to a different text.  Rows are
    treated as by ``ngram_jaccard_join``.
    """
    sizes, texts, members = _members(docs, width, pct, broadcast_ids, chunk)
    found = cut(_tiles(members, pct, True))
    one = texts.select(F.col("node").alias("a_class"), F.col("rep").alias("a"))
    two = texts.select(F.col("node").alias("b_class"), F.col("rep").alias("b"))
    pairs = found.withColumnsRenamed({"a": "a_class", "b": "b_class"}).join(one, "a_class").join(two, "b_class").select("a", "b", "a_class", "b_class", "a_n", "b_n", "overlap")
    named = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct().withColumn("class", F.col("node"))
    return pairs, sizes.where("doc_id IS NOT NULL").join(named, "node", "left").select("doc_id", "class", F.col("n").alias("n_shingles"))


def ngram_jaccard_join(docs: DataFrame, width: int = 5, pct: int = 80, broadcast_ids: int = BROADCAST_IDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id, text_key for every row of ``docs``.

    A set is a text's distinct ``width``-word shingles (A-Z lower-cased, ASCII
    white space between words); with fewer words the whole text is its one
    shingle; an empty or null text has none and links with nothing.  Two rows
    link when 100 * overlap >= pct * union; n_links is how many other rows with
    a doc_id a row links with, copies included, and component_id the smallest
    doc_id that links reach.  Rows that share a doc_id are documents of their
    own, each with its own text's links.  A row without doc_id has its size
    and a null component and links nothing.  text_key is xxhash64 of the text,
    which tells rows that share a doc_id apart.  No row is dropped; other
    columns are ignored; an empty table gives none.
    """
    sizes, texts, members = _members(docs, width, pct, broadcast_ids, chunk)
    tiles = cut(_tiles(members, pct, False))
    links = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(tiles.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = cut(found.join(links, "node").join(texts.select("node", "rep"), "node"))
    first = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.join(first, "component").select("node", "links", "component_id")
    named = texts.join(linked, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    # copies of one text share one row of ``named``
    rows = sizes.join(named, "node", "left")
    known = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(known, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_key",
    )
